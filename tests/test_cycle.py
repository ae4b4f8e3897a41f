"""The daily cycle as a stream."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.schemas import BARS
from barloom.streaming import cycle


def test_bars_of_a_batch_are_one_window(spark, tmp_path):
    """A bar is given once for all new bars of its symbol, not once for each of the next 200; null values stay."""
    spark.conf.set(*cycle.STATE_STORE)
    first, seen = dt.date(2020, 6, 1), []
    rows = [(s, first + dt.timedelta(days=2 * i), 1.0 + i, 2.0, None, 1.5, 1.0 + i, None if i == 7 else i) for s in "AB" for i in range(260)]
    for part in (rows[:250] + rows[260:], rows[250:260]):
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
        stream = spark.readStream.schema(BARS).parquet(f"{tmp_path}/incoming")
        query = cycle.windows(stream, "1000 days").writeStream.foreachBatch(lambda b, _: seen.append(b.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    one, two = [batch for batch in seen if batch]
    assert len(one) == 250 + 260 and len(two) == 200 + 10
    new = [r for r in [*one, *two] if r["_last"] and r["_from"] == r["date"]]
    assert sorted((r["symbol"], r["date"], r["volume"], r["low_price"], r["_number"]) for r in new if r["volume"] is not None) == sorted((s, d, v, None, i % 260 + 1) for i, (s, d, *_, v) in enumerate(rows) if v is not None)
    assert sum(r["volume"] is None for r in new) == 2
    # every day up to the last bar is scanned once
    days = spark.createDataFrame([(r["symbol"], r["_from"], r["_until"]) for r in [*one, *two] if r["_last"]], "symbol string, a date, b date").select("symbol", F.explode(F.sequence("a", "b")).alias("d")).collect()
    assert len(days) == len(set(days)) == 2 * (2 * 259 + 1)
