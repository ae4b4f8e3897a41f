import datetime as dt

from barloom.operators import ingest, state
from barloom.plans.queries import PAYLOADS
from barloom.schemas import BARS, UNIVERSE
from barloom.sources.quotes import PayloadFiles


def test_history_then_days(spark, tmp_path):
    payloads, bars = str(tmp_path / "payloads"), str(tmp_path / "bars")
    spark.createDataFrame(list(PAYLOADS), "symbol string, body string").write.parquet(payloads)
    universe = spark.createDataFrame([("AAA", "NSE", "", "", True), ("BBB", "NSE", "", "", True), ("ZZZ", "NSE", "", "", None)], UNIVERSE)
    connector = PayloadFiles(spark, payloads)
    assert ingest.historical(connector, universe, bars, "2024-01-02", 1) == 3
    stored = spark.read.parquet(bars)
    assert ingest.daily(connector, universe, stored, bars, "2024-01-31", 1) == 2
    assert ingest.daily(connector, universe, spark.read.parquet(bars), bars, "2024-01-31", 1) == 0
    assert connector.healthy(universe, "2024-01-05") and not connector.healthy(universe, "2024-03-05")
    assert {(r["symbol"], r["date"].day) for r in connector.latest(universe, "2024-01-05").collect()} == {("AAA", 4), ("BBB", 3)}


def test_simulated_day(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 5)], BARS)
    universe = spark.createDataFrame([("A", "NSE", "", "", True)], UNIVERSE)
    some, n = ingest.simulated(state.empty(spark), bars, universe, "2024-01-02", "2024-01-02 09:15:00")
    none, m = ingest.simulated(state.empty(spark), bars, universe, "2024-01-03", "2024-01-03 09:15:00")
    assert (n, m) == (1, 0) and some.first()["ingestion_status"] == "SUCCESS" and none.first()["ingestion_status"] == "SUCCESS_NO_DATA"


def test_safe_end_date():
    close = dt.time(15, 30)
    assert ingest.safe_end_date(dt.datetime(2024, 1, 2, 18, 30), close) == dt.date(2024, 1, 1)
    assert ingest.safe_end_date(dt.datetime(2024, 1, 2, 18, 31), close) == dt.date(2024, 1, 2)
