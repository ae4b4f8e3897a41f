import datetime as dt

import pytest

from barloom.operators import quality
from barloom.schemas import BARS
from barloom.sources import quotes, resilience, seed, sink
from barloom.streaming.daily import ingest_available


def test_parse(spark):
    from barloom.plans.queries import PAYLOADS

    frame = spark.createDataFrame(list(PAYLOADS), "symbol string, body string")
    got = {(r["symbol"], str(r["date"])): (r["close_price"], r["adj_close"], r["volume"]) for r in quotes.parse(frame).collect()}
    assert got == {
        ("AAA", "2024-01-01"): (1.25, 1.2, 100), ("AAA", "2024-01-04"): (4.25, 4.25, 2147483647),
        ("BBB", "2024-01-01"): (1.25, 1.25, 0), ("BBB", "2024-01-02"): (2.25, 2.25, 0), ("BBB", "2024-01-03"): (3.25, 3.25, None),
    }
    assert {r["symbol"]: r["status"] for r in quotes.status(frame).collect()} == {"AAA": "OK", "BBB": "OK", "CCC": "SYMBOL_NOT_FOUND", "DDD": "SYMBOL_NOT_FOUND"}


def test_ticker_and_range(spark):
    row = spark.sql("SELECT 'TCS' AS symbol, 'NSE' AS exchange, DATE'2024-01-01' AS a, DATE'2024-01-02' AS b").select(quotes.ticker(*map(__import__("pyspark").sql.functions.col, ("symbol", "exchange"))), *quotes.epoch_range("a", "b")).first()
    assert tuple(row) == ("TCS.NS", 1704067200, 1704239999)


def test_retry_and_breaker():
    now, waits, calls = [0.0], [], []
    breaker = resilience.CircuitBreaker(failures=5, pause=1800, clock=lambda: now[0])

    def fails():
        calls.append(1)
        raise OSError

    for _ in range(2):
        with pytest.raises(resilience.ProviderUnavailable):
            resilience.with_retries(fails, breaker, base=1, jitter=0, sleep=waits.append)
    assert waits == [1, 2, 1, 2] and breaker.state == "OPEN" and len(calls) == 6
    with pytest.raises(resilience.ProviderUnavailable):
        resilience.with_retries(fails, breaker)
    assert len(calls) == 6
    now[0] = 1801
    assert resilience.with_retries(lambda: 7, breaker) == 7 and breaker.state == "CLOSED"

    def unknown():
        raise resilience.SymbolNotFound

    with pytest.raises(resilience.SymbolNotFound):
        resilience.with_retries(unknown, breaker)
    assert breaker.failures == 0
    with pytest.raises(PermissionError):
        resilience.LiveCallGuard(True)(lambda: 1)


def bars(spark, days):
    return spark.createDataFrame([("A", dt.date(2024, 1, d), 1.0, 1.0, 1.0, 1.0, 1.0, 5) for d in days], BARS)


def test_append_twice(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert sink.append(bars(spark, [1, 2, 2]), path, sink.KEYS["stock_prices"]) == 2
    assert sink.append(bars(spark, [1, 2, 3]), path, sink.KEYS["stock_prices"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_daily_stream(spark, tmp_path):
    incoming, stored, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    bars(spark, [1, 2]).write.parquet(incoming)
    ingest_available(spark, incoming, stored, marks).awaitTermination()
    bars(spark, [2, 3]).write.mode("append").parquet(incoming)
    ingest_available(spark, incoming, stored, marks).awaitTermination()
    assert sorted(r["date"].day for r in spark.read.parquet(stored).collect()) == [1, 2, 3]


def test_seed(spark):
    whole = seed.universe(spark)
    assert whole.count() == 50 and seed.seed(whole.limit(20)).count() == 30


def test_quality(spark):
    rows = [("A", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 5), ("A", dt.date(2024, 1, 3), 1.5, 1.5, 1.5, 1.5, 1.5, 0), ("A", dt.date(2024, 1, 4), None, 0.001, 0.001, 0.001, 0.001, None)]
    got = {r["date"].day: r for r in quality.flags(spark.createDataFrame(rows, BARS)).collect()}
    assert (got[3]["price_spike"], got[3]["zero_volume"], got[3]["days_since"], got[3]["has_null"]) == (True, True, 2, False)
    assert got[4]["has_null"] and got[4]["price_too_low"] and not got[1]["price_spike"]


def test_symbols_with_errors_are_left_out(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    row = lambda s, d, c, v=5: (s, d, c, c, c, c, c, v)
    stored = spark.createDataFrame([row("A", day, 10.0), row("B", day, 10.0), row("C", day, 10.0), row("Z", day, 1.0)], BARS)
    after = [day + dt.timedelta(days=i) for i in (1, 2)]
    incoming = spark.createDataFrame([row("A", after[0], 11.0, 0), row("A", after[1], 12.0), row("B", after[0], 20.0), row("B", after[1], 20.0), row("C", after[0], None), row("D", after[0], 0.001), row("E", after[0], 3.0)], BARS)
    assert sorted((r["symbol"], r["date"]) for r in quality.accepted(incoming, stored).collect()) == [("A", after[0]), ("A", after[1]), ("E", after[0])]
    files, bars_, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    stored.write.parquet(bars_)
    incoming.write.parquet(files)
    ingest_available(spark, files, bars_, marks, max_spike=0.4).awaitTermination()
    assert sorted(r["symbol"] for r in spark.read.parquet(bars_).collect()) == ["A", "A", "A", "B", "C", "E", "Z"]


def test_appends_read_only_their_dates(spark, tmp_path):
    path = str(tmp_path / "by_date")
    for d in (1, 2, 3):
        assert sink.append(bars(spark, [d]), path, sink.KEYS["stock_prices"], partition_by="date") == 1
    assert sink.append(bars(spark, [3]), path, sink.KEYS["stock_prices"], partition_by="date") == 0
    assert sink.append(bars(spark, []), path, sink.KEYS["stock_prices"], partition_by="date") == 0
    assert spark.read.parquet(path).count() == 3


def test_payloads_by_ticker(spark, tmp_path):
    from barloom.plans.queries import PAYLOADS
    from barloom.schemas import UNIVERSE

    files = str(tmp_path / "payloads")
    spark.createDataFrame([("AAA.NS", PAYLOADS[0][1]), ("BBB", PAYLOADS[1][1])], "ticker string, body string").write.parquet(files)
    universe = spark.createDataFrame([("AAA", "NSE", "", "", True), ("BBB", "BSE", "", "", True), ("CCC", "NSE", "", "", True)], UNIVERSE)
    got = quotes.PayloadFiles(spark, files).historical(universe, "2024-01-01", "2024-01-02")
    assert sorted((r["symbol"], r["date"].day) for r in got.collect()) == [("AAA", 1), ("BBB", 1), ("BBB", 2)]
