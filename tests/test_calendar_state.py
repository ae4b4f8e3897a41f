import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import calendar as cal
from barloom.operators import outcomes, state
from barloom.schemas import BARS, CLOSURES, SIGNALS


@pytest.fixture(scope="module")
def calendar(spark):
    return cal.build(spark, "2022-12-01", "2028-12-31").cache()


def add(spark, calendar, day, n):
    frame = spark.sql(f"SELECT DATE'{day}' AS day")
    got = cal.add_trading_days(frame, calendar, "day", n, "out").first()["out"]
    return None if got is None else str(got)


def test_adds(spark, calendar):
    cases = {("2024-02-19", 61): "2024-05-22", ("2024-02-19", 70): "2024-06-04", ("2026-02-18", 1): "2026-02-19", ("2026-02-18", 252): "2027-02-23", ("2024-01-25", 1): "2024-01-29", ("2024-01-27", 0): None}
    for (day, n), want in cases.items():
        assert add(spark, calendar, day, n) == want
    with pytest.raises(ValueError):
        add(spark, calendar, "2024-01-01", 25_201)


def test_years_and_holidays(calendar):
    got = {r["y"]: r["n"] for r in calendar.filter("is_trading").groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).collect()}
    assert [got[y] for y in (2023, 2024, 2025, 2026)] == [245, 248, 247, 248]
    assert len(cal.HOLIDAYS) == 56 and all(d.weekday() < 5 for d in cal.HOLIDAYS)


def test_between_is_signed(spark, calendar):
    frame = spark.sql("SELECT DATE'2024-01-25' AS a, DATE'2024-01-29' AS b UNION ALL SELECT DATE'2024-01-29', DATE'2024-01-25' UNION ALL SELECT DATE'2024-01-25', DATE'2024-01-25'")
    assert sorted(r["d"] for r in cal.trading_days_between(frame, calendar, "a", "b", "d").collect()) == [-1, 0, 1]


def test_closure_wins(spark):
    frame = cal.build(spark, "2024-01-01", "2024-01-31", closures=["2024-01-26"], special=["2024-01-27"])
    assert {str(r["date"]): r["session"] for r in frame.filter("date BETWEEN '2024-01-25' AND '2024-01-28'").collect()} == {"2024-01-25": "TRADING", "2024-01-26": "UNEXPECTED_CLOSURE", "2024-01-27": "SPECIAL_SESSION", "2024-01-28": "WEEKEND"}
    table = cal.Closures(spark.createDataFrame([], CLOSURES)).mark("2024-01-03", "storm", "2024-01-03 08:00:00").mark("2024-01-03", "again", "2024-01-03 09:00:00")
    assert table.table.count() == 1 and table.holds("2024-01-03") and not table.clear("2024-01-03").holds("2024-01-03")


def bars(spark, symbol, closes, start="2024-01-29"):
    day = dt.date.fromisoformat(start)
    rows = [(symbol, day + dt.timedelta(days=i), *[float(c)] * 5, 10) for i, c in enumerate(closes) if c]
    return spark.createDataFrame(rows, BARS)


def test_forward_returns_once(spark, calendar):
    signals = spark.createDataFrame([("A", dt.date(2024, 1, 29), "R", 0.5, "1", "1", "{}", "{}"), ("B", dt.date(2024, 1, 29), "R", 0.5, "1", "1", "{}", "{}")], SIGNALS)
    prices = bars(spark, "A", [100.0, 101, 102, 103, 104, 105, 106, 110.0])
    due = outcomes.eligible(signals, calendar, "2024-02-05")
    assert {(r["symbol"], r["horizon_days"]) for r in due.collect()} == {("A", 5), ("B", 5)}
    got = outcomes.forward_returns(due, prices, calendar, "2024-02-05")
    assert [(r["symbol"], round(r["forward_return"], 12)) for r in got.collect()] == [("A", 0.1)]
    again = outcomes.eligible(signals, calendar, "2024-02-05", got)
    assert [r["symbol"] for r in again.collect()] == ["B"]


def test_gates_and_transitions(spark):
    table = state.get_or_create(state.get_or_create(state.empty(spark), "2024-01-29"), "2024-01-29")
    assert table.count() == 1
    see = lambda t: t.select(state.can_ingest().alias("i"), state.can_scan().alias("s")).first()
    assert tuple(see(table)) == (True, False)
    done = state.complete_ingestion(state.start_ingestion(table, "2024-01-29", "API", "2024-01-29 19:00:00"), "2024-01-29", 3, "HEALTHY", "2024-01-29 19:01:00")
    assert tuple(see(done)) == (False, True)
    assert tuple(see(state.complete_ingestion(table, "2024-01-29", 0, "HEALTHY", "2024-01-29 19:01:00"))) == (False, False)
    assert tuple(see(state.complete_without_data(table, "2024-01-29", "NO_DATA", "2024-01-29 19:01:00"))) == (False, False)
    assert see(state.fail_scan(done, "2024-01-29", "x", "2024-01-29 19:02:00"))["s"]
    assert not see(state.complete_scan(done, "2024-01-29", 2, "2024-01-29 19:02:00"))["s"]
    assert not see(state.skip_scan(done, "2024-01-29", "x", "2024-01-29 19:02:00"))["s"]


def test_clock(spark, calendar):
    clock = state.Clock(calendar, "2024-02-19")
    assert clock.advance(61).today() == "2024-05-22" and clock.advance(3).reset().today() == "2024-02-19"
    for days in (-1, 2001):
        with pytest.raises(ValueError):
            clock.advance(days)
    with pytest.raises(ValueError):
        state.Clock(calendar, "2024-02-18")


def test_simulated_cycles_count_up_and_are_timed(spark, calendar):
    days = [dt.date(2024, 1, 29) + dt.timedelta(days=i) for i in range(4)]
    frame = spark.createDataFrame([("A", d, *[1.0] * 5, 10) for d in days] + [("B", days[2], *[1.0] * 5, 10), ("C", dt.date(2020, 1, 1), *[1.0] * 5, 10)], BARS)
    universe = spark.createDataFrame([(s, True) for s in "ABC"], "symbol string, is_active boolean")
    rows, took = state.timed(state.simulate(frame, universe, calendar, "2024-01-29", 4))
    assert [(r["cycle"], str(r["trading_date"]), r["ingested"], r["scanned"]) for r in rows] == [(1, "2024-01-30", 1, 2), (2, "2024-01-31", 2, 3), (3, "2024-02-01", 1, 3), (4, "2024-02-02", 0, 0)]
    assert took >= 0 and sum(r["ingested"] for r in rows) == 4
