"""Golden vectors and a scalar reading of the indicators, the rule and as-of scans."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import with_indicators
from barloom.operators import scan
from barloom.operators.rules import BreakoutParameters, BreakoutRule
from barloom.schemas import BARS, UNIVERSE

DAY = dt.date(2024, 1, 1)


def bars(symbol, closes, volumes=None, highs=None):
    volumes = volumes or [1000] * len(closes)
    out = []
    for i, (c, v) in enumerate(zip(closes, volumes, strict=True)):
        high = highs[i] if highs else None if c is None else c + 0.5
        out.append((symbol, DAY + dt.timedelta(days=i), c, high, None if c is None else c - 0.5, c, c, v))
    return out


def last(spark, rows):
    frame = with_indicators(spark.createDataFrame(rows, BARS))
    rule = BreakoutRule()
    frame = frame.withColumns({"matched": rule.matches(), "confidence": rule.confidence()})
    return {r["symbol"]: r for r in frame.groupBy("symbol").agg(F.max_by(F.struct("*"), "date").alias("r")).select("r.*").collect()}


A = [100.0 + i % 3 for i in range(24)] + [104.0]


def test_golden_vectors(spark):
    holed = list(A)
    holed[-5] = None
    rows = (
        bars("A", A, [1000] * 24 + [2101]) + bars("A2", A, [1000] * 24 + [2110]) + bars("B1", [5.0] * 14) + bars("B2", [5.0] * 15) + bars("B3", [float(i) for i in range(15)])
        + bars("B4", [float(-i) for i in range(15)]) + bars("C1", holed, [1000] * 24 + [2101]) + bars("C2", [None] * 15) + bars("C3", [None] * 20) + bars("D1", [1.0] * 20, [1] * 19 + [2])
        + bars("D2", [1.0] * 20, [0] * 19 + [7]) + bars("D3", [1.0] * 20, [0] * 20) + bars("D4", [1.0] * 20, [None] * 10 + [3] * 9 + [4]) + bars("F3", A[-20:])
    )
    got = last(spark, rows)
    a = got["A"]
    assert (a["rsi"], a["sma20"], a["avg_volume20"], a["recent_high"], a["sma50"]) == (57.89473684210526, 101.2, 1055, 102.5, None)
    assert math.isclose(a["atr14"], 1.8571428571428572, rel_tol=1e-12)
    assert a["matched"] and a["confidence"] == 0.5 and got["A2"]["confidence"] == 0.5
    assert got["B1"]["rsi"] is None and got["B2"]["rsi"] == 100.0 and got["B3"]["rsi"] == 100.0 and got["B4"]["rsi"] == 0.0
    assert math.isclose(got["C1"]["rsi"], 62.5, rel_tol=1e-9) and math.isclose(got["C1"]["sma20"], 101.15789473684211, rel_tol=1e-12)
    assert got["C2"]["rsi"] == 100.0 and got["C3"]["sma20"] is None
    assert [got[f"D{i}"]["avg_volume20"] for i in range(1, 5)] == [1, 7, None, 3]
    assert not got["F3"]["matched"]


def scalar(rows):
    """The indicators of the last row, read off the definitions."""
    n, adj, vol = len(rows), [r[6] for r in rows], [r[7] for r in rows]
    rsi = None
    if n >= 15:
        gain = loss = 0.0
        for i in range(n - 14, n):
            if adj[i] is not None and adj[i - 1] is not None:
                change = adj[i] - adj[i - 1]
                gain, loss = (gain + change, loss) if change > 0 else (gain, loss - change)
        rsi = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    mean = lambda p: None if n < p or not (x := [a for a in adj[-p:] if a is not None]) else sum(x) / len(x)
    traded = [v for v in vol[-20:] if v is not None and v > 0]
    highs = [r[3] for r in rows[-21:-1] if r[3] is not None and r[3] > 0]
    return rsi, mean(20), mean(50), mean(200), sum(traded) // len(traded) if n >= 20 and traded else None, max(highs) if highs else None


def test_random_series_against_scalar(spark):
    rnd, rows = random.Random(5), {}
    for i, n in enumerate([14, 15, 19, 20, 21, 49, 50, 51, 199, 200, 201, 260, 320, 400]):
        hole = rnd.choice([0, 0.1, 0.6, 1.0])
        closes = [None if rnd.random() < hole else rnd.uniform(50, 60) for _ in range(n)]
        rows[f"s{i}"] = bars(f"s{i}", closes, [rnd.choice([None, 0, rnd.randint(1, 9999)]) for _ in range(n)], [rnd.choice([None, -1.0, rnd.uniform(40, 70)]) for _ in range(n)])
    got = last(spark, [r for x in rows.values() for r in x])
    for name, series in rows.items():
        have = [got[name][c] for c in ("rsi", "sma20", "sma50", "sma200", "avg_volume20", "recent_high")]
        for x, y in zip(have, scalar(series), strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)), name


def test_bounded_history_is_enough(spark):
    rnd = random.Random(9)
    rows = [r for k in range(6) for r in bars(f"x{k}", [rnd.uniform(90, 110) for _ in range(260 + 20 * k)], [rnd.randint(1, 5000) for _ in range(260 + 20 * k)])]
    frame = spark.createDataFrame(rows, BARS)
    whole = with_indicators(frame).filter(F.col("date") == F.lit(DAY + dt.timedelta(days=255)))
    cut = scan.evaluate_as_of(frame, str(DAY + dt.timedelta(days=255)))
    cols = ["symbol", "rsi", "sma20", "sma200", "avg_volume20", "recent_high"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, cut.select(cols).collect()))


def test_scans_count_the_whole_history(spark):
    frame = spark.createDataFrame(bars("long", [100.0] * 260, [1000] * 260) + bars("short", [100.0] * 30, [1000] * 30), BARS)
    got = {r["symbol"]: r["n"] for r in scan.evaluate_as_of(frame, str(DAY + dt.timedelta(days=249))).collect()}
    assert got == {"long": 250, "short": 30}


def test_short_parameters_leave_the_average_volume(spark):
    rows = bars("up", [100.0 + (i % 2) * 0.1 for i in range(39)] + [101.0], [1000] * 39 + [5000])
    rules = [BreakoutRule(BreakoutParameters(lookback_window=5, rsi_period=3, sma_short_period=3, sma_medium_period=5, sma_long_period=8))]
    frame, universe = spark.createDataFrame(rows, BARS), spark.createDataFrame([("up", "NSE", "", "", True)], UNIVERSE)
    day = DAY + dt.timedelta(days=39)
    found = [r["confidence"] for r in scan.scan(frame, universe, str(day), rules).collect()]
    assert len(found) == 1 and found == [r["confidence"] for r in scan.backtest(frame, rules).filter(F.col("scan_date") == F.lit(day)).collect()]


def test_scans_one_by_one_equal_the_backtest(spark):
    from barloom.operators import calendar as cal

    rnd = random.Random(3)
    rows = [r for k in range(8) for r in bars(f"y{k}", [100 + rnd.gauss(0, 3) + i / 5 for i in range(60)], [rnd.randint(500, 4000) for _ in range(60)]) if rnd.random() < 0.9]
    frame, universe = spark.createDataFrame(rows, BARS), spark.createDataFrame([(f"y{k}", "NSE", "", "", True) for k in range(8)], UNIVERSE)
    rules = [BreakoutRule(BreakoutParameters(max_gap=0.5, volume_multiplier_match=1.0))]
    calendar = cal.build(spark, "2023-12-01", "2024-12-31")
    days = [str(r[0]) for r in calendar.filter("is_trading AND date BETWEEN '2024-01-20' AND '2024-03-05'").select("date").collect()]
    together = {(r["symbol"], str(r["scan_date"]), r["confidence"]) for r in scan.backtest_as_of(frame, calendar, days[-1], rules).collect() if str(r["scan_date"]) in days}
    apart = {(r["symbol"], d, r["confidence"]) for d in days[::6] for r in scan.scan(frame, universe, d, rules).collect()}
    assert apart and apart == {x for x in together if x[1] in days[::6]}


def test_strict_limits(spark):
    base = [100.0] * 25
    rows = bars("gap", base + [105.0], [1000] * 25 + [5000], [100.0] * 25 + [105.0]) + bars("low", base + [105.0], [1000] * 25 + [5000], [-1.0, None] * 13)
    got = last(spark, rows)
    assert not got["gap"]["matched"] and not got["low"]["matched"]
    with pytest.raises(ValueError):
        BreakoutParameters(max_gap=None)


def test_all_bonuses(spark):
    closes = [100 + 0.01 * i + (0.05 if i % 2 else 0) for i in range(249)] + [103.5]
    got = last(spark, bars("all", closes, [1000] * 249 + [9000]))
    assert got["all"]["matched"] and got["all"]["confidence"] == 0.8999999999999999


def test_each_rule_has_its_own_lookback(spark):
    rules = [BreakoutRule(BreakoutParameters(lookback_window=k, volume_multiplier_match=0.0, rsi_threshold_match=-1.0, max_gap=9.0)) for k in (30, 5)]
    rules[1].name = "Short"
    closes = [100.0 + (20.0 if i == 15 else 0.0) + i / 100 for i in range(39)] + [101.0]
    frame, universe = spark.createDataFrame(bars("up", closes), BARS), spark.createDataFrame([("up", "NSE", "", "", True)], UNIVERSE)
    day = str(DAY + dt.timedelta(days=39))
    for order in (rules, rules[::-1]):
        assert [r["rule_name"] for r in scan.scan(frame, universe, day, order).collect()] == ["Short"]
        assert [r["rule_name"] for r in scan.backtest(frame, order).filter(F.col("scan_date") == F.lit(day).cast("date")).collect()] == ["Short"]
    with pytest.raises(ValueError):
        scan.backtest(frame, [BreakoutRule(), BreakoutRule(BreakoutParameters(rsi_period=5))])


def test_a_rule_in_plain_python(spark):
    from barloom.operators.rules import evaluate_bars
    from barloom.schemas import SIGNALS

    class Highest:
        name, version = "Highest so far", "1"

        def snapshot(self):
            return "{}"

        def signals(self, frame):
            best = frame["adj_close"].cummax().shift()
            return frame[frame["adj_close"] > best].assign(confidence=0.5, metadata="{}")

    got = evaluate_bars(with_indicators(spark.createDataFrame(bars("a", [1.0, 3.0, 2.0, 4.0]) + bars("b", [5.0, 4.0]), BARS)), Highest())
    assert got.schema == SIGNALS and [(r["symbol"], (r["scan_date"] - DAY).days) for r in got.orderBy("scan_date").collect()] == [("a", 1), ("a", 3)]


def test_nan_counts_as_null(spark):
    nan = float("nan")
    rows = bars("last", [100.0] * 24 + [nan], highs=[100.5] * 25) + bars("before", [100.0] * 20 + [nan] + [100.0] * 4)
    got = last(spark, rows)
    assert got["last"]["above_sma20"] is None and not got["last"]["matched"]
    assert math.isclose(got["before"]["atr14"], 12 / 14, rel_tol=1e-12) and got["before"]["above_sma20"] is False
