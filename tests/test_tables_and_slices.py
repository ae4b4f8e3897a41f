"""Tables of several writers, the payload source, as-of joins, slices, summaries, isolation, steps, buckets and runs, by value and by plan."""

import datetime as dt
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators import asof, bars as B, isolation, quality, scan, slices, steps, summary
from barloom.operators import calendar as cal
from barloom.operators.rules import BreakoutParameters, BreakoutRule
from barloom.plans import queries as plans
from barloom.schemas import BARS, RUN_FIGURES, SIGNALS, UNIVERSE
from barloom.sources import bucketed, manifest, payload_source, quotes
from barloom.sources.sink import KEYS, append
from barloom.storage import Files

FOLDER = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def some_bars(spark, symbols=("A", "B"), days=range(10), seed=1, nulls=0.0):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for d in days:
            price *= 1 + rng.uniform(-0.05, 0.06)
            values = [price, price * 1.02, price * 0.98, price, price]
            rows.append((s, DAY + dt.timedelta(days=d), *[None if rng.random() < nulls else v for v in values], None if rng.random() < nulls else rng.randint(0, 1000)))
    return spark.createDataFrame(rows, BARS)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# tables


def table(spark, path):
    return manifest.Table(spark, str(path), KEYS["stock_prices"], BARS)


def test_several_writers_leave_each_key_once(spark, tmp_path):
    parts = [some_bars(spark, days=range(a, a + 12)) for a in (0, 5, 10, 10)]
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda p: table(spark, tmp_path).append(p), parts))
    stored = table(spark, tmp_path).read()
    assert sum(counts) == stored.count() == stored.select("symbol", "date").distinct().count() == 44
    assert len(table(spark, tmp_path).commits()) == table(spark, tmp_path).version() <= 4
    assert table(spark, tmp_path).append(parts[0]) == 0 and append(parts[1], table(spark, tmp_path), KEYS["stock_prices"]) == 0


def test_a_writer_that_loses_tries_again(spark, tmp_path, monkeypatch):
    mine, other = table(spark, tmp_path), table(spark, tmp_path)
    create, raced = Files.create, []

    def slower(self, name, text):
        if not raced:
            raced.append(None)
            raced[0] = other.append(some_bars(spark, days=range(3)))
        return create(self, name, text)

    monkeypatch.setattr(Files, "create", slower)
    assert mine.append(some_bars(spark, days=range(5))) == 4 and raced == [6] and mine.read().count() == 10


def test_a_dead_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(some_bars(spark, days=range(3)))

    def dies(self, name, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Files, "create", dies)
        m.setattr(Files, "delete", lambda self, name: None)  # as a killed process would
        with pytest.raises(KeyboardInterrupt):
            t.append(some_bars(spark, days=range(3, 6)))
    assert t.read().count() == 6 and len(t.data.names()) > 1
    assert t.clear_drafts() == 0 and t.clear_drafts(0) >= 1 and t.read().count() == 6 and t.append(some_bars(spark, days=range(3, 6))) == 6


def test_versions_dates_and_summed_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "SUMMED", 2)
    t = table(spark, tmp_path)
    for d in range(5):
        assert t.append(some_bars(spark, days=[d])) == 2
    assert t.read(version=2).count() == 4 and t.read().count() == 10 and t.version() == 5
    assert "00000004-all.json" in t.manifests.names() and len(t.commits()) == 5 and len(t.commits(after=4)) == 1
    inside = t.read(first=DAY + dt.timedelta(days=3))
    assert inside.count() == 4 and len(inside.inputFiles()) < len(t.read().inputFiles())
    assert t.append(some_bars(spark, days=[])) == 0 and t.version() == 5


# the payload source


def test_filters_choose_payload_files(spark, tmp_path):
    bars = some_bars(spark, symbols=[f"S{i}" for i in range(6)], days=range(0, 800, 7))
    payload_source.write_payloads(bars, str(tmp_path), files=6)
    payload_source.register(spark)
    whole = spark.read.format("quotes").option("path", str(tmp_path)).load()
    parts = lambda f: f.rdd.getNumPartitions()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bars.collect())) and parts(whole) >= 4
    year = whole.filter(F.col("date") >= F.lit("2026-01-01").cast("date"))
    assert parts(year) < parts(whole) and year.count() == bars.filter("date >= DATE'2026-01-01'").count() > 0
    one = whole.filter("symbol = 'S3' AND date < DATE'2025-01-01'")
    assert parts(one) <= 2 and one.count() == bars.filter("symbol = 'S3' AND date < DATE'2025-01-01'").count()
    assert whole.filter("symbol IN ('S0', 'S5')").count() == bars.filter("symbol IN ('S0', 'S5')").count()
    assert whole.filter("date > DATE'2050-01-01'").count() == 0
    universe = spark.createDataFrame([("S1", "NSE", "", "", True)], UNIVERSE)
    connector = payload_source.SourceConnector(spark, str(tmp_path))
    assert connector.historical(universe, "2024-01-01", "2024-01-31").count() == 5 and connector.latest(universe, "2024-01-31").first()["date"] == dt.date(2024, 1, 29)
    assert connector.healthy(universe, "2024-01-31") and not connector.healthy(universe, "2034-01-31")


def test_payloads_are_read_as_spark_parses_them(spark):
    odd = [("E", "{}"), ("F", "no json"), ("G", json.dumps({"chart": {"result": [{"timestamp": [86400, None, 172800], "indicators": {"quote": [{"close": [1.5, 2.5]}]}}]}}))]
    rows = [*plans.PAYLOADS, *odd]
    want = quotes.parse(spark.createDataFrame(rows, "symbol string, body string")).select(*BARS.names).collect()
    assert sorted(map(tuple, want), key=repr) == sorted((r for s, b in rows for r in payload_source.bars_of(s, b)), key=repr)


# as-of joins


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tasks", [1, 7])
def test_as_of_join_equals_a_plain_one(spark, strict, tasks):
    rng = random.Random(tasks)
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(n))
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", "c"]), at(400)) for i in range(600)]
    right = sorted({(s, at(400)): None for s in ["hot"] * 60 + ["a", "b", "d"] for _ in range(2)})
    right = [(s, t, float(i)) for i, (s, t) in enumerate(right) if s != "hot" or t.day > 4]
    odd = [(1000, None, at(9)), (1001, "hot", None), (1002, "none", at(9))]
    frame = spark.createDataFrame(left + odd, "i int, symbol string, ts timestamp_ntz")
    bars = spark.createDataFrame([*right, (None, at(9), -1.0), ("hot", None, -2.0)], "symbol string, t timestamp_ntz, v double")
    got = {r["i"]: (r["t"], r["v"]) for r in asof.as_of_join(frame, bars, ["symbol"], "ts", "t", strict, tasks=tasks).collect()}
    plain = lambda s, ts: max(((t, v) for k, t, v in right if k == s and (t < ts if strict else t <= ts)), default=(None, None))
    assert got == {i: plain(s, ts) for i, s, ts in left} | {1000: (None, None), 1001: (None, None), 1002: (None, None)}
    near = {r["i"]: r["v"] for r in asof.as_of_join(frame, bars, ["symbol"], "ts", "t", strict, longest=F.expr("INTERVAL 3 HOURS"), tasks=tasks).collect()}
    assert near == {i: v if t is not None and ts - t <= dt.timedelta(hours=3) else None for i, s, ts in left for t, v in [plain(s, ts)]} | {1000: None, 1001: None, 1002: None}


def test_a_hot_key_is_spread(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("symbol"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("ts"), "id")
    bars = spark.createDataFrame([("hot", dt.datetime(2024, 1, 1), 7.0)], "symbol string, t timestamp_ntz, v double")
    joined = asof.as_of_join(rows, bars, ["symbol"], "ts", "t", tasks=8)
    assert joined.filter("v = 7.0").count() == 20_000
    sizes = [r["count"] for r in spark.read.parquet(joined.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 20_000 / 8


def test_as_of_join_of_nothing(spark):
    left = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "i int, symbol string, ts timestamp_ntz")
    right = spark.createDataFrame([], "symbol string, t timestamp_ntz, v double")
    assert [tuple(r) for r in asof.as_of_join(left, right, ["symbol"], "ts", "t").collect()] == [(1, "a", dt.datetime(2024, 1, 1), None, None)]
    assert asof.as_of_join(left.limit(0), right, ["symbol"], "ts", "t").count() == 0
    with pytest.raises(ValueError):
        asof.as_of_join(left.withColumn("v", F.lit(1)), right, ["symbol"], "ts", "t")


# slices and summaries


@pytest.mark.parametrize(("stretch", "size"), [(86_400 * 5, 40), (86_400 * 30, 200), (86_400 * 3000, 10)])
def test_slices_change_no_value(spark, stretch, size):
    bars = some_bars(spark, symbols=["A", "B"], days=[d for d in range(700) if d % 11], nulls=0.05).unionByName(some_bars(spark, symbols=["C"], days=[3]))
    order = ["symbol", "date"]
    whole = ind.with_indicators(bars).orderBy(*order).toPandas()
    sliced = slices.with_indicators(bars, stretch=stretch, size=size).select(*whole.columns).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(whole, sliced, check_exact=True)
    assert slices.with_indicators(bars.limit(0)).count() == 0


def test_one_symbol_makes_many_slices(spark):
    frame = slices.sliced(some_bars(spark, symbols=["A"], days=range(1000)), 200, 86_400 * 10, 100)
    own = {r["_slice"]: r["n"] for r in frame.filter("_own").groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    halo = [r["n"] for r in frame.filter("NOT _own").groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(own) >= 9 and max(own.values()) <= 110 and max(halo) <= 220


def test_summaries_grow_with_days_alone(spark):
    bars, rule = some_bars(spark, symbols=["A", "B", "C"], days=range(230), nulls=0.03), BreakoutRule(BreakoutParameters(max_gap=0.6))
    on = lambda a, b: bars.filter(F.col("date").between(DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b)))
    held = summary.summarise(on(0, 99).filter("symbol <> 'C'"))
    for a, b in ((100, 100), (100, 150), (140, 220), (221, 229)):
        held = summary.update(held, on(a, b).filter("symbol <> 'C' OR date > DATE'2024-03-01'"))
    again = bars.filter("symbol <> 'C'").unionByName(on(100, 229).filter("symbol = 'C'"))
    frame, _ = summary.last_bars(held, [rule])
    want, _ = scan.last_bars(again, str(DAY + dt.timedelta(days=229)), [rule])
    names = want.columns
    pd.testing.assert_frame_equal(frame.select(*names).orderBy("symbol").toPandas(), want.orderBy("symbol").toPandas(), check_exact=True)
    merged = summary.merge(summary.summarise(on(0, 120)), summary.summarise(on(121, 229)))
    assert sorted(map(str, merged.collect())) == sorted(map(str, summary.summarise(bars).collect()))
    with pytest.raises(ValueError):
        summary.last_bars(held, [BreakoutRule(BreakoutParameters(sma_long_period=201))])


def test_a_summary_scans_as_a_history_does(spark):
    bars, universe = B.bars_brand(spark, FOLDER), plans.universe(spark, FOLDER)
    names = ["symbol", "scan_date", "rule_name", "confidence"]
    held = summary.summarise(B.history(bars, end=plans.SCAN_DATE))
    got = summary.scan(held, universe, plans.SCAN_DATE, [plans.lenient_rule()]).select(*names).collect()
    assert sorted(got) == sorted(scan.scan(bars, universe, plans.SCAN_DATE, [plans.lenient_rule()]).select(*names).collect())


# rules


def test_a_failing_symbol_is_kept_apart(spark, tmp_path):
    class Fragile:
        name, version = "Fragile", "1"

        def snapshot(self):
            return "{}"

        def signals(self, bars):
            if bars["volume"].isna().any():
                raise KeyError("no volume")
            return bars.tail(1).assign(confidence=1.0, metadata="m")

    rows = [(s, DAY + dt.timedelta(days=d), 1.0, 1.0, 1.0, 1.0, 1.0, None if s == "B" and d == 1 else 5) for s in "ABC" for d in range(3)]
    frame = spark.createDataFrame(rows, BARS)
    signals, errors = manifest.Table(spark, str(tmp_path / "s"), KEYS["scan_results"], SIGNALS), isolation.quarantine(spark, str(tmp_path / "q"))
    assert isolation.scan_each(frame, Fragile(), signals, errors) == (2, 1) and isolation.scan_each(frame, Fragile(), signals, errors) == (0, 0)
    wrong = errors.read().first()
    assert (wrong["symbol"], wrong["error"], wrong["scan_date"]) == ("B", "KeyError", dt.date(2024, 1, 3)) and "no volume" in wrong["message"]
    left = isolation.without_quarantined(frame, errors.read(), "Fragile")
    assert {r["symbol"] for r in left.select("symbol").distinct().collect()} == {"A", "C"} and isolation.evaluate_each(frame.limit(0), Fragile()).count() == 0


def test_a_rule_with_a_state(spark):
    closes = [10.0, 12.0, None, float("nan"), 11.9, 5.9, 3.0, 4.0, 1.0]
    rows = [(s, DAY + dt.timedelta(days=i), c) for s in ("A", "B") for i, c in enumerate(closes)]
    random.Random(3).shuffle(rows)
    found = steps.evaluate(spark.createDataFrame(rows, "symbol string, date date, adj_close double"), steps.TrailingStop(0.5, "stop_half"))
    want = [(0, "enter", 10.0), (5, "leave", 12.0), (6, "enter", 3.0), (8, "leave", 4.0)]
    assert sorted(map(tuple, found.collect())) == sorted((s, DAY + dt.timedelta(days=i), a, v) for s in ("A", "B") for i, a, v in want)


def test_missing_days_equal_a_plain_count(spark):
    calendar = cal.build(spark, "2023-12-01", "2024-12-31")
    rng = random.Random(2)
    held = {s: sorted({DAY + dt.timedelta(days=rng.randrange(200)) for _ in range(n)}) for s, n in (("A", 120), ("B", 3), ("C", 1))}
    rows = [(s, d) for s, ds in held.items() for d in ds] + [(None, DAY), ("A", None), ("A", dt.date(2030, 1, 1))]
    trading = [r["date"] for r in calendar.filter("is_trading").orderBy("date").collect()]
    want = []
    for s, ds in held.items():
        for a, b in zip(ds, ds[1:]):
            gone = [t for t in trading if a < t < b]
            if gone:
                want.append((s, gone[0], gone[-1], len(gone)))
    got = quality.missing_days(spark.createDataFrame(rows, "symbol string, date date"), calendar)
    assert sorted(map(tuple, got.collect())) == sorted(want)


# plans


def test_windows_over_buckets_need_no_exchange(spark, tmp_path):
    bars = some_bars(spark, symbols=[f"S{i}" for i in range(20)], days=range(30))
    stored = bucketed.write_bars(bars, "bucketed_bars", str(tmp_path / "b"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    bucketed.keep_layout(spark)
    try:
        bundle = ind.with_indicators(stored)
        assert "Exchange" not in plan_of(bundle) and bundle.count() == 600
        assert "Exchange" not in plan_of(bucketed.latest(stored))
        joined = stored.alias("x").join(spark.table("bucketed_bars").alias("y"), F.expr("x.symbol = y.symbol AND x.date = y.date"))
        assert "Exchange" not in plan_of(joined)
        keys = bars.select("symbol", "date").limit(50)
        found = bucketed.point(stored, keys)
        assert found.count() == 50 and plan_of(found).split("FileScan")[0].count("Exchange") <= plan_of(keys.distinct().repartition(4, "symbol")).count("Exchange") + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_bars")


def test_scans_and_runs_read_the_bars_once(spark):
    universe, bars = plans.universe(spark, FOLDER), B.bars_brand(spark, FOLDER)
    for frame in (scan.run_summary(bars, universe, plans.SCAN_DATE), scan.scan(bars, universe, plans.SCAN_DATE), scan.evaluate_as_of(bars, plans.AS_OF)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice#") > 0
        assert frame._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1


def test_a_run_that_fails_leaves_its_row_alone(spark, tmp_path):
    class Broken(BreakoutRule):
        def matches(self):
            return F.raise_error(F.lit("broken rule")).cast("boolean")

    signals, runs = manifest.Table(spark, str(tmp_path / "s"), KEYS["scan_results"], SIGNALS), manifest.Table(spark, str(tmp_path / "r"), ["run_id", "run_date"], RUN_FIGURES)
    universe, bars = plans.universe(spark, FOLDER), B.bars_brand(spark, FOLDER)
    with pytest.raises(Exception, match="broken rule"):
        scan.run(bars, universe, plans.SCAN_DATE, signals, runs, [Broken()])
    assert signals.read().count() == 0 and [r["status"] for r in runs.read().collect()] == ["FAILED"]
    row = scan.run(bars, universe, plans.SCAN_DATE, signals, runs, [plans.lenient_rule()])
    assert row["signals_stored"] == row["stocks_flagged"] == signals.read().count() and runs.read().count() == 2
    again = scan.run(bars, universe, plans.SCAN_DATE, signals, runs, [plans.lenient_rule()])
    assert again["signals_stored"] == 0 and again["stocks_flagged"] == row["stocks_flagged"] and runs.read().count() == 3
