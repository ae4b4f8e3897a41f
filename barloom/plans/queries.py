"""The registered queries over the test tables: each takes (spark, folder) and returns a frame."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import asof, isolation, outcomes, quality, scan, slices, state, steps, summary
from ..operators import bars as B
from ..operators import calendar as cal
from ..operators.rules import BreakoutParameters, BreakoutRule
from ..schemas import BARS, CLOSURES, RUN_FIGURES, SIGNALS
from ..sources import bucketed, manifest, payload_source, quotes, seed
from ..sources.sink import KEYS
from ..storage import work_folder
from ..streaming import cycle

#: The date of scans, a symbol, and a span within the shipped dates.
AS_OF, SYMBOL, SPAN = "1999-06-30", "Brand#12", ("1997-01-01", "1997-12-31")
#: The calendar of the shipped dates and of the events.
CALENDAR = ("1994-12-01", "2002-12-31")
EVENTS_CALENDAR, BASE, CYCLES = ("2023-12-01", "2024-03-31"), "2023-12-29", 22
WIDE_GAP = 0.60
#: Dates of a scan and of signals of the lenient rule.
SCAN_DATE, SIGNAL_DATE = "1999-09-16", "1997-09-13"


def wide_rule() -> BreakoutRule:
    """The breakout rule without much of a gap limit, so that enough bars match."""
    return BreakoutRule(BreakoutParameters(max_gap=WIDE_GAP))


def lenient_rule() -> BreakoutRule:
    """The wide rule on half of the volume and little strength, which matches at every size of the test tables."""
    return BreakoutRule(BreakoutParameters(max_gap=WIDE_GAP, volume_multiplier_match=0.5, rsi_threshold_match=30.0))


def short_rules() -> list[BreakoutRule]:
    """Two rules with lookbacks of their own."""
    one, two = (BreakoutRule(BreakoutParameters(max_gap=WIDE_GAP, volume_multiplier_match=0.5, rsi_threshold_match=30.0, lookback_window=k)) for k in (21, 6))
    two.name = "Breakout Short"
    return [one, two]


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe of brands: one isn't in use, of one it isn't known."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()
    active = F.when(F.col("symbol") == "Brand#11", False).when(F.col("symbol") == "Brand#13", None).otherwise(True)
    return brands.select("symbol", F.lit("NSE").alias("exchange"), F.concat(F.lit("Maker of "), "symbol").alias("company_name"), F.lit("Goods").alias("sector"), active.cast("boolean").alias("is_active"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), F.lit(True).alias("is_active")).distinct()


def _brand(spark, d):
    return B.bars_brand(spark, d)


def _trading(spark):
    return cal.build(spark, *CALENDAR)


def _signals(spark, d):
    return scan.backtest(_brand(spark, d), [wide_rule()])


def _signal_keys(spark, d):
    return _signals(spark, d).select("symbol", "scan_date", "rule_name", F.round("confidence", 6).alias("confidence"))


def _frame(spark, d):
    """Indicators of every bar; the registered columns are rounded, as engines add in different orders."""
    return ind.with_indicators(_brand(spark, d))


def _rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


def one_indicator(name: str, source: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.round(source, 6) if source != "avg_volume20" else F.col(source)
        return _frame(spark, sf_dir).select("symbol", "date", value.alias(name))

    return query


def _runs(spark, d):
    """Run rows of a backtest: a run for each date with a signal."""
    return _signals(spark, d).groupBy(F.col("scan_date").alias("run_date")).agg(F.count(F.lit(1)).alias("stocks_flagged"))


def _returns(spark, d):
    calendar = _trading(spark)
    signals = scan.backtest(_brand(spark, d), [wide_rule()], keep=("close_price",))
    due = outcomes.eligible(signals, calendar, "2002-12-30")
    return outcomes.forward_returns(due, _brand(spark, d), calendar, "2002-12-30")


# The calendar's cases.
ADDS = (("2024-02-19", 61), ("2024-02-19", 70), ("2026-02-18", 1), ("2026-02-18", 252), ("2024-01-25", 1), ("2024-01-27", -1), ("2024-01-27", 5), ("2024-01-29", 0), ("2024-01-27", 0), ("2024-02-01", -20))
PAIRS = (("2024-01-25", "2024-01-29"), ("2024-01-29", "2024-01-25"), ("2023-01-01", "2023-12-31"), ("2024-01-27", "2024-01-28"), ("2024-02-19", "2024-06-04"))
STATUSES = ("PENDING", "IN_PROGRESS", "SUCCESS", "SUCCESS_NO_DATA", "FAILED", "SKIPPED")
PAYLOADS = (
    ("AAA", '{"chart":{"result":[{"timestamp":[1704067200,1704153600,1704240000,1704326400],"indicators":{"quote":[{"open":[1.0,2.0,3.0,4.0],"high":[1.5,2.5,3.5,4.5],"low":[0.5,1.5,2.5,3.5],"close":[1.25,null,0.0,4.25],"volume":[100,200,300,3000000000]}],"adjclose":[{"adjclose":[1.2,2.2,3.2,null]}]}}],"error":null}}'),
    ("BBB", '{"chart":{"result":[{"timestamp":[1704067200,1704153600,1704240000],"indicators":{"quote":[{"open":[1.0,2.0,3.0],"high":[1.5,2.5,3.5],"low":[0.5,1.5,2.5],"close":[1.25,2.25,3.25],"volume":[null,-5]}],"adjclose":[{"adjclose":[1.25,2.25,3.25]}]}}],"error":null}}'),
    ("CCC", '{"chart":{"result":[],"error":null}}'),
    ("DDD", '{"chart":{"result":null,"error":{"description":"No data found"}}}'),
)


def _values(spark, rows, names):
    row = lambda r: "(" + ", ".join("NULL" if v is None else f"{v}" if isinstance(v, int) else "'" + v + "'" for v in r) + ")"
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(row, rows))} AS t({', '.join(names)})")


def state_cases(spark: SparkSession) -> DataFrame:
    rows = [(a, b, n) for a in STATUSES for b in STATUSES for n in (None, 0, 5)]
    return _values(spark, rows, ("ingestion_status", "scan_status", "stocks_ingested"))


def _all_calendar(spark):
    return cal.build(spark, "2022-12-01", "2028-12-31", closures=["2024-02-05"], special=["2024-03-02"])


def _adds(spark, d):
    cases = _values(spark, ADDS, ("day", "n")).select(F.col("day").cast("date").alias("day"), "n")
    return cal.add_trading_days(cases, cal.build(spark, "2022-12-01", "2028-12-31"), "day", F.col("n"), "result")


def _step(n):
    def query(spark, d):
        days = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("date").alias("day")).distinct()
        return cal.add_trading_days(days, cal.build(spark, *EVENTS_CALENDAR), "day", n, "result")

    return query


def _between(spark, d):
    cases = _values(spark, PAIRS, ("a", "b")).select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    return cal.trading_days_between(cases, cal.build(spark, "2022-12-01", "2028-12-31"), "a", "b", "days")


def _payloads(spark):
    return _values(spark, PAYLOADS, ("symbol", "body"))


def _scan_eval(spark, d):
    one = scan.evaluate_as_of(_brand(spark, d), AS_OF, wide_rule())
    return one.select(
        "symbol", "date", "n", "volume",
        *_rounded("rsi", "sma20", "sma50", "sma200"), "avg_volume20", *_rounded("recent_high"),
        "enough_bars", "breaks_out", "gap_small", "volume_confirms", "rsi_strong", "trend_up", "matched", *_rounded("confidence"),
    )


def _conditions(spark, d):
    rule = wide_rule()
    return _frame(spark, d).select("symbol", "date", *[c.alias(k) for k, c in rule.conditions().items()], rule.matches().alias("matched"))


def _status(spark, d):
    """Counts of bars, symbols in use and signals, in one row."""
    kinds = [(_brand(spark, d), "bars"), (scan.active(universe(spark, d)), "active"), (_signals(spark, d), "signals")]
    whole = None
    for frame, kind in kinds:
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def _table_counts(spark, d):
    whole = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = spark.read.parquet(f"{d}/{name}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def _dup_bars(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
    return quality.duplicates(rows)


def _simulate(spark, d):
    return state.simulate(B.bars_user(spark, d), users(spark, d), cal.build(spark, *EVENTS_CALENDAR), BASE, CYCLES, [wide_rule()])


def _as_of_signals(spark, d):
    fired = scan.backtest_as_of(B.bars_user(spark, d), cal.build(spark, *EVENTS_CALENDAR), "2024-02-09", [wide_rule()])
    return fired.select("symbol", "scan_date", F.round("confidence", 6).alias("confidence"))


def _dq(spark, d):
    return quality.flags(_brand(spark, d)).select("symbol", "date", "has_null", "price_spike", "price_too_low", "zero_volume", "days_since")


def _metadata(spark, d):
    """What signals carry as JSON, read again."""
    fields = F.from_json("metadata", "close DOUBLE, volume BIGINT, rsi DOUBLE, sma20 DOUBLE, avgVolume20 BIGINT")
    read = scan.backtest(_brand(spark, d), [lenient_rule()]).withColumn("m", fields)
    return read.select("symbol", "scan_date", F.round("m.close", 6).alias("close"), F.col("m.volume").alias("volume"), F.round("m.rsi", 6).alias("rsi"), F.round("m.sma20", 6).alias("sma20"), F.col("m.avgVolume20").alias("avg_volume20"))


def _tickers(spark, d):
    first, last = quotes.epoch_range(F.lit(SPAN[0]).cast("date"), F.lit(SPAN[1]).cast("date"))
    other = universe(spark, d).withColumn("exchange", F.when(F.col("symbol") < "Brand#3", F.lit("NSE")).otherwise("BSE"))
    return other.select("symbol", quotes.ticker(F.col("symbol"), F.col("exchange")).alias("ticker"), first.alias("first_second"), last.alias("last_second"))


def _closures(spark, d):
    """Marked twice, once with an apostrophe, and cleared once."""
    table = cal.Closures(spark.createDataFrame([], CLOSURES))
    for date, reason in (("2024-01-03", "storm"), ("2024-01-03", "again"), ("2024-01-04", "the owner's feast"), ("2024-01-05", "strike")):
        table = table.mark(date, reason, "2024-01-02 08:00:00")
    return table.clear("2024-01-05").table


def _states(spark):
    """Four days through the transitions of ingestion and scan."""
    table = state.empty(spark)
    for day in ("2024-01-29", "2024-01-30", "2024-01-31", "2024-02-01", "2024-01-29"):
        table = state.get_or_create(table, day)
    table = state.start_ingestion(table, "2024-01-29", "API", "2024-01-29 19:00:00")
    table = state.complete_ingestion(table, "2024-01-29", 3, "HEALTHY", "2024-01-29 19:01:00")
    table = state.complete_scan(state.start_scan(table, "2024-01-29", "2024-01-29 19:02:00"), "2024-01-29", 2, "2024-01-29 19:03:00")
    table = state.skip_scan(state.complete_without_data(table, "2024-01-30", "NO_DATA", "2024-01-30 19:01:00"), "2024-01-30", "no bars", "2024-01-30 19:02:00")
    table = state.fail_ingestion(table, "2024-01-31", "timed out", "UNHEALTHY", "2024-01-31 19:01:00")
    return table


def _short(spark, d):
    fired = scan.backtest(_brand(spark, d), short_rules())
    return fired.select("symbol", "scan_date", "rule_name", F.round("confidence", 6).alias("confidence"))


def _quotes_source(spark, d):
    """Payload files of all bars, read again as a source; a year's filter chooses the files."""
    path = work_folder(spark, "payloads")
    payload_source.write_payloads(_brand(spark, d), path)
    payload_source.register(spark)
    bars = spark.read.format("quotes").option("path", path).load()
    return bars.filter(F.col("date").between(*[F.lit(x).cast("date") for x in SPAN]))


def _atomic_append(spark, d):
    """What two writers with overlapping bars leave that append at once."""
    path, bars = work_folder(spark, "prices"), _brand(spark, d).select(*BARS.names)
    parts = [B.history(bars, end="1999-12-31"), B.history(bars, start="1996-01-01")]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda part: manifest.Table(spark, path, KEYS["stock_prices"], BARS).append(part), parts))
    return manifest.Table(spark, path, KEYS["stock_prices"], BARS).read()


def _asof_events(spark, d):
    """Each event with the latest bar of its type that was over by then."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").cast("timestamp_ntz").alias("ts"))
    bars = B.bars_etype(spark, d).select("symbol", (F.col("date") + F.expr("INTERVAL 1 HOUR")).alias("known_at"), "close_price")
    return asof.as_of_join(events, bars, ["symbol"], "ts", "known_at").select("event_id", "symbol", "known_at", "close_price")


def _sliced(spark, d):
    """Five long histories in slices of about 300 bars."""
    frame = slices.with_indicators(B.bars_etype(spark, d), stretch=2 * 86_400, size=300)
    return frame.select("symbol", "date", "n", *_rounded("rsi", "sma20", "sma50", "sma200", "atr14", "recent_high"), "avg_volume20", "above_sma20", "above_sma50", "above_sma200")


def _incremental(spark, d):
    """A scan that reads a summary: one of the bars up to a year before, with the year's months added one after another."""
    bars, rule = B.history(_brand(spark, d), end=AS_OF), wide_rule()
    held = summary.summarise(B.history(bars, end="1998-06-30"))
    for first, last in (("1998-07-01", "1998-12-31"), ("1998-12-01", "1999-04-30"), ("1999-05-01", AS_OF)):
        held = summary.update(held, B.history(bars, start=first, end=last))
    frame, rules = summary.last_bars(held, [rule])
    return frame.select("symbol", "date", "n", "volume", *_rounded("rsi", "sma20", "sma50", "sma200"), "avg_volume20", *_rounded("recent_high"), rules[0].matches().alias("matched"))


class PlainBreakout:
    """The lenient rule in plain Python; it fails for one symbol."""

    name, version = "Plain Breakout", "1.0"
    fails = "Brand#22"

    def snapshot(self) -> str:
        return "{}"

    def signals(self, bars: pd.DataFrame) -> pd.DataFrame:
        if (bars["symbol"] == self.fails).any():
            raise ValueError("these bars can't be read")
        close, high = bars["adj_close"], bars["recent_high"]
        hit = (bars["n"] >= 21) & (close > high) & ((close - high) / high < WIDE_GAP) & (bars["volume"] > bars["avg_volume20"].astype(float) * 0.5) & (bars["rsi"] > 30) & (close > bars["sma20"])
        return bars[hit].assign(confidence=0.5, metadata=None)


def _isolated(spark, d):
    """Signals of a rule that fails for one symbol, and that symbol's error."""
    return isolation.evaluate_each(_frame(spark, d), PlainBreakout()).select("symbol", "scan_date", "rule_name", "error")


def _scan_run(spark, d):
    """The row of a run that has stored its signals."""
    path = work_folder(spark, "run")
    signals, runs = manifest.Table(spark, f"{path}/signals", KEYS["scan_results"], SIGNALS), manifest.Table(spark, f"{path}/runs", ["run_id", "run_date"], RUN_FIGURES)
    scan.run(_brand(spark, d), universe(spark, d), SCAN_DATE, signals, runs, [lenient_rule()])
    return runs.read().select("run_date", "stocks_scanned", "stocks_flagged", "signals_stored", "status", (F.col("duration_ms") > 0).alias("timed"))


def _trailing_stop(spark, d):
    steps.register(spark, steps.TrailingStop(0.5))
    return spark.sql("SELECT * FROM trailing_stop(TABLE({bars}) PARTITION BY symbol ORDER BY date)", bars=_brand(spark, d).select("symbol", "date", "adj_close"))


def _bucketed(spark, d):
    return bucketed.temporary_bars(_brand(spark, d), 8)


def _streamed_signals(spark, d):
    """Signals of a stream of events' bars that is stopped and started again for each of its parts."""
    path, days = work_folder(spark, "cycle"), cal.build(spark, *EVENTS_CALENDAR)
    tables, bars = cycle.Tables(spark, path), B.bars_user(spark, d).select(*BARS.names)
    late = spark.createDataFrame([(None, "2024-02-10")], "symbol string, day string").select("symbol", F.col("day").cast("date").alias("date"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in BARS.fields[2:]])
    for part in (B.history(bars, end="2024-01-15"), B.history(bars, start="2024-01-16"), late):
        part.write.mode("append").parquet(f"{path}/incoming")
        cycle.start(spark, f"{path}/incoming", tables, days, f"{path}/checkpoint", [wide_rule()], files_at_once=100_000).awaitTermination()
    return tables.signals.read().select("symbol", "scan_date", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "streamed_signals": _streamed_signals,
    "quotes_source": _quotes_source,
    "atomic_append": _atomic_append,
    "asof_events": _asof_events,
    "indicators_sliced": _sliced,
    "scan_incremental": _incremental,
    "isolated_signals": _isolated,
    "scan_run": _scan_run,
    "trailing_stop": _trailing_stop,
    "missing_trading_days": lambda s, d: quality.missing_days(_brand(s, d), _trading(s)),
    "bucketed_bundle": lambda s, d: ind.with_indicators(_bucketed(s, d)).select("symbol", "date", *_rounded("rsi", "sma20", "sma50", "sma200"), "avg_volume20", "above_sma20", "above_sma50", "above_sma200"),
    "bucketed_latest": lambda s, d: bucketed.latest(_bucketed(s, d)),
    "bars_brand": _brand,
    "bars_user": B.bars_user,
    "bars_etype": B.bars_etype,
    "price_count": lambda s, d: _brand(s, d).agg(F.count(F.lit(1)).alias("n")),
    "active_universe": lambda s, d: scan.active(universe(s, d)),
    "universe_seed": lambda s, d: seed.seed(seed.universe(s).filter("sector <> 'IT'")).groupBy("sector").agg(F.count(F.lit(1)).alias("n")),
    "symbol_lookup": lambda s, d: universe(s, d).filter(F.col("symbol") == SYMBOL),
    "history_by_symbol": lambda s, d: B.history(_brand(s, d), SYMBOL),
    "history_asof": lambda s, d: B.history(_brand(s, d), end=AS_OF),
    "bars_on_date": lambda s, d: B.on_date(_brand(s, d), AS_OF),
    "bars_between": lambda s, d: B.history(_brand(s, d), SYMBOL, *SPAN),
    "dates_between": lambda s, d: B.history(_brand(s, d), SYMBOL, *SPAN).select("date"),
    "point_lookup": lambda s, d: B.point(_brand(s, d), _signal_keys(s, d).select("symbol", F.col("scan_date").alias("date"))),
    "existing_bars": lambda s, d: B.existing(universe(s, d).select("symbol", F.lit(AS_OF).cast("date").alias("date")), _brand(s, d)),
    "top10_signals": lambda s, d: B.top(_signal_keys(s, d), 10, "scan_date", "symbol", "rule_name"),
    "top10_runs": lambda s, d: B.top(_runs(s, d), 10, "run_date"),
    "latest_bar": lambda s, d: B.latest_bar(_brand(s, d)),
    "latest_date": lambda s, d: B.latest_date(_brand(s, d)),
    "signals_by_date": lambda s, d: scan.backtest(_brand(s, d), [lenient_rule()]).filter(F.col("scan_date") == F.lit(SIGNAL_DATE).cast("date")).select("symbol", "scan_date", "rule_name", F.round("confidence", 6).alias("confidence")),
    "signal_metadata": _metadata,
    "two_rules": _short,
    "eligible_signals": lambda s, d: outcomes.eligible(_signals(s, d), _trading(s), "2000-06-30", _returns(s, d).filter("horizon_days <> 10")),
    "scan_eval": _scan_eval,
    "scan_asof": _as_of_signals,
    "scan_for_date": lambda s, d: scan.scan(_brand(s, d), universe(s, d), SCAN_DATE, [lenient_rule()]).select("symbol", "scan_date", "rule_name", F.round("confidence", 6).alias("confidence")),
    "run_summary": lambda s, d: scan.run_summary(_brand(s, d), universe(s, d), SCAN_DATE, [lenient_rule()]),
    "status_counts": _status,
    "outcomes_by_horizon": lambda s, d: _returns(s, d).groupBy("horizon_days").agg(F.count(F.lit(1)).alias("n")),
    "signals_per_date": lambda s, d: _signals(s, d).groupBy("scan_date").agg(F.count(F.lit(1)).alias("n")),
    "dup_bars": _dup_bars,
    "distinct_symbols": lambda s, d: _brand(s, d).agg(F.countDistinct("symbol").alias("n")),
    "date_span": lambda s, d: _brand(s, d).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")),
    "total_volume": lambda s, d: _brand(s, d).agg(F.sum(F.col("volume").cast("long")).alias("total_volume")),
    "null_violations": lambda s, d: quality.null_violations(_brand(s, d)),
    "rsi14": one_indicator("rsi14", "rsi"),
    **{n: one_indicator(n, n) for n in ("sma20", "sma50", "sma200", "avg_volume20", "atr14", "recent_high")},
    "trend_flags": lambda s, d: _frame(s, d).select("symbol", "date", "above_sma20", "above_sma50", "above_sma200"),
    "indicator_bundle": lambda s, d: _frame(s, d).select("symbol", "date", *_rounded("rsi", "sma20", "sma50", "sma200"), "avg_volume20", "above_sma20", "above_sma50", "above_sma200"),
    "breakout_conditions": _conditions,
    "breakout_signals": _signal_keys,
    "breakout_confidence": lambda s, d: _frame(s, d).select("symbol", "date", F.round(wide_rule().confidence(), 6).alias("confidence")),
    "rule_snapshot": lambda s, d: _signals(s, d).select("rule_name", "rule_version", "parameter_snapshot").distinct(),
    "calendar_sessions": lambda s, d: _all_calendar(s),
    "next_trading_day": _step(1),
    "previous_trading_day": _step(-1),
    "add_trading_days": _adds,
    "trading_days_between": _between,
    "forward_returns": lambda s, d: _returns(s, d).withColumn("forward_return", F.round("forward_return", 9)),
    "can_ingest": lambda s, d: state_cases(s).withColumn("can_ingest", state.can_ingest()),
    "can_scan": lambda s, d: state_cases(s).withColumn("can_scan", state.can_scan()),
    "simulate_cycles": _simulate,
    "table_row_counts": _table_counts,
    "ingest_count_by_date": lambda s, d: scan.bars_of_active(_brand(s, d), universe(s, d)).groupBy("date").agg(F.count(F.lit(1)).alias("n")),
    "ingest_gaps": lambda s, d: quality.gaps(_brand(s, d), universe(s, d), "2002-01-31"),
    "fresh_bars": lambda s, d: quality.fresh_rows(_brand(s, d), B.history(_brand(s, d), end=AS_OF)).select("symbol", "date"),
    "dq_price_spike": _dq,
    "dq_accepted": lambda s, d: quality.accepted(B.history(_brand(s, d), start="1999-07-01"), B.history(_brand(s, d), end=AS_OF), max_spike=400.0).select("symbol", "date"),
    "quote_tickers": _tickers,
    "latest_quotes": lambda s, d: quotes.latest_of(quotes.parse(_payloads(s)), "2024-01-05"),
    "closures": _closures,
    "states": lambda s, d: _states(s),
    "state_of_date": lambda s, d: state.of_date(_states(s), "2024-01-30"),
    "batch_total": lambda s, d: _simulate(s, d).agg(F.count(F.lit(1)).alias("cycles"), *[F.sum(c).alias(c) for c in ("ingested", "scanned", "signals", "outcomes")]),
    "parse_quotes": lambda s, d: quotes.parse(_payloads(s)),
    "quote_status": lambda s, d: quotes.status(_payloads(s)),
}
