"""Scans at one date and backtests over all dates, each as one plan over all symbols."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..schemas import RUN_FIGURES
from ..sources.manifest import Table
from .rules import BreakoutParameters, BreakoutRule, evaluate

#: Bars of the average volume, which no parameter sets.
AVG_VOLUME_BARS = 20


def active(universe: DataFrame) -> DataFrame:
    """Symbols in use; null counts as not in use."""
    return universe.filter("is_active")


def bars_of_active(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return bars.join(active(universe).select("symbol"), "symbol", "left_semi")


def _parameters(rules: list) -> list[BreakoutParameters]:
    """The parameters of rules, the default ones of a rule without any.  The periods of RSI and means are shared, so rules must agree on them."""
    found = [getattr(r, "p", BreakoutParameters()) for r in rules]
    if len({(p.rsi_period, p.sma_short_period, p.sma_medium_period, p.sma_long_period) for p in found}) > 1:
        raise ValueError("rules of one scan must have the same RSI and SMA periods")
    return found


def history_depth(rules: list) -> int:
    """The bars that the indicators of one bar look back on, itself among them."""
    return max(max(p.lookback_window, p.rsi_period + 1, p.sma_short_period, p.sma_medium_period, p.sma_long_period, AVG_VOLUME_BARS) for p in _parameters(rules))


def with_rules(bars: DataFrame, rules: list, by: tuple = ind.SERIES) -> tuple[DataFrame, list]:
    """(``bars`` with the indicators of all rules, rules that read them): each has the recent high of its own lookback."""
    found = _parameters(rules)
    p = found[0]
    frame = ind.with_indicators(bars, p.rsi_period, p.sma_short_period, p.sma_medium_period, p.sma_long_period, p.lookback_window, by)
    others = sorted({q.lookback_window for q in found} - {p.lookback_window})
    frame = frame.withColumns({f"recent_high_{k}": ind.recent_high(k, by) for k in others}) if others else frame
    return frame, [r if q.lookback_window == p.lookback_window else r.reading(f"recent_high_{q.lookback_window}") for r, q in zip(rules, found, strict=True)]


def last_bars(bars: DataFrame, as_of: str, rules: list) -> tuple[DataFrame, list]:
    """(each symbol's last bar up to a date with its indicators, rules that read them), in one pass over the bars.

    The indicators need only recent bars; ``n`` counts the whole history up to
    the date.  A scan a day needs no history at all: see ``summary``.
    """
    whole = Window.partitionBy("symbol")
    seen = bars.filter(F.col("date") <= F.lit(as_of).cast("date"))
    # number and count stand in the window that the cut needs anyway
    seen = seen.withColumns({"_age": F.row_number().over(whole.orderBy(F.desc("date"))), "_n": F.count(F.lit(1)).over(whole)})
    recent = seen.filter(F.col("_age") <= history_depth(rules))
    frame, rules = with_rules(recent, rules)
    return frame.filter("_age = 1").withColumn("n", F.col("_n")).drop("_age", "_n"), rules


def evaluate_as_of(bars: DataFrame, as_of: str, rule: BreakoutRule | None = None) -> DataFrame:
    """One row per symbol at its last bar up to a date, however old: indicators, each condition, match and confidence."""
    rule = rule or BreakoutRule()
    return last_bars(bars, as_of, [rule])[0].withColumns({**rule.conditions(), "matched": rule.matches(), "confidence": rule.confidence()})


def scan(bars: DataFrame, universe: DataFrame, as_of: str, rules: list | None = None) -> DataFrame:
    """Signals of a scan at ``as_of``: the date of the signal is the scan's, also where the last bar is older."""
    rules = rules or [BreakoutRule()]
    return evaluate(*last_bars(bars_of_active(bars, universe), as_of, rules)).withColumn("scan_date", F.lit(as_of).cast("date"))


def _with_matches(frame: DataFrame, rules: list) -> DataFrame:
    """``frame`` with the number of rules that match each bar."""
    return frame.withColumn("_matches", sum((r.matches().cast("int") for r in rules), F.lit(0)))


def run_summary(bars: DataFrame, universe: DataFrame, as_of: str, rules: list | None = None) -> DataFrame:
    """The run's row: symbols with a bar, and matches of any rule, from one pass over the bars."""
    frame = _with_matches(*last_bars(bars_of_active(bars, universe), as_of, rules or [BreakoutRule()]))
    counts = frame.agg(F.count(F.lit(1)).cast("int").alias("stocks_scanned"), F.coalesce(F.sum("_matches"), F.lit(0)).cast("int").alias("stocks_flagged"))
    return counts.select(F.lit(as_of).cast("date").alias("run_date"), "stocks_scanned", "stocks_flagged", F.lit("SUCCESS").alias("status"))


def run(bars: DataFrame, universe: DataFrame, as_of: str, signals: Table, runs: Table, rules: list | None = None) -> dict:
    """Scan once, append the signals, and append the run's row with what was counted on the way.

    The figures are metrics of the very job that writes the signals, so nothing
    is read again.  A run that fails leaves no signals and a FAILED row, and the error is raised.
    """
    began, observed = time.monotonic(), Observation(f"run-{uuid.uuid4().hex}")
    spark = bars.sparkSession
    row = {"run_date": dt.date.fromisoformat(as_of), "stocks_scanned": 0, "stocks_flagged": 0, "signals_stored": 0, "status": "SUCCESS", "error_message": None}
    try:
        frame, rules = last_bars(bars_of_active(bars, universe), as_of, rules or [BreakoutRule()])
        counted = _with_matches(frame, rules).observe(observed, F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum("_matches"), F.lit(0)).alias("flagged"))
        row["signals_stored"] = signals.append(evaluate(counted, rules).withColumn("scan_date", F.lit(as_of).cast("date")))
        row |= {"stocks_scanned": observed.get["scanned"], "stocks_flagged": observed.get["flagged"]}
    except Exception as e:
        row |= {"status": "FAILED", "error_message": str(e)[:500]}
        raise
    finally:
        row["duration_ms"] = round(1000 * (time.monotonic() - began))
        row["run_id"] = uuid.uuid4().hex  # each run has a row of its own
        runs.append(spark.createDataFrame([row], RUN_FIGURES))
    return row


def backtest(bars: DataFrame, rules: list | None = None, keep: tuple = ()) -> DataFrame:
    """Signals at every bar of every symbol, with ``keep`` columns of the bar: one exchange and one sort in place of a scan a day."""
    return evaluate(*with_rules(bars, rules or [BreakoutRule()]), keep=keep)


def spread_over_days(hits: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signals on every trading day from ``scan_date`` until the day before ``_next``, the symbol's next bar: only matching bars are spread, by the calendar's index."""
    first = calendar.select(F.col("date").alias("scan_date"), F.col("lt").alias("_from"))
    final = calendar.select(F.date_add("date", 1).alias("_next"), F.col("le").alias("_to"))
    spread = hits.join(F.broadcast(first), "scan_date").join(F.broadcast(final), "_next").filter("_to > _from")
    each = spread.withColumn("_index", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))))
    days = calendar.filter("is_trading").select(F.col("le").alias("_index"), F.col("date").alias("_day"))
    kept = [c for c in hits.columns if c not in ("scan_date", "_next")]
    return each.join(F.broadcast(days), "_index").select("symbol", F.col("_day").alias("scan_date"), *[c for c in kept if c != "symbol"])


def next_bar(last_scan: str) -> Column:
    """The date of the symbol's next bar; the day after the last scan, if it has none."""
    return F.coalesce(F.lead("date").over(Window.partitionBy("symbol").orderBy("date")), F.date_add(F.lit(last_scan).cast("date"), 1))


def backtest_as_of(bars: DataFrame, calendar: DataFrame, last_scan: str, rules: list | None = None) -> DataFrame:
    """Signals of a scan on every trading day: a matching bar fires on each of them until the symbol's next bar comes."""
    frame, rules = with_rules(bars, rules or [BreakoutRule()])
    return spread_over_days(evaluate(frame.withColumn("_next", next_bar(last_scan)), rules, keep=("_next",)), calendar)
