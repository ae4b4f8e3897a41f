"""Forward returns of signals at fixed horizons of trading days; appended once, never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import add_trading_days

HORIZONS = (5, 10, 20)


def eligible(signals: DataFrame, calendar: DataFrame, current: str, outcomes: DataFrame | None = None, horizons: tuple = HORIZONS) -> DataFrame:
    """Signals by horizon that are old enough at ``current`` and have no outcome yet; a signal's ``close_price`` stays with it."""
    known = ["close_price"] if "close_price" in signals.columns else []
    spread = signals.select("symbol", "scan_date", "rule_name", *known, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"))
    now = signals.sparkSession.range(1).select(F.lit(current).cast("date").alias("_now"))
    cutoffs = None
    for h in horizons:
        one = add_trading_days(now, calendar, "_now", -h, "cutoff").select(F.lit(h).alias("horizon_days"), "cutoff")
        cutoffs = one if cutoffs is None else cutoffs.unionAll(one)
    old = spread.join(F.broadcast(cutoffs), "horizon_days").filter("scan_date <= cutoff").drop("cutoff")
    if outcomes is None:
        return old
    return old.join(outcomes.select("symbol", "scan_date", "rule_name", "horizon_days"), ["symbol", "scan_date", "rule_name", "horizon_days"], "left_anti")


def forward_returns(due: DataFrame, bars: DataFrame, calendar: DataFrame, current: str) -> DataFrame:
    """Outcomes of due signals: unadjusted close on the scan date and on the very day of the horizon.

    Without a close on either day there is no row, and the signal stays due;
    an entry price of zero gives none either.  Signals that carry the close of
    their own day (``close_price``) need no second look at the bars for it.
    """
    closes = bars.filter("close_price IS NOT NULL").select("symbol", F.col("date").alias("_on"), "close_price")
    dated = add_trading_days(due, calendar, "scan_date", F.col("horizon_days"), "exit_date")
    if "close_price" in due.columns:
        entered = dated.withColumnRenamed("close_price", "entry_price").filter("entry_price IS NOT NULL")
    else:
        entered = dated.join(closes.select("symbol", F.col("_on").alias("scan_date"), F.col("close_price").alias("entry_price")), ["symbol", "scan_date"])
    leave = closes.select("symbol", F.col("_on").alias("exit_date"), F.col("close_price").alias("exit_price"))
    both = entered.join(leave, ["symbol", "exit_date"]).filter("entry_price <> 0")
    return both.select(
        "symbol", "scan_date", "rule_name", "horizon_days", "entry_price", "exit_price",
        ((F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")).alias("forward_return"), F.lit(current).cast("timestamp_ntz").alias("computed_at"),
    )
