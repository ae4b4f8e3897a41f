"""Indicators over long histories: time slices with a halo, so that a symbol isn't one task.

Bars are counted by symbol and stretch of time, which is one small row for each.  Stretches
that follow one another make slices of some thousands of bars; the bars of the
stretches just before a slice go along as its halo, as many as the longest
period looks back on.  Windows then run within (symbol, slice), and a bar's
number in its whole history is its number in the slice plus what was counted before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind

#: Seconds of a stretch of time, and bars of a slice.
STRETCH, SLICE = 30 * 86_400, 2000
SLICED = ("symbol", "_slice")


def sliced(bars: DataFrame, back: int, stretch: int = STRETCH, size: int = SLICE) -> DataFrame:
    """``bars`` with _slice, _number (of the bar in its symbol's history) and _own; those of a halo once more for each slice that they precede.

    ``back`` is the number of bars before its own that a slice needs.  A slice
    has ``size`` bars or fewer, but for a single stretch with more.  Bars without a date
    stand before all others, null symbols are one symbol.
    """
    second = F.unix_timestamp(F.col("date").cast("timestamp"))
    marked = bars.withColumn("_stretch", F.coalesce(F.floor(second / stretch), F.lit(-(2**62))).cast("long"))
    # a row for each symbol and stretch, summed before the shuffle
    counted = marked.groupBy("symbol", "_stretch").agg(F.count(F.lit(1)).alias("_bars"))
    order = Window.partitionBy("symbol").orderBy("_stretch")
    before = F.coalesce(F.sum("_bars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_before", before).withColumn("_slice", F.floor(F.col("_before") / size).cast("long"))
    placed = placed.withColumn("_begin", F.min("_before").over(Window.partitionBy("symbol", "_slice")))
    # a stretch is in the halo of the later slices that begin less than ``back`` bars after it
    slices = placed.groupBy("symbol", "_slice").agg(F.first("_begin").alias("_begin"))
    left, right = placed.alias("s"), slices.withColumnsRenamed({"symbol": "_symbol", "_slice": "_later", "_begin": "_later_begin"}).alias("t")
    near = left["symbol"].eqNullSafe(right["_symbol"]) & (F.col("_later") > F.col("_slice")) & (F.col("_later_begin") - (F.col("_before") + F.col("_bars")) < back)
    halo = left.join(right, near).select("s.symbol", "_stretch", F.col("_later").alias("_slice"), "_before", F.lit(False).alias("_own"))
    where = placed.select("symbol", "_stretch", "_slice", "_before", F.lit(True).alias("_own")).unionByName(halo)
    where = where.withColumn("_skipped", F.min("_before").over(Window.partitionBy("symbol", "_slice"))).drop("_before")
    where = where.withColumnsRenamed({"symbol": "_symbol", "_stretch": "_of"})
    spread = marked.join(where, marked["symbol"].eqNullSafe(where["_symbol"]) & (marked["_stretch"] == where["_of"])).drop("_symbol", "_of", "_stretch")
    number = F.row_number().over(Window.partitionBy(*SLICED).orderBy("date")) + F.col("_skipped")
    return spread.withColumn("_number", number.cast("long")).drop("_skipped")


def with_indicators(bars: DataFrame, rsi_period: int = 14, short: int = 20, medium: int = 50, long: int = 200, lookback: int = 21, stretch: int = STRETCH, size: int = SLICE) -> DataFrame:
    """What ``indicators.with_indicators`` gives, by slices: equal rows, in as many tasks as there are slices."""
    back = max(rsi_period + 1, short, medium, long, lookback, 20)
    frame = ind.with_indicators(sliced(bars, back, stretch, size), rsi_period, short, medium, long, lookback, by=SLICED)
    return frame.filter("_own").drop("_slice", "_number", "_own")
