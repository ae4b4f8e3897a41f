"""A summary of each symbol that a day's scan reads in place of the history.

It holds the number of bars and the last 200 of them, which is all that the
indicators of the last bar look back on.  Summaries are merged with the bars of
new days alone, so a day costs the summaries and the day, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BARS
from .rules import evaluate
from .scan import active, history_depth, with_rules
from .slices import SLICED

#: Bars that a summary keeps.
KEPT = 200
_REST = [c for c in BARS.names if c != "symbol"]


def _gathered(bars: DataFrame) -> DataFrame:
    """symbol, bars: each symbol's bars by date; only for bars that are few for each symbol."""
    return bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*_REST))).alias("bars"))


def summarise(bars: DataFrame, kept: int = KEPT) -> DataFrame:
    """symbol, n, bars (the last ``kept``, by date) of a whole history.  The rank is cut before the shuffle; dates are set."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    recent = bars.withColumn("_age", age).filter(F.col("_age") <= kept)
    counted = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    last = _gathered(recent).withColumnRenamed("symbol", "_symbol")
    return counted.join(last, counted["symbol"].eqNullSafe(last["_symbol"])).select("symbol", "n", "bars")


def _tail(bars: Column, kept: int) -> Column:
    return F.slice(bars, F.greatest(F.size(bars) - kept + 1, F.lit(1)), kept)


def update(summary: DataFrame, days: DataFrame, kept: int = KEPT) -> DataFrame:
    """The summary with the bars of new days.  Bars that aren't later than a symbol's last one are passed over, so a day that comes twice counts once; new symbols begin a summary."""
    new = _gathered(days.dropDuplicates(["symbol", "date"])).withColumnsRenamed({"symbol": "_symbol", "bars": "_new"})
    both = summary.join(new, summary["symbol"].eqNullSafe(new["_symbol"]), "full_outer")
    none = F.array().cast(dict(summary.dtypes)["bars"])
    last = F.try_element_at("bars", F.lit(-1))["date"]
    fresh = F.filter(F.coalesce("_new", none), lambda b: last.isNull() | (b["date"] > last))
    whole = both.select(F.coalesce("symbol", "_symbol").alias("symbol"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bars", none).alias("bars"), fresh.alias("_fresh"))
    return whole.select("symbol", (F.col("n") + F.size("_fresh")).alias("n"), _tail(F.concat("bars", "_fresh"), kept).alias("bars"))


def merge(earlier: DataFrame, later: DataFrame, kept: int = KEPT) -> DataFrame:
    """The summary of two stretches of history that follow one another, from the summaries of each."""
    right = later.withColumnsRenamed({"symbol": "_symbol", "n": "_n", "bars": "_bars"})
    none = F.array().cast(dict(earlier.dtypes)["bars"])
    both = earlier.join(right, earlier["symbol"].eqNullSafe(right["_symbol"]), "full_outer")
    return both.select(F.coalesce("symbol", "_symbol").alias("symbol"), (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), _tail(F.concat(F.coalesce("bars", none), F.coalesce("_bars", none)), kept).alias("bars"))


def last_bars(summary: DataFrame, rules: list) -> tuple[DataFrame, list]:
    """(each symbol's last bar with its indicators, rules that read them), from the summary alone."""
    if history_depth(rules) > KEPT:
        raise ValueError(f"the rules look back on more than {KEPT} bars")
    each = summary.select("symbol", "n", F.size("bars").alias("_size"), F.posexplode("bars").alias("_at", "_bar"))
    number = F.col("n") - F.col("_size") + F.col("_at") + 1
    frame = each.select("symbol", "_bar.*", number.cast("long").alias("_number"), F.lit(0).alias("_slice"), (F.col("_at") == F.col("_size") - 1).alias("_last"))
    frame, rules = with_rules(frame, rules, by=SLICED)
    return frame.filter("_last").drop("_last", "_number", "_slice"), rules


def scan(summary: DataFrame, universe: DataFrame, as_of: str, rules: list) -> DataFrame:
    """Signals of a scan at ``as_of``, a day that no bar of the summary is later than."""
    own = summary.join(active(universe).select("symbol"), "symbol", "left_semi")
    return evaluate(*last_bars(own, rules)).withColumn("scan_date", F.lit(as_of).cast("date"))
