"""Ingestion checks: duplicates, gaps, and flags of doubtful bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SPIKE, MIN_PRICE = 0.40, 0.01


def fresh_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming bars, one per symbol and date, without those stored already."""
    return incoming.dropDuplicates(["symbol", "date"]).join(stored.select("symbol", "date"), ["symbol", "date"], "left_anti")


def gaps(bars: DataFrame, symbols: DataFrame, end: str) -> DataFrame:
    """symbol, latest_date, days (calendar days from it to ``end``); a symbol without bars has nulls."""
    latest = bars.groupBy("symbol").agg(F.max("date").alias("latest_date"))
    return symbols.select("symbol").join(latest, "symbol", "left").withColumn("days", F.datediff(F.lit(end).cast("date"), F.col("latest_date")))


def missing_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """symbol, first_missing, last_missing, days: the runs of trading days between two bars of a symbol on which it has none.

    Gaps and islands by the calendar's index: the trading days between two bars
    are a difference of two numbers, so no symbol is spread into days.  Days
    before a symbol's first bar and after its last aren't missing; bars outside
    the calendar, without a date or a symbol are passed over.
    """
    days = calendar.select(F.col("date").alias("_date"), "le", "lt")
    placed = bars.select("symbol", "date").filter("symbol IS NOT NULL").join(F.broadcast(days), F.col("date") == F.col("_date"))  # a calendar's years are bounded
    following = F.lead("lt").over(Window.partitionBy("symbol").orderBy("date"))
    gaps_ = placed.withColumn("_to", following).filter(F.col("_to") > F.col("le")).select("symbol", (F.col("le") + 1).alias("_first"), F.col("_to").alias("_last"))
    trading = calendar.filter("is_trading")
    name = lambda index, out: F.broadcast(trading.select(F.col("le").alias(index), F.col("date").alias(out)))
    named = gaps_.join(name("_first", "first_missing"), "_first").join(name("_last", "last_missing"), "_last")
    return named.select("symbol", "first_missing", "last_missing", (F.col("_last") - F.col("_first") + 1).cast("int").alias("days"))


def flags(bars: DataFrame, max_spike: float = MAX_SPIKE, min_price: float = MIN_PRICE) -> DataFrame:
    """Bars with flags: nulls, a jump of the close against the bar before (none after a close of 0), a price below the least, no volume, and days since the bar before."""
    order = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close_price").over(order)
    prices = [F.col(c) for c in ("open_price", "high_price", "low_price", "close_price", "adj_close")]
    return bars.withColumns({
        "has_null": F.greatest(*[c.isNull() for c in [*prices, F.col("volume")]]),
        "price_spike": F.coalesce(F.abs(F.try_divide(F.col("close_price") - before, before)) > max_spike, F.lit(False)),
        "price_too_low": F.coalesce(F.least(*prices) < min_price, F.lit(False)),
        "zero_volume": F.coalesce(F.col("volume") == 0, F.lit(False)),
        "days_since": F.datediff("date", F.lag("date").over(order)),
    })


def accepted(incoming: DataFrame, stored: DataFrame, max_spike: float = MAX_SPIKE, min_price: float = MIN_PRICE) -> DataFrame:
    """The incoming bars of symbols without an error among them: a null, a price below the least, or a jump, also against the last stored bar.  Warnings (no volume, days missing) go on."""
    last = stored.join(incoming.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.max_by("close_price", "date").alias("close_price"), F.max("date").alias("date"))
    both = incoming.withColumn("_new", F.lit(True)).unionByName(last.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    wrong = flags(both, max_spike, min_price).filter(F.col("_new") & (F.col("has_null") | F.col("price_spike") | F.col("price_too_low")))
    return incoming.join(wrong.select("symbol").distinct(), "symbol", "left_anti")


def duplicates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_violations(bars: DataFrame) -> DataFrame:
    """One row: bars, and nulls of each column."""
    return bars.agg(F.count(F.lit(1)).alias("bars"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in bars.columns])
