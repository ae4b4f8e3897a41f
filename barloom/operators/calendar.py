"""The trading calendar as a small dimension: a row a day with its session and its index among trading days.

``le`` is the number of trading days up to and including a day, ``lt`` before
it.  Adding n trading days is then a join on the index:
``date[le + n]`` forward and ``date[lt + 1 + n]`` backward.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Exchange holidays by year.
HOLIDAYS = tuple(
    dt.date(year, month, day)
    for year, days in {
        2023: ((1, 26), (3, 7), (3, 30), (4, 4), (4, 7), (4, 14), (5, 1), (6, 28), (8, 15), (9, 19), (10, 2), (10, 24), (11, 14), (11, 27), (12, 25)),
        2024: ((1, 26), (3, 8), (3, 25), (3, 29), (4, 11), (4, 17), (5, 1), (6, 17), (7, 17), (8, 15), (10, 2), (11, 1), (11, 15), (12, 25)),
        2025: ((2, 26), (3, 14), (3, 31), (4, 10), (4, 14), (4, 18), (5, 1), (8, 15), (8, 27), (10, 2), (10, 21), (10, 22), (11, 5), (12, 25)),
        2026: ((1, 26), (3, 3), (3, 26), (3, 31), (4, 3), (4, 14), (5, 1), (6, 26), (10, 2), (10, 12), (11, 9), (11, 27), (12, 25)),
    }.items()
    for month, day in days
)
#: Most trading days that may be added at once, and most years of a calendar: the dimension stays small enough to send to every task.
MOST_DAYS, MOST_YEARS = 25_200, 110


def build(spark: SparkSession, start: str, end: str, closures: list[str] = (), special: list[str] = ()) -> DataFrame:
    """date, session, is_trading, le, lt for every day of a span.  An emergency closure wins over a special session, that over a holiday, that over a weekend."""
    if (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days > 366 * MOST_YEARS:
        raise ValueError(f"a calendar covers at most {MOST_YEARS} years")
    listed = lambda days: F.array(*[F.lit(str(d)) for d in days]).cast("array<date>")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    among = lambda names: F.array_contains(listed(names), F.col("date"))
    session = (
        F.when(among(closures), "UNEXPECTED_CLOSURE").when(among(special), "SPECIAL_SESSION").when(among(HOLIDAYS), "HOLIDAY").when(F.weekday("date") >= 5, "WEEKEND").otherwise("TRADING")
    )
    marked = days.withColumn("session", session).withColumn("is_trading", F.col("session").isin("TRADING", "SPECIAL_SESSION"))
    le = F.sum(F.col("is_trading").cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("le", le.cast("int")).withColumn("lt", (F.col("le") - F.col("is_trading").cast("int")).cast("int"))


def add_trading_days(frame: DataFrame, calendar: DataFrame, date: str, n: Column | int, out: str) -> DataFrame:
    """``frame`` with ``out``: the day ``n`` trading days from ``date``; null beyond the calendar, or for n = 0 on a day without trading.

    The calendar's bounded size lets both joins broadcast it.
    """
    if isinstance(n, int):
        if abs(n) > MOST_DAYS:
            raise ValueError(f"at most {MOST_DAYS} trading days can be added")
        n = F.lit(n)
    here = calendar.select(F.col("date").alias("_d"), "le", "lt", "is_trading")
    there = calendar.filter("is_trading").select(F.col("date").alias(out), F.col("le").alias("_index"))
    want = F.when(n > 0, F.col("le") + n).when(n < 0, F.col("lt") + 1 + n).when(F.col("is_trading"), F.col("le"))
    placed = frame.join(F.broadcast(here), frame[date] == F.col("_d"), "left").withColumn("_want", want.cast("int"))
    return placed.join(F.broadcast(there), F.col("_want") == F.col("_index"), "left").drop("_d", "le", "lt", "is_trading", "_want", "_index")


def trading_days_between(frame: DataFrame, calendar: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """``frame`` with ``out``: trading days after ``start`` up to ``end``; negative if reversed."""
    a = calendar.select(F.col("date").alias("_a"), F.col("le").alias("_la"))
    b = calendar.select(F.col("date").alias("_b"), F.col("le").alias("_lb"))
    both = frame.join(F.broadcast(a), frame[start] == F.col("_a"), "left").join(F.broadcast(b), frame[end] == F.col("_b"), "left")
    return both.withColumn(out, (F.col("_lb") - F.col("_la")).cast("int")).drop("_a", "_la", "_b", "_lb")


class Closures:
    """Emergency closures as an immutable table: marking twice is marking once, clearing leaves the others."""

    def __init__(self, table: DataFrame):
        self.table = table

    def mark(self, date: str, reason: str, at: str) -> Closures:
        row = self.table.sparkSession.range(1).select(F.lit(date).cast("date").alias("date"), F.lit(reason).alias("reason"), F.lit(at).cast("timestamp_ntz").alias("created_at"))
        return Closures(self.table.unionByName(row.join(self.table.select("date"), "date", "left_anti")))

    def clear(self, date: str) -> Closures:
        return Closures(self.table.filter(F.col("date") != F.lit(date).cast("date")))

    def holds(self, date: str) -> bool:
        return not self.table.filter(F.col("date") == F.lit(date).cast("date")).isEmpty()
