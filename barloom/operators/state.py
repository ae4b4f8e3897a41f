"""Ingestion and scan state by trading day: gates, transitions and set-based simulation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import STATES
from ..storage import work_folder
from .calendar import add_trading_days
from .outcomes import HORIZONS
from .rules import BreakoutRule
from .scan import bars_of_active, next_bar, spread_over_days, with_rules

PENDING, IN_PROGRESS, SUCCESS, NO_DATA, FAILED, SKIPPED = "PENDING", "IN_PROGRESS", "SUCCESS", "SUCCESS_NO_DATA", "FAILED", "SKIPPED"
#: Most cycles of one advance.
MOST_CYCLES = 2000


def can_ingest() -> Column:
    return F.col("ingestion_status").isin(PENDING, FAILED)


def can_scan() -> Column:
    return (F.col("ingestion_status") == SUCCESS) & (F.coalesce("stocks_ingested", F.lit(0)) > 0) & F.col("scan_status").isin(PENDING, FAILED)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATES)


def get_or_create(states: DataFrame, date: str) -> DataFrame:
    """``states`` with a row for the day: pending, pending, source unknown, if it had none."""
    values = {"trading_date": F.lit(date).cast("date"), "ingestion_status": F.lit(PENDING), "scan_status": F.lit(PENDING), "data_source_status": F.lit("UNKNOWN")}
    fresh = states.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])
    return states.unionByName(fresh.join(states.select("trading_date"), "trading_date", "left_anti"), allowMissingColumns=True)


def of_date(states: DataFrame, date: str) -> DataFrame:
    """The state of a day: none or one row."""
    return states.filter(F.col("trading_date") == F.lit(date).cast("date"))


def _change(states: DataFrame, date: str, **values) -> DataFrame:
    own = F.col("trading_date") == F.lit(date).cast("date")
    return states.withColumns({c: F.when(own, F.lit(v).cast(STATES[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def start_ingestion(states, date, mode, at):
    return _change(states, date, ingestion_status=IN_PROGRESS, execution_mode=mode, last_ingestion_time=at)


def complete_ingestion(states, date, count, source, at):
    return _change(states, date, ingestion_status=SUCCESS, stocks_ingested=count, data_source_status=source, last_ingestion_time=at)


def complete_without_data(states, date, source, at):
    return _change(states, date, ingestion_status=NO_DATA, stocks_ingested=0, data_source_status=source, last_ingestion_time=at)


def fail_ingestion(states, date, message, source, at):
    return _change(states, date, ingestion_status=FAILED, error_message=message, data_source_status=source, last_ingestion_time=at)


def start_scan(states, date, at):
    return _change(states, date, scan_status=IN_PROGRESS, last_scan_time=at)


def complete_scan(states, date, signals, at):
    return _change(states, date, scan_status=SUCCESS, signals_generated=signals, last_scan_time=at)


def skip_scan(states, date, reason, at):
    return _change(states, date, scan_status=SKIPPED, error_message=reason, last_scan_time=at)


def fail_scan(states, date, message, at):
    return _change(states, date, scan_status=FAILED, error_message=message, last_scan_time=at)


class Clock:
    """A simulated trading clock: a base day, which must be a trading day, and an offset in trading days."""

    def __init__(self, calendar: DataFrame, base: str, offset: int = 0):
        if calendar.filter((F.col("date") == F.lit(base).cast("date")) & F.col("is_trading")).isEmpty():
            raise ValueError(f"{base} is not a trading day")
        self.calendar, self.base, self.offset = calendar, base, offset

    def today(self) -> str:
        now = self.calendar.sparkSession.range(1).select(F.lit(self.base).cast("date").alias("d"))
        return str(add_trading_days(now, self.calendar, "d", self.offset, "today").first()["today"])

    def advance(self, days: int) -> Clock:
        return Clock(self.calendar, self.base, self.offset + checked_cycles(days))

    def reset(self) -> Clock:
        """The offset alone goes back; signals and states stay."""
        return Clock(self.calendar, self.base)


def checked_cycles(days: int) -> int:
    if not 0 <= days <= MOST_CYCLES:
        raise ValueError(f"days must be between 0 and {MOST_CYCLES}")
    return days


def timed(cycles: DataFrame) -> tuple[list, int]:
    """(rows of a simulation, milliseconds of the whole batch): all cycles are one plan, so they have one duration together."""
    began = time.monotonic()
    rows = cycles.orderBy("cycle").collect()  # at most ``MOST_CYCLES`` rows
    return rows, round(1000 * (time.monotonic() - began))


def simulate(bars: DataFrame, universe: DataFrame, calendar: DataFrame, base: str, days: int, rules: list | None = None, horizons: tuple = HORIZONS) -> DataFrame:
    """One row per simulated trading day: bars of the day, symbols scanned, signals and outcomes.

    The bars are gone through once, for their indicators; what the cycles need
    of each is written, and all cycles are one plan over that.  A day without
    bars is not scanned; an outcome is found on the day of its horizon, if that
    day has a bar.
    """
    spark, rules = bars.sparkSession, rules or [BreakoutRule()]
    begin, last = calendar.agg(F.min("date"), F.max("date")).first()
    frame, rules = with_rules(bars_of_active(bars, universe), rules)
    names = F.filter(F.array(*[F.when(r.matches(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    narrow = frame.select("symbol", "date", "close_price", (F.col("n") == 1).alias("first"), names.alias("rules"), next_bar(str(last)).alias("_next"))
    folder = work_folder(spark, "cycles")
    narrow.write.parquet(folder)
    own = spark.read.schema(narrow.schema).parquet(folder)
    start = calendar.filter(F.col("date") == F.lit(base).cast("date")).select(F.col("le").alias("_base"))
    cycles = calendar.filter("is_trading").join(F.broadcast(start), (F.col("le") > F.col("_base")) & (F.col("le") <= F.col("_base") + checked_cycles(days)))
    cycles = cycles.select((F.col("le") - F.col("_base")).cast("int").alias("cycle"), F.col("date").alias("trading_date"))
    # bars of a day, and symbols that have begun by then: a running sum over the calendar's days, what began before it on its first one
    daily = own.groupBy("date").agg(F.count(F.lit(1)).alias("ingested"), F.count(F.when(F.col("first"), 1)).alias("_new"))
    by_day = daily.groupBy(F.greatest("date", F.lit(begin)).alias("date")).agg(F.sum(F.when(F.col("date") >= F.lit(begin), F.col("ingested"))).alias("ingested"), F.sum("_new").alias("_new"))
    so_far = F.sum(F.coalesce("_new", F.lit(0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    counts = calendar.select("date").join(by_day, "date", "left").select(F.col("date").alias("trading_date"), "ingested", so_far.alias("known"))
    open_days = cycles.join(counts.filter("ingested > 0"), "trading_date", "left_semi").select(F.col("trading_date").alias("scan_date"))
    hits = own.filter(F.size("rules") > 0).select("symbol", F.col("date").alias("scan_date"), "_next", F.explode("rules").alias("rule_name"))
    fired = spread_over_days(hits, calendar).join(open_days, "scan_date", "left_semi")
    signals = fired.groupBy(F.col("scan_date").alias("trading_date")).agg(F.count(F.lit(1)).alias("signals"))
    # an outcome needs a close on both of its days, so both are looked up at once
    dated = add_trading_days(fired.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))), calendar, "scan_date", F.col("horizon"), "trading_date").filter("trading_date IS NOT NULL")
    ends = dated.withColumn("_id", F.struct("symbol", "scan_date", "rule_name", "horizon")).select("_id", "symbol", "trading_date", F.explode(F.array(F.struct(F.col("scan_date").alias("on"), F.lit(True).alias("entry")), F.struct(F.col("trading_date").alias("on"), F.lit(False).alias("entry")))).alias("e"))
    closes = own.filter("close_price IS NOT NULL").select("symbol", F.col("date").alias("_on"), F.col("close_price").alias("_close"))
    met = ends.select("_id", "symbol", "trading_date", F.col("e.on").alias("_on"), F.col("e.entry").alias("entry")).join(closes, ["symbol", "_on"]).filter("NOT entry OR _close <> 0")
    outcomes = met.groupBy("_id", "trading_date").agg(F.count(F.lit(1)).alias("_ends")).filter("_ends = 2").groupBy("trading_date").agg(F.count(F.lit(1)).alias("outcomes"))
    wide = cycles
    for part in (counts, signals, outcomes):
        wide = wide.join(part, "trading_date", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return wide.select("cycle", "trading_date", zero("ingested").alias("ingested"), zero(F.when(F.col("ingested") > 0, F.col("known"))).alias("scanned"), zero("signals").alias("signals"), zero("outcomes").alias("outcomes"))
