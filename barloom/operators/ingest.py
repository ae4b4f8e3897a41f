"""Ingestion: whole histories, the days missing since the last bar, and simulated days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.manifest import Table
from ..sources.quotes import Connector
from ..sources.sink import KEYS, append
from . import state
from .quality import accepted
from .scan import active, bars_of_active


def safe_end_date(now: dt.datetime, close: dt.time, delay_hours: int = 3) -> dt.date:
    """Today once the market has been closed for more than the delay, else the day before."""
    settled = dt.datetime.combine(now.date(), close) + dt.timedelta(hours=delay_hours)
    return now.date() if now > settled else now.date() - dt.timedelta(days=1)


def historical(connector: Connector, universe: DataFrame, path: str | Table, today: str, years: int, max_spike: float | None = None) -> int:
    """Append the bars of the last ``years`` years of all symbols in use; the number of new bars.  With ``max_spike`` those of symbols with errors among them are left out."""
    end = dt.date.fromisoformat(today)
    start = end.replace(year=end.year - years, day=min(end.day, 28))
    bars = connector.historical(active(universe), str(start), today)
    return append(bars if max_spike is None else accepted(bars, bars.limit(0), max_spike), path, KEYS["stock_prices"])


def daily(connector: Connector, universe: DataFrame, stored: DataFrame, path: str | Table, today: str, years: int, max_spike: float | None = None) -> int:
    """Append the bars after each symbol's last one; a symbol without bars gets its whole history.

    Known symbols are asked only for days since the earliest of their last
    bars.  With ``max_spike`` bars of symbols with errors among them are left out.
    """
    symbols = active(universe)
    latest = stored.join(symbols.select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(F.max("date").alias("_latest"))
    end = dt.date.fromisoformat(today)
    start = end.replace(year=end.year - years, day=min(end.day, 28))
    incoming = connector.historical(symbols.join(latest, "symbol", "left_anti"), str(start), today)
    oldest = latest.agg(F.min("_latest")).first()[0]
    if oldest is not None:
        since = connector.historical(symbols.join(latest, "symbol", "left_semi"), str(oldest + dt.timedelta(days=1)), today)
        incoming = incoming.unionByName(since.join(latest, "symbol").filter(F.col("date") > F.col("_latest")).drop("_latest"))
    return append(incoming if max_spike is None else accepted(incoming, stored, max_spike), path, KEYS["stock_prices"])


def simulated(states: DataFrame, bars: DataFrame, universe: DataFrame, date: str, at: str) -> tuple[DataFrame, int]:
    """Count the stored bars of a simulated day and note the result in the states."""
    count = bars_of_active(bars, universe).filter(F.col("date") == F.lit(date).cast("date")).count()
    states = state.get_or_create(states, date)
    if count:
        return state.complete_ingestion(states, date, count, "HEALTHY", at), count
    return state.complete_without_data(states, date, "NO_DATA", at), 0
