"""Quote payloads to bars: JSON documents with parallel arrays, read and parsed by Spark."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "chart STRUCT<error: STRUCT<description: STRING>, result: ARRAY<STRUCT<timestamp: ARRAY<BIGINT>, indicators: STRUCT<"
    "quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, close: ARRAY<DOUBLE>, volume: ARRAY<BIGINT>>>, "
    "adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>>>>"
)
MOST_INT = 2**31 - 1


class Connector(Protocol):
    """Where bars come from; each call returns a frame of bars."""

    def historical(self, symbols: DataFrame, start: str, end: str) -> DataFrame: ...

    def latest(self, symbols: DataFrame, today: str) -> DataFrame: ...

    def healthy(self, symbols: DataFrame, today: str) -> bool: ...


def ticker(symbol: Column, exchange: Column) -> Column:
    """The provider's name of a symbol: ``.NS`` after those of NSE."""
    return F.when(exchange == "NSE", F.concat(symbol, F.lit(".NS"))).otherwise(symbol)


def epoch_range(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last second (UTC) of a span of days."""
    day = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return day(start), day(end) + 86399


def parse(payloads: DataFrame, symbol: str = "symbol", body: str = "body") -> DataFrame:
    """Bars of payloads: a row per timestamp with a close that is neither null nor 0.

    The date is the UTC day; a missing adjusted close is the close; a volume
    is null where its array is too short, 0 where it is null or negative, and
    at most the largest 32-bit integer.
    """
    one = F.from_json(F.col(body), PAYLOAD)["chart"]["result"]
    rows = payloads.select(F.col(symbol).alias("symbol"), F.get(one, F.lit(0)).alias("r"))
    each = rows.select("symbol", F.get("r.indicators.quote", F.lit(0)).alias("q"), F.get("r.indicators.adjclose", F.lit(0)).alias("a"), F.posexplode("r.timestamp").alias("i", "second"))
    at = lambda c: F.get(c, F.col("i"))
    volume = F.when(F.size("q.volume") > F.col("i"), F.least(F.greatest(F.coalesce(at("q.volume"), F.lit(0)), F.lit(0)), F.lit(MOST_INT)))
    close = at("q.close")
    bars = each.select(
        "symbol", F.date_from_unix_date(F.floor(F.col("second") / 86400).cast("int")).alias("date"), at("q.open").alias("open_price"), at("q.high").alias("high_price"),
        at("q.low").alias("low_price"), close.alias("close_price"), F.coalesce(at("a.adjclose"), close).alias("adj_close"), volume.cast("int").alias("volume"),
    )
    return bars.filter("close_price IS NOT NULL AND close_price <> 0")


def status(payloads: DataFrame, symbol: str = "symbol", body: str = "body", code: str | None = None) -> DataFrame:
    """symbol, status: OK, SYMBOL_NOT_FOUND (404, an error, no result or no timestamps), or PROVIDER_ERROR."""
    chart = F.from_json(F.col(body), PAYLOAD)["chart"]
    first = F.get(chart["result"], F.lit(0))
    missing = chart["error"].isNotNull() | first.isNull() | (F.coalesce(F.size(first["timestamp"]), F.lit(0)) <= 0)
    found = F.when(chart.isNull(), "PROVIDER_ERROR").when(missing, "SYMBOL_NOT_FOUND").otherwise("OK")
    if code is not None:
        found = F.when(F.col(code) == 404, "SYMBOL_NOT_FOUND").when(F.col(code) != 200, "PROVIDER_ERROR").otherwise(found)
    return payloads.select(F.col(symbol).alias("symbol"), found.alias("status"))


def latest_of(bars: DataFrame, today: str) -> DataFrame:
    """The last bar of each symbol within the seven days up to ``today``."""
    day = F.lit(today).cast("date")
    week = bars.filter(F.col("date").between(F.date_sub(day, 7), day))
    rest = [c for c in week.columns if c != "symbol"]
    return week.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("b")).select("symbol", "b.*")


class PayloadFiles:
    """A connector over files of payloads: Parquet with the provider's ticker (or the symbol itself) and body, one row a symbol."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _payloads(self, symbols: DataFrame) -> DataFrame:
        """Payloads of the symbols, by the provider's names of them where the files and the symbols' exchanges are known."""
        rows = self.spark.read.parquet(self.path)
        if "ticker" not in rows.columns:
            return rows.join(symbols.select("symbol"), "symbol", "left_semi")
        named = symbols.select("symbol", ticker(F.col("symbol"), F.col("exchange") if "exchange" in symbols.columns else F.lit("NSE")).alias("ticker"))
        return rows.select("ticker", "body").join(named, "ticker")

    def historical(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        return parse(self._payloads(symbols)).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    def latest(self, symbols: DataFrame, today: str) -> DataFrame:
        return latest_of(parse(self._payloads(symbols)), today)

    def healthy(self, symbols: DataFrame, today: str) -> bool:
        return not self.latest(symbols, today).isEmpty()
