"""Daily bars: views of the test tables as bars, lookups, and the latest bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ohlc(rows: DataFrame, price: Column, order: Column, volume: Column) -> DataFrame:
    """Bars of one symbol and date from single trades, first and last by ``order``; one aggregation, summed up before its shuffle."""
    return rows.groupBy("symbol", "date").agg(
        F.min_by(price, order).alias("open_price"), F.max(price).alias("high_price"), F.min(price).alias("low_price"),
        F.max_by(price, order).alias("close_price"), F.max_by(price, order).alias("adj_close"), volume.cast("int").alias("volume"),
    )


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments by brand: unit price, quantity as volume.  Rows with equal order keys have equal prices."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))
    rows = item.join(part, item["l_partkey"] == part["p_partkey"])
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _ohlc(rows, F.try_divide("l_extendedprice", "l_quantity"), order, F.sum("l_quantity"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day: value as price, their number as volume."""
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("date").alias("date"), "event_id", "value")
    return _ohlc(rows, F.col("value"), F.col("event_id"), F.count(F.lit(1)))


def bars_etype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour; ``date`` is the hour."""
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("date"), "event_id", "value")
    return _ohlc(rows, F.col("value"), F.col("event_id"), F.count(F.lit(1)))


def history(bars: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a symbol (or all) between two dates, both among them; those of one symbol in order of their dates.  The filters reach the scan of a bars table."""
    out = bars
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out if symbol is None else out.orderBy("date")


def on_date(bars: DataFrame, date: str) -> DataFrame:
    return bars.filter(F.col("date") == F.lit(date).cast("date"))


def point(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """The bars of given (symbol, date) pairs: none or one each."""
    return bars.join(keys.select("symbol", "date").distinct(), ["symbol", "date"])


def existing(keys: DataFrame, bars: DataFrame) -> DataFrame:
    """Those of the (symbol, date) pairs that have a bar."""
    return keys.join(bars.select("symbol", "date"), ["symbol", "date"], "left_semi")


def latest_bar(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol, by an aggregation: no sort of its history."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("b")).select("symbol", "b.*")


def latest_date(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("latest_date"))


def top(table: DataFrame, count: int, date: str, *ties: str) -> DataFrame:
    """The ``count`` rows of the latest dates, ties by the named columns."""
    return table.orderBy(F.desc(date), *ties).limit(count)
