"""A bars table laid out by symbol: windows and joins by symbol over it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_folder

#: Buckets of the table; as many tasks go through it at most.
BUCKETS = 64


def write_bars(bars: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``bars`` as the table ``name``, dealt by symbol and sorted by date within each bucket; one file a bucket.

    The rows are dealt once, here, by the same function as exchanges use, so
    later windows by symbol, and joins of two such tables by symbol, read
    buckets as they lie.  One symbol is in one bucket: histories too long
    for a task go by ``slices``.
    """
    dealt = bars.repartition(buckets, "symbol")
    dealt.write.bucketBy(buckets, "symbol").sortBy("symbol", "date").option("path", path).mode("overwrite").saveAsTable(name)
    return bars.sparkSession.table(name)


def temporary_bars(bars: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The same under a name and in a folder of its own."""
    name = f"bars_{uuid.uuid4().hex}"
    return write_bars(bars, name, work_folder(bars.sparkSession, name), buckets)


def point(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The bars of given (symbol, date) pairs: the keys are dealt to the buckets, the bars stay where they are."""
    return table.join(keys.select("symbol", "date").distinct(), ["symbol", "date"])


def keep_layout(spark: SparkSession) -> None:
    """Have Spark use buckets even where it would rather read files in larger pieces."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def latest(table: DataFrame) -> DataFrame:
    """The last bar of each symbol, within its bucket."""
    rest = [c for c in table.columns if c != "symbol"]
    return table.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("b")).select("symbol", "b.*")
