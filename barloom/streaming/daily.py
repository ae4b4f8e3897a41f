"""Daily increments as a stream of files: each batch of bars is deduplicated, checked if asked for, and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.quality import accepted
from ..schemas import BARS
from ..sources.manifest import Table
from ..sources.sink import KEYS, append


def ingest_available(spark: SparkSession, incoming: str, bars: str | Table, checkpoint: str, max_spike: float | None = None) -> StreamingQuery:
    """Append the bars of all files that have come since the last run, and stop; with ``max_spike`` without symbols that have errors.  Files are taken once; a bar stored already isn't stored again."""

    def store(batch: DataFrame, _: int) -> None:
        if max_spike is None:
            append(batch, bars, KEYS["stock_prices"])
            return
        if isinstance(bars, Table):
            append(accepted(batch, bars.read(), max_spike), bars, KEYS["stock_prices"])
            return
        try:
            stored = spark.read.schema(BARS).parquet(bars)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], BARS)
        append(accepted(batch, stored, max_spike), bars, KEYS["stock_prices"])

    stream = spark.readStream.schema(BARS).parquet(incoming)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
