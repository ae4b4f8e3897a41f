"""Append-only sinks: what a natural key holds already isn't written again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .manifest import Table

KEYS = {
    "stock_prices": ["symbol", "date"],
    "scan_results": ["symbol", "scan_date", "rule_name"],
    "signal_outcomes": ["symbol", "scan_date", "rule_name", "horizon_days"],
}


def append(rows: DataFrame, path: str | Table, keys: list[str], partition_by: str | None = None) -> int:
    """Append the rows whose key isn't stored yet and return how many there were.  Writing the same rows twice changes nothing.

    A plain folder is for one writer at a time; a ``Table`` takes several.

    Of the stored rows only those between the first and last date of the new
    ones are read: each append holds a few days, so the files' own statistics
    (or the partitions, if the table has any by date) leave out the others.
    Null keys are keys of their own and stored each time.
    """
    if isinstance(path, Table):
        return path.append(rows)
    once = rows.dropDuplicates(keys).persist()
    fresh = once
    try:
        date = keys[1]
        first, last, count = once.agg(F.min(date), F.max(date), F.count(F.lit(1))).first()
        if not count:
            return 0
        try:
            stored = rows.sparkSession.read.parquet(path).filter(F.col(date).between(F.lit(first), F.lit(last)))
            # what is read and what is written are one table, so the result is fixed first
            fresh = once.join(stored.select(*keys), keys, "left_anti").persist()
            count = fresh.count()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        if count:
            writer = fresh.write.mode("append")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return count
    finally:
        fresh.unpersist()
        once.unpersist()
