"""Payload files as a Spark data source: ``spark.read.format("quotes").option("path", folder).load()`` gives bars.

The files hold the provider's JSON documents, one for each symbol and year, by
ranges of symbols.  An index beside them names each file's symbols and dates;
filters on either choose files before any is opened, a partition for each file.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schemas import BARS
from .quotes import MOST_INT, latest_of

_PRICES = ("open", "high", "low", "close")
_ARROW = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *((f"{c}_price", pa.float64()) for c in _PRICES), ("adj_close", pa.float64()), ("volume", pa.int32())])


def write_payloads(bars: DataFrame, path: str, files: int | None = None) -> None:
    """Bars as payload files by ranges of symbols and years, and their index.  Bars without a symbol or date have no place there and are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("date", "open_price", "high_price", "low_price", "close_price", "adj_close", "volume")))
    each = bars.filter("symbol IS NOT NULL AND date IS NOT NULL").groupBy("symbol", F.year("date").alias("year")).agg(ordered.alias("b"), F.min("date").alias("first"), F.max("date").alias("last"))
    field = lambda name: F.transform("b", lambda x: x[name])
    seconds = F.transform("b", lambda x: F.datediff(x["date"], F.lit("1970-01-01").cast("date")).cast("long") * 86400)
    quote = F.struct(*[field(f"{c}_price").alias(c) for c in _PRICES], field("volume").alias("volume"))
    result = F.struct(seconds.alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(field("adj_close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    rows = each.select("symbol", body.alias("body"), "first", "last", "year")
    dealt = rows.repartitionByRange("year", "symbol") if files is None else rows.repartitionByRange(files, "year", "symbol")
    dealt.sortWithinPartitions("year", "symbol").write.parquet(f"{path}/payloads")
    stored = bars.sparkSession.read.parquet(f"{path}/payloads")
    index = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("last_symbol"), F.min("first").cast("string").alias("date"), F.max("last").cast("string").alias("last_date"))
    index.coalesce(1).write.json(f"{path}/index")


@dataclass
class PayloadFile(InputPartition):
    """A file with the symbols and dates between which it lies."""

    file: str
    symbol: str
    last_symbol: str
    date: str
    last_date: str

    def may_hold(self, f: Filter) -> bool:
        name = f.attribute[0]
        low, high = (getattr(self, x) for x in (name, f"last_{name}"))
        if isinstance(f, In):
            return any(low <= str(v) <= high for v in f.value if v is not None)
        value = str(f.value)
        if isinstance(f, EqualTo):
            return low <= value <= high
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return high >= value
        return low <= value


def bars_of(symbol: str, body: str) -> list[tuple]:
    """The bars of one payload, by the same rules as ``quotes.parse``."""
    try:
        results = (json.loads(body).get("chart") or {}).get("result") or [{}]
    except (ValueError, AttributeError):
        return []
    one = results[0] or {}
    quote = ((one.get("indicators") or {}).get("quote") or [{}])[0] or {}
    adjusted = ((one.get("indicators") or {}).get("adjclose") or [{}])[0] or {}
    at = lambda xs, i: xs[i] if xs is not None and i < len(xs) else None
    out = []
    for i, second in enumerate(one.get("timestamp") or []):
        close = at(quote.get("close"), i)
        if not close:
            continue
        date = None if second is None else dt.date(1970, 1, 1) + dt.timedelta(days=second // 86400)
        volumes = quote.get("volume")
        volume = min(max(volumes[i] or 0, 0), MOST_INT) if volumes is not None and i < len(volumes) else None
        adj = at(adjusted.get("adjclose"), i)
        out.append((symbol, date, *(at(quote.get(c), i) for c in _PRICES), close if adj is None else adj, volume))
    return out


class PayloadReader(DataSourceReader):
    """Chooses files by symbol and date; Spark checks the filters on the rows, too."""

    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("symbol",), ("date",)):
                self.filters.append(f)
            yield f

    def partitions(self):
        system, folder = pafs.FileSystem.from_uri(self.path)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(f"{folder}/index")) if f.path.endswith(".json")]
        rows = [json.loads(line) for f in files for line in system.open_input_stream(f).read().decode().splitlines()]
        return [p for p in (PayloadFile(**r) for r in sorted(rows, key=lambda r: (r["symbol"], r["file"]))) if all(p.may_hold(f) for f in self.filters)]

    def read(self, partition):
        if not isinstance(partition, PayloadFile):  # no file is left
            return
        system, file = pafs.FileSystem.from_uri(partition.file)
        stored = pq.ParquetFile(system.open_input_file(file))
        for batch in stored.iter_batches(batch_size=256, columns=["symbol", "body"]):
            rows = [bar for symbol, body in zip(*batch.to_pydict().values(), strict=True) for bar in bars_of(symbol, body)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> StructType:
        return BARS

    def reader(self, schema: StructType) -> PayloadReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("the quotes source needs a path")
        return PayloadReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def register(spark: SparkSession) -> None:
    """Make the ``quotes`` format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)


class SourceConnector:
    """The connector over the data source: each call is a filtered read of it."""

    def __init__(self, spark: SparkSession, path: str):
        register(spark)
        self.spark, self.path = spark, path

    def historical(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        bars = self.spark.read.format("quotes").option("path", self.path).load()
        inside = bars.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
        return inside.join(symbols.select("symbol"), "symbol", "left_semi").select(*BARS.names)

    def latest(self, symbols: DataFrame, today: str) -> DataFrame:
        start = str(dt.date.fromisoformat(today) - dt.timedelta(days=7))
        return latest_of(self.historical(symbols, start, today), today)

    def healthy(self, symbols: DataFrame, today: str) -> bool:
        return not self.latest(symbols, today).isEmpty()
