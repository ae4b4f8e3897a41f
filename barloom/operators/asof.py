"""As-of joins: each row with the latest earlier bar of its key, without a window over a whole key.

Rows of both sides are dealt together by ranges of (key, time), so a key of any
size spreads over as many tasks as it needs.  A task goes through its range in
order and carries the last bar on; only what stands before the first bar of a
range may belong to an earlier one.  The last bar of each range is one small row, and
these rows, carried on over ranges, serve what was left open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import work_folder

#: What the task that goes through a range says of a row: it is settled, it waits for an earlier range, or it is the range's last bar.
SETTLED, OPEN, EDGE = 0, 1, 2


def _carried(dealt: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """``dealt`` (_key, _bar, left columns, bar's columns) with each row's last bar before it in place of its own nulls, and _what.

    Rows come in order of (key, time).  ``_bar`` is true for a bar.
    """
    names = dealt.columns

    def carry(batches):
        key, held, first_key = None, None, None  # the present key, its last bar as arrays of one row, and the range's first key
        for batch in batches:
            if not len(batch):
                continue
            keys, is_bar = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            if first_key is None:
                first_key = keys[0]
            at = np.arange(len(batch))
            fresh = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(fresh, at, -1))  # -1: the key of the batch before goes on
            last = np.maximum.accumulate(np.where(is_bar, at, -1))
            own = last >= np.maximum(start, 0)
            from_held = ~own & (start < 0) & (held is not None)
            # a bar of this batch, the one held from before, or none
            bars = [batch.column(i) for i in range(2 + n_left, 2 + n_left + n_right)]
            source = np.where(own, last, np.where(from_held, len(batch), -1))
            taken = [pa.concat_arrays([c, h]) if held is not None else c for c, h in zip(bars, held or bars, strict=True)]
            index = pa.array(np.maximum(source, 0), mask=source < 0)
            filled = [c.take(index) for c in taken]
            # before the first bar of the range's first key, an earlier range may have one
            waits = (source < 0) & (keys == first_key) & ~is_bar
            what = pa.array(np.where(waits, OPEN, SETTLED).astype(np.int32))
            keep = pa.array(~is_bar)
            yield pa.RecordBatch.from_arrays([what.filter(keep), *[c.filter(keep) for c in (*batch.columns[: 2 + n_left], *filled)]], names=["_what", *names])
            if source[-1] >= 0:
                held = [c.take(pa.array([int(source[-1])])) for c in taken]
            elif fresh.any():
                held = None
            key, left_types = keys[-1], [c.type for c in batch.columns[: 2 + n_left]]
            bar_types = [c.type for c in bars]
        if key is not None:
            # the range's last key with its last bar; without one, the bars before go on through a key that fills the range
            through = key == first_key and held is None
            values = held or [pa.nulls(1, t) for t in bar_types]
            left = [pa.array([int(key)], pa.int64()), pa.array([not through]), *[pa.nulls(1, t) for t in left_types[2:]]]
            yield pa.RecordBatch.from_arrays([pa.array([EDGE], pa.int32()), *left, *values], names=["_what", *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(carry, f"_what int, {fields}")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, strict: bool = False, longest: Column | None = None, prefix: str = "", tasks: int | None = None) -> DataFrame:
    """``left`` with the columns of the latest row of ``right`` of the same ``by`` columns and no later time (earlier, if ``strict``); nulls where there is none.

    ``right``'s columns other than ``by`` are appended, with ``prefix``; they
    must not clash with ``left``'s.  Of several rows of ``right`` with one key
    and time one is taken, always the same.  Null keys and times match nothing;
    such rows of ``left`` stay.  With ``longest``, an interval, older rows don't count.
    ``tasks`` is the number of ranges; the session's shuffle partitions otherwise.
    """
    spark = left.sparkSession
    extra = [c for c in right.columns if c not in by]
    clash = {f"{prefix}{c}" for c in extra} & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    kinds = dict(left.dtypes)
    names, bars = [f"_l{i}" for i in range(len(left.columns))], [f"_r{i}" for i in range(len(extra))]
    rank = 0 if not strict else 2  # bars stand before rows of the same time, or after
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    null = lambda kind: F.lit(None).cast(kind)
    time = lambda c: F.col(c).cast("timestamp_ntz") if kinds[left_time] != "timestamp" else F.col(c).cast("timestamp")
    rows = left.select(*[F.col(c).cast(kinds[c]).alias(f"_by{i}") for i, c in enumerate(by)], time(left_time).alias("_time"), F.lit(1).alias("_rank"), F.lit(False).alias("_bar"), *[F.col(c).alias(n) for c, n in zip(left.columns, names, strict=True)], *[null(right.schema[c].dataType).alias(n) for c, n in zip(extra, bars, strict=True)])
    facts = right.filter(known & F.col(right_time).isNotNull()).select(*[F.col(c).cast(kinds[c]).alias(f"_by{i}") for i, c in enumerate(by)], time(right_time).alias("_time"), F.lit(rank).alias("_rank"), F.lit(True).alias("_bar"), *[null(left.schema[c].dataType).alias(n) for c, n in zip(left.columns, names, strict=True)], *[F.col(c).alias(n) for c, n in zip(extra, bars, strict=True)])
    both = rows.unionByName(facts)
    keys = [f"_by{i}" for i in range(len(by))]
    # rows of one key and instant spread, too
    both = both.withColumn("_key", F.xxhash64(*keys)).withColumn("_tie", F.xxhash64(*names, *bars))
    order = [*keys, "_time", "_rank", "_tie"]
    dealt = (both.repartitionByRange(*order) if tasks is None else both.repartitionByRange(tasks, *order)).sortWithinPartitions(*order)
    folder = work_folder(spark, "asof")
    carried = _carried(dealt.select("_key", "_bar", *names, *bars), len(names), len(bars)).withColumn("_range", F.spark_partition_id())
    carried.write.parquet(folder)
    stored = spark.read.schema(carried.schema).parquet(folder)
    # one row for each range: the last bar of its last key, carried on through ranges that hold nothing but rows of that key
    edges = stored.filter(F.col("_what") == EDGE)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.struct("_key", *bars)
    carry = edges.select("_range", F.last(F.when(F.col("_bar"), whole), ignorenulls=True).over(before).alias("_edge"))
    waiting = stored.filter(F.col("_what") == OPEN).join(F.broadcast(carry), "_range", "left")  # as many rows as there are tasks
    same = F.col("_edge._key") == F.col("_key")
    served = waiting.select(*names, *[F.when(same, F.col(f"_edge.{b}")).alias(b) for b in bars])
    done = stored.filter(F.col("_what") == SETTLED).select(*names, *bars).unionByName(served)
    out = done.select(*[F.col(n).alias(c) for n, c in zip(names, left.columns, strict=True)], *[F.col(b).alias(f"{prefix}{c}") for b, c in zip(bars, extra, strict=True)])
    if longest is not None:
        at = f"{prefix}{right_time}"
        fits = F.col(at) >= F.col(left_time) - longest
        out = out.withColumns({f"{prefix}{c}": F.when(fits, F.col(f"{prefix}{c}")) for c in extra if c != right_time} | ({at: F.when(fits, F.col(at))} if right_time in extra else {}))
    return out
