"""Exact top-k search by a vector-approximation file.

The approximation file is a written table of blocks of quantised vectors: one
byte a component, with a corner and a step for each vector.  Blocks of queries
meet blocks of cells by a join on a share number, so neither passes through the
driver.  From the cells each query gets bounds of all scores; whatever may be
among its k best goes on.  Exact vectors are then read by id in the order of
their bounds: first those with the best bounds, and, once these give the k-th
score, only those whose bound still reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width

#: Vectors of a block of cells and of a block of queries.
CELLS, QUERIES = 4096, 1024
_LONG = 2**63 - 1
#: Components are cut off here; a score of such a one is beyond 64 bits anyway, unless it meets a zero.
_FAR = 2.0**100


def whole(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    v = vector.cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(True))


def quantise(vectors: np.ndarray):
    """(cells of a byte, corners, steps): components lie from ``corner + step * cell`` to one step less one unit above it.  Steps are powers of two."""
    corner = vectors.min(axis=1, initial=np.inf) if vectors.shape[1] else np.zeros(len(vectors))
    span = (vectors.max(axis=1, initial=-np.inf) if vectors.shape[1] else corner) - corner
    step = np.exp2(np.maximum(0, np.ceil(np.log2((span + 1) / 256))))
    cells = np.clip(np.floor((vectors - corner[:, None]) / step[:, None]), 0, 255).astype(np.uint8)
    return cells, corner, step


def bounds(queries: np.ndarray, cells: np.ndarray, corner: np.ndarray, step: np.ndarray):
    """(lower, upper) bounds of all scores, queries by rows; slack covers the rounding of floating point."""
    base = (queries @ cells.T.astype(np.float64)) * step + np.outer(queries.sum(axis=1), corner)
    wide = np.maximum(step - 1, step * 1e-12)
    reach = np.abs(corner) + 256 * step
    slack = np.outer(np.abs(queries).sum(axis=1), reach) * 1e-14
    slack[slack < 0.25] = 0.0  # sums of whole numbers below 2**50 are exact
    return base + np.outer(np.minimum(queries, 0).sum(axis=1), wide) - slack, base + np.outer(np.maximum(queries, 0).sum(axis=1), wide) + slack


def score(a: np.ndarray, b: np.ndarray) -> int:
    """The integer inner product; one beyond 64 bits becomes the nearest that has 64."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a) < 2**52:
        return int(a @ b)
    return max(-_LONG - 1, min(_LONG, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


def _floored(column, n: int, scale: float) -> np.ndarray:
    """Vectors of n components as whole numbers in floating point."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -_FAR, _FAR)


def _block_rows(batch, most: int, scale: float):
    """(length, first row, rows) of vectors of one length, at most ``most`` together."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), most):
            taken = rows[at : at + most]
            part = batch.take(pa.array(taken))
            yield int(n), part.column(0).to_numpy(), _floored(part.column(1), int(n), scale)


def that_ties_can_reach(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (id, v), but of more than k + 1 equal vectors, which have equal scores, only those with the k + 1 smallest ids: ties go to these, and one may be a query's own."""
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    hot = cut(keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("h1", "h2"))
    if hot.isEmpty():
        return rows
    order = Window.partitionBy("h1", "h2").orderBy("id")
    first = keyed.select("id", "h1", "h2").join(hot, ["h1", "h2"]).withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k + 1)
    last = cut(first.groupBy("h1", "h2").agg(F.max("id").alias("last")))
    return keyed.join(last, ["h1", "h2"], "left").filter(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "v")


def approximation_file(rows: DataFrame, scale: float, size: int = CELLS) -> DataFrame:
    """Blocks of cells of ``rows`` (id, v): length, ids, cells, corners, steps, as a written table without any exact vector."""

    def approximate(batches):
        for batch in batches:
            for n, ids, v in _block_rows(batch, size, scale):
                yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, *quantise(v))]], names=["length", "ids", "cells", "corners", "steps"])

    return cut(rows.select("id", "v").mapInArrow(approximate, "length long, ids binary, cells binary, corners binary, steps binary"))


def query_blocks(asked: DataFrame, scale: float, size: int = QUERIES) -> DataFrame:
    """Blocks of queries (id, v): block, length, own ids, vectors."""

    def gather(batches):
        for batch in batches:
            for n, ids, v in _block_rows(batch, size, scale):
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["length", "own", "vectors"])

    return asked.select("id", "v").mapInArrow(gather, "length long, own binary, vectors binary").withColumn("block", F.monotonically_increasing_id())


def _best(held: tuple, ids: np.ndarray, low: np.ndarray, own: np.ndarray, k: int) -> tuple:
    """Ids and lower bounds of each query's k best lower bounds of different ids, so far and with a further block."""
    n = min(k * 4, len(ids))
    near = np.argpartition(low, len(ids) - n, axis=1)[:, len(ids) - n :]
    all_ids = np.concatenate([held[0], ids[near]], axis=1)
    all_low = np.concatenate([held[1], np.take_along_axis(low, near, axis=1)], axis=1)
    order = np.argsort(-all_low, axis=1, kind="stable")
    all_ids, all_low = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_low, order, axis=1)
    # only the first of an id counts: repeated rows must not raise the bound
    by_id = np.argsort(all_ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(all_ids, by_id, axis=1)
    again = np.zeros(all_ids.shape, bool)
    np.put_along_axis(again, by_id, np.concatenate([np.zeros((len(own), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1), axis=1)
    all_low = np.where(again | (all_ids == own[:, None]), -np.inf, all_low)
    order = np.argsort(-all_low, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_low, order, axis=1)


def scan_cells(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, low, high of all vectors that may be among a query's k best of the cells that a task scans.

    ``pairs`` holds a block of queries and a block of cells in each row.  A merge
    join gives the rows of a query block one after another; in any other order
    more goes on, but nothing is lost.
    """
    names = ["query_id", "vec_id", "low", "high"]

    def scan(batches):
        block, held, found, own = None, None, [], None

        def report():
            floor = held[1][:, -1]
            rows, ids, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            good = high >= floor[rows]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (own[rows[good]], ids[good], low[good].astype(np.float64), high[good].astype(np.float64))], names=names)

        for batch in batches:
            for i in range(len(batch)):
                b, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own_, vectors, ids, cells, corners, steps = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in zip(range(2, 8), (np.int64, np.float64, np.int64, np.uint8, np.float64, np.float64), strict=True))
                if b != block:
                    if block is not None:
                        yield report()
                    block, own, found = b, own_, []
                    held = (np.zeros((len(own), k), np.int64), np.full((len(own), k), -np.inf))
                low, high = bounds(vectors.reshape(-1, n), cells.reshape(-1, n), corners, steps)
                held = _best(held, ids, low, own, k)
                rows, cols = np.nonzero((high >= held[1][:, -1:]) & (ids != own[:, None]))
                found.append((rows, ids[cols], low[rows, cols], high[rows, cols]))
        if block is not None:
            yield report()

    return pairs.select("block", "length", "own", "vectors", "ids", "cells", "corners", "steps").mapInArrow(scan, "query_id long, vec_id long, low double, high double")


def _exact(candidates: DataFrame, rows: DataFrame, asked: DataFrame, scale: float) -> DataFrame:
    """query_id, vec_id, score of candidates, from the exact vectors."""

    def rate(batches):
        for batch in batches:
            scores = [score(*(_floored(c.slice(i, 1), len(c[i]), scale)[0] for c in batch.columns[2:])) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    right, left = rows.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    both = candidates.join(right, "vec_id").join(left, "query_id").filter(F.size("x") == F.size("q"))
    return both.select("query_id", "vec_id", "x", "q").mapInArrow(rate, "query_id long, vec_id long, score long").distinct()


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, cells: int = CELLS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    Components become floor(scale * x).  Rows with a null id, a null vector,
    or a null or non-finite component take no part; vectors of another length
    than a query's aren't its candidates; equal rows count once.  The query's
    own id is no candidate.  A score beyond 64 bits is given as the nearest
    number that has 64, components beyond 2**100 count as that.  An empty
    table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & whole(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    asked = rows.filter("is_query").select("id", "v").distinct()
    # Every share has all query blocks and its part of the cells; each task scans a share.
    shares = shuffle_width(spark)
    file = approximation_file(that_ties_can_reach(rows.select("id", "v"), k), float(scale), cells).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    asked_blocks = cut(query_blocks(asked.coalesce(max(1, shares // 8)), float(scale), queries)).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    pairs = asked_blocks.join(file.hint("merge"), ["share", "length"])
    found = scan_cells(pairs, k).groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    candidates = cut(found)
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    floor = candidates.withColumn("r", F.row_number().over(by_low)).filter(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("floor"))
    near = candidates.join(floor, "query_id").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    by_high = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    # In the order of their bounds: the best first, the others only where they can still reach the k-th score of these.
    turn = cut(near.withColumn("turn", F.row_number().over(by_high)).select("query_id", "vec_id", "high", "turn"))
    first = cut(_exact(turn.filter(F.col("turn") <= 2 * k).select("query_id", "vec_id"), rows, asked, float(scale)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    left = turn.filter(F.col("turn") > 2 * k).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth").cast("double")))
    scores = first.unionByName(_exact(left.select("query_id", "vec_id"), rows, asked, float(scale)))
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH e AS (SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
