"""Whitening of embeddings by a bit-sliced scatter matrix.

Components become whole numbers.  A task takes a block of rows, subtracts each
dimension's least value and packs every bit plane of every dimension, row by
row, into 64-bit words.  The number of rows whose bits a of dimension i and b
of dimension j are both set is the popcount of an AND; weighted by 2**(a + b)
these counts are the exact cross-products.  Sums of tasks are added by Spark as
limbs of 32 bits, so no rounding and no overflow happens before the eigenvectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import whole

#: Rows of a block, whose bit planes are in memory together.
BLOCK = 16_384
#: Most dimensions: the driver gets one cell for each pair of them.
MOST_DIMENSIONS = 2048
#: Whole numbers are cut off at this size.
_FAR = 2**62
_LIMBS = 6
_MASK = 2**32 - 1


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, sums of the whole numbers, unit eigenvectors by columns, eigenvalues by falling size, and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def whole_numbers(column: pa.ListArray, dimensions: int, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of vectors of equal length, as int64; what is beyond 2**62 is cut off there."""
    with np.errstate(over="ignore"):
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions) * scale)
    return np.clip(x, -float(_FAR), float(_FAR)).astype(np.int64) + np.int64(shift)


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """(bits, dimensions, words) of uint64: word w of plane a of dimension j has bit a of y[64 * w :, j], a bit for each row."""
    rows, dimensions = y.shape
    words = -(-rows // 64)
    planes = np.zeros((bits, dimensions, words * 8), np.uint8)
    for a in range(bits):
        packed = np.packbits(((y >> np.uint64(a)) & np.uint64(1)).astype(np.uint8), axis=0)
        planes[a, :, : len(packed)] = packed.T
    return planes.view(np.uint64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, upper triangle of the cross-products) of int64 rows, exact, as arrays of Python's whole numbers."""
    rows, dimensions = x.shape
    low = x.min(axis=0)
    y = (x - low).view(np.uint64)  # a difference of up to 64 bits
    bits = max(1, int(y.max()).bit_length())
    planes = bit_planes(y, bits)
    small = 2 * bits + rows.bit_length() < 62
    weight = np.array([1 << b for b in range(bits)], object)
    weight = weight.astype(np.int64) if small else weight
    shifted = np.zeros((dimensions, dimensions), np.int64 if small else object)
    for i in range(dimensions):
        for a in range(bits):
            both = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(axis=2, dtype=np.int64)
            shifted[i, i:] += weight[a] * (weight @ (both if small else both.astype(object)))
    # the ones of each plane give the sums, the diagonal of x's own shift the rest
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(object)
    total = weight.astype(object) @ ones
    base = low.astype(object)
    products = shifted.astype(object) + np.outer(base, total) + np.outer(total, base) + rows * np.outer(base, base)
    return total + rows * base, products


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v: rows whose vector is whole and has components."""
    return vectors.filter(whole(F.col(vector)) & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def scatter(rows: DataFrame, dimensions: int, scale: float, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of vectors of one length; exact.  The driver gets a row for each pair of dimensions."""

    def sums(batches):
        n, totals, products = 0, np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = whole_numbers(batch.column(0).slice(at, BLOCK), dimensions, scale, shift)
                s, p = cross_products(x)
                n, totals, products = n + len(x), totals + s, products + p
        if n:
            cells = [(-1, -1, n), *((i, -1, totals[i]) for i in range(dimensions)), *((i, j, products[i, j]) for i in range(dimensions) for j in range(i, dimensions))]
            i, j, value = zip(*cells, strict=True)
            limbs = [[int(v) >> (32 * k) & _MASK if k < _LIMBS - 1 else int(v) >> (32 * k) for v in value] for k in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], names=["i", "j", *(f"l{k}" for k in range(_LIMBS))])

    parts = rows.select("v").mapInArrow(sums, "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS)))
    n, totals, products = 0, [0] * dimensions, [[0] * dimensions for _ in range(dimensions)]
    for r in parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]).collect():
        value = sum(r[f"l{k}"] << (32 * k) for k in range(_LIMBS))
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            totals[r["i"]] = value
        else:
            products[r["i"]][r["j"]] = products[r["j"]][r["i"]] = value
    return n, totals, products


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> Whitening:
    """Eigenvectors of the covariance (divisor n) of floor(scale * c) + shift over all usable rows.

    Rows whose vector is null, empty, or holds null or non-finite components
    take no part; of vectors of several lengths the commonest length is fitted
    (the longer one of equally common ones).  Repeated rows count each time.
    Without usable rows there are no components; directions in which nothing
    varies are left out.  More than 2048 dimensions are refused.
    """
    rows = _usable(vectors, id_col, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    d = lengths["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; {MOST_DIMENSIONS} are the most")
    n, sums, products = scatter(rows.filter(F.size("v") == d), d, float(scale), shift)
    # centred as whole numbers; each entry is rounded once, by the division
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    variances, components = np.linalg.eigh(covariance)
    order = np.argsort(-variances, kind="stable")
    variances, components = variances[order], components[:, order]
    varies = variances > max(float(variances[0]), 0.0) * d * np.finfo(float).eps
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    return Whitening(n, tuple(sums), components[:, varies], variances[varies], trace)


def _project(x: np.ndarray, model: Whitening, k: int) -> tuple[np.ndarray, list]:
    """(whitened values of the first k components, exact sums of squared n * x - S) of rows."""
    d, sums = x.shape[1], np.array(model.sums, object)
    reach = max(1, int(np.abs(x).max(initial=0))) * model.n + max(abs(s) for s in model.sums)
    if reach < 2**62:
        apart = x * np.int64(model.n) - sums.astype(np.int64)
        most = int(np.abs(apart).max(initial=0))
        squares = (apart * apart).sum(axis=1).tolist() if most * most * d < 2**63 else (apart.astype(object) ** 2).sum(axis=1).tolist()
    else:
        apart = x.astype(object) * model.n - sums
        squares = (apart**2).sum(axis=1).tolist()
    centred = apart.astype(float) / model.n
    return centred @ model.components[:, :k] / np.sqrt(model.variances[:k]), squares


def apply(vectors: DataFrame, model: Whitening, most: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component up to ``most``.

    ``deviation`` is the exact decimal sum of squared n * x - S, null beyond 38
    digits.  ``identity_error`` is the largest distance of the covariance of the
    returned values from the identity, measured over these rows.  Rows are
    usable as ``fit`` says; null ids stay null.
    """
    spark, d = vectors.sparkSession, len(model.sums)
    k = min(most, model.components.shape[1])
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], schema)
    rows = _usable(vectors, id_col, vector).filter(F.size("v") == d)
    scale = float(scale)

    def values(batch, column):
        for at in range(0, len(batch), BLOCK):
            yield at, whole_numbers(batch.column(column).slice(at, BLOCK), d, scale, shift)

    def moments(batches):
        whole_, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in values(batch, 0):
                z, _squares = _project(x, model, k)
                whole_, first, second = whole_ + len(z), first + z.sum(axis=0), second + z.T @ z
        yield pa.RecordBatch.from_pylist([{"n": whole_, "first": first.tolist(), "second": second.ravel().tolist()}])

    def whiten(batches):
        component = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            for at, x in values(batch, 1):
                z, squares = _project(x, model, k)
                ids = batch.column(0).slice(at, BLOCK).take(pa.array(np.repeat(np.arange(len(x)), k)))
                exact = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(component, len(x))), exact, pa.array(z.ravel())], names=["vec_id", "component", "deviation", "whitened"])

    # one small row for each task; their sums are one row
    parts = rows.select("v").mapInArrow(moments, "n long, first array<double>, second array<double>")
    cells = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("first")[i]).alias(f"f{i}") for i in range(k)], *[F.sum(F.col("second")[i]).alias(f"s{i}") for i in range(k * k)]).first()
    seen = cells["n"] or 0
    if not seen:
        return spark.createDataFrame([], schema)
    mean = np.array([cells[f"f{i}"] for i in range(k)]) / seen
    covariance = np.array([cells[f"s{i}"] for i in range(k * k)]).reshape(k, k) / seen - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances[:k]])
    out = rows.select("id", "v").mapInArrow(whiten, "vec_id long, component int, deviation decimal(38,0), whitened double")
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
