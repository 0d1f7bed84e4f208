"""Embedding whitening from a bit-sliced scatter matrix.

1. Entries c become the whole numbers floor(256 * c); the fit list holds each
   distinct vector of them once and is written.
2. Bit planes: every entry, less the smallest of all, is written in binary.  For
   a dimension and a bit the bits of 64 rows stand in one word.  The number of
   set bits of two planes' AND, weighted by the powers of two of both, adds up
   to the exact cross-product of two dimensions.  One more dimension, which is 1
   in every row, gives the sums and the number of rows by the same counts.
   A task keeps counts for each pair of dimensions and power of two, whatever
   the number of its rows.
3. The covariance is centred as whole numbers of any length,
   n * sum(xy) - sum(x) * sum(y), before it becomes floating point and ``eigh``
   takes it apart.  So no digit is lost to large means.
4. All rows are projected in blocks; a second pass over the fit list measures
   how far the covariance of the whitened values is from the identity.

* rows whose vector is null or holds a null, NaN or infinite entry are left out;
  every other row, also with a null or repeated id, gives a row for each
  component, so repeated rows repeat;
* entries beyond the range of a long stop at its ends;
* a vector shorter than the longest counts as zero beyond its end;
* components without variance (fewer vectors than dimensions, constant ones)
  have a null ``whitened`` and take no part in ``identity_error``, which is null
  where no component has any; ``explained`` is null where nothing varies;
* of equal eigenvalues either order may come; an eigenvector's largest entry is
  positive;
* ``deviation`` is null where it is beyond the range of a long;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import cut

SCALE = 256.0
COMPONENTS = 4


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def whole(vector: Column) -> Column:
    """A vector's entries as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))


def padded(x: Column, size: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The rows of an Arrow batch as an array of longs; all have ``size`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def bit_planes(x: np.ndarray, low: int, planes: int) -> np.ndarray:
    """(dimension, bit, word): the bits of each dimension's entries less ``low``,
    64 rows a word.  The last dimension is 1 in every row."""
    n, d = x.shape
    shifted = x.astype(np.uint64) - np.uint64(low % (1 << 64))
    used = -(-n // 8)
    packed = np.zeros((d + 1, planes, -(-n // 64) * 8), np.uint8)
    for p in range(planes):
        packed[:d, p, :used] = np.packbits((shifted >> np.uint64(p)).astype(np.uint8).T & 1, axis=1)
    packed[d, 0, :used] = np.packbits(np.ones(n, np.uint8))
    return packed.view(np.uint64)


def pair_counts(bits: np.ndarray) -> np.ndarray:
    """(i, j, power): set bits of the ANDs of planes p of i and q of j, p + q
    being the power; filled for j >= i."""
    dims, planes, words = bits.shape
    flat = bits.reshape(dims * planes, words)
    out = np.zeros((dims, dims, 2 * planes - 1), np.int64)
    for i in range(dims):
        rest = flat[i * planes :]
        for p in range(planes):
            set_bits = np.bitwise_count(flat[i * planes + p] & rest).sum(axis=1, dtype=np.int64)
            out[i, i:, p : p + planes] += set_bits.reshape(-1, planes)
    return out


def _counted(fit: DataFrame, size: int, low: int, planes: int) -> DataFrame:
    """i, j, c0 .. c<2 * planes - 2>: a task's counts summed over all tasks."""
    powers = range(2 * planes - 1)
    schema = StructType.fromDDL("i int, j int, " + ", ".join(f"c{k} long" for k in powers))
    out_schema = to_arrow_schema(schema)
    left, right = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                counts = pair_counts(bit_planes(matrix(batch.column(0), size), low, planes))
                total = counts if total is None else total + counts
        if total is not None:
            values = total[left, right]
            columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *(pa.array(values[:, k]) for k in powers)]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in powers))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; its size depends on the number of dimensions alone."""

    n: int
    sums: tuple[int, ...]
    reach: int  #: no n * x - S is larger
    axes: np.ndarray  #: unit eigenvectors as columns
    variances: np.ndarray  #: their eigenvalues, falling
    trace: float

    @property
    def varying(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.variances > self.trace * len(self.sums) * np.finfo(float).eps

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where their squares add up in a long, else Python's whole numbers."""
        kind = np.int64 if max(1, len(self.sums)) * self.reach**2 < 1 << 63 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, gaps: np.ndarray) -> np.ndarray:
        """Whitened values, a column for each component; 0 without variance."""
        scale = np.where(self.varying, 1 / np.sqrt(np.where(self.varying, self.variances, 1)), 0)
        return (gaps / self.n).astype(float) @ (self.axes * scale)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a written fit list with longs ``x`` of one length; None for an empty one."""
    bounds = fit.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.max(F.size("x"))).first()
    low, high, size = bounds
    if not size:
        return None
    planes = max(1, (high - low).bit_length())
    sums: dict[tuple[int, int], int] = {}
    for i, j, *counts in _counted(fit, size, low, planes).collect():  # (size + 1) ** 2 / 2 rows
        sums[i, j] = sum(int(c) << k for k, c in enumerate(counts))
    n = sums[size, size]
    shifted = [sums[i, size] for i in range(size)]
    covariance = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            covariance[i, j] = covariance[j, i] = (n * sums[i, j] - shifted[i] * shifted[j]) / (n * n)
    trace = sum(n * sums[i, i] - shifted[i] ** 2 for i in range(size)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    vectors = vectors * np.where(largest < 0, -1, 1)
    return Whitening(n, tuple(s + n * low for s in shifted), n * (high - low), vectors, values, trace)


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity."""
    at = np.flatnonzero(model.varying).tolist()
    if not at:
        return None
    size = len(model.sums)
    schema = StructType.fromDDL(", ".join(f"z{k} double" for k in at))
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.project(model.gaps(matrix(batch.column(0), size)))
            yield pa.RecordBatch.from_arrays([pa.array(z[:, k]) for k in at], schema=out_schema)

    pairs = [(a, b) for a in at for b in at if a <= b]
    found = fit.select("x").mapInArrow(run, schema).agg(*(F.covar_pop(f"z{a}", f"z{b}") for a, b in pairs)).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, found))


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``vec_id``, component, n, deviation, whitened, explained, identity_error:
    a row for each usable row and component."""
    kept = rows.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), whole(F.col(vector)).alias("x"))
    fit = cut(kept.select("x").distinct(), "fit-list")
    least, size = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != size:
        kept = kept.withColumn("x", padded(F.col("x"), size))
        fit = cut(fit.select(padded(F.col("x"), size).alias("x")).distinct(), "fit-list")
    added = StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    schema = StructType([kept.schema["vec_id"], *added])
    model = fitted(fit, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, model)
    count = len(model.variances)
    out_schema = to_arrow_schema(schema)
    varying = model.varying.tolist()
    explained = [float(v) / model.trace if model.trace else None for v in np.maximum(model.variances, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            gaps = model.gaps(matrix(batch.column(1), size))
            deviation = [v if v < 1 << 63 else None for v in (gaps * gaps).sum(axis=1).tolist()]
            z = model.project(gaps).ravel()
            of = np.repeat(np.arange(m), count)
            columns = [
                batch.column(0).take(pa.array(of)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, model.n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(of)),
                pa.array(z, mask=np.tile(~np.array(varying), m)),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * count), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return kept.mapInArrow(run, schema)
