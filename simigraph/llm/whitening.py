"""Operator 13: whitening of vectors, by moments that merge in pairs.

Entries become whole numbers first: x = floor(SCALE * c) + OFFSET. Each partition
computes the count, the mean and the centred scatter of its vectors, block by
block, and Chan's formula merges two such moments into one; ``treeReduce`` merges
those of all partitions, so the driver meets about the square root of their
number. The covariance is the scatter over the count. Its eigenvectors come from
``eigh`` on the driver: a matrix of the vectors' length squared, whatever the
number of rows. Exact sums of the whole numbers travel along, for the deviations.

A second pass whitens the vectors, merges their moments the same way, and
compares their covariance with the identity. Nothing is shuffled by a key, so
copies and frequent labels burden no task, and a lost executor's partitions are
simply computed again.

Rows are left out whose vector is null, or has a null, a NaN or an infinity.
Vectors must have one length: where they differ, those of the most frequent one
(ties: the longest) are fitted and returned. Null ids and repeated rows are rows
like others. Components without variance (there are some wherever the rows are
fewer than the dimensions, or equal) are given too: their whitened values and
their share are 0, and they don't enter the identity error. A deviation that a
long can't hold is null. An entry whose whole number is beyond 2^62 counts as
that. An empty table, or one without a usable vector, gives no rows. Only the
two named columns are read, so others may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers end here, so that sums of their halves fit.
MOST = 1 << 62
#: Variances below this part of the largest, for each dimension, are rounding.
ROUNDING = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred scatter; exact sums where the values are whole."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: tuple[int, ...]


def moments(values: np.ndarray) -> Moments:
    """Of one block of rows."""
    mean = values.mean(axis=0, dtype=np.float64)
    centred = values - mean
    mean = mean + (fix := centred.mean(axis=0))  # what rounding left in the mean
    centred -= fix
    sums: tuple[int, ...] = ()
    if values.dtype == np.int64:
        high, low = (values >> 32).sum(axis=0), (values & 0xFFFFFFFF).sum(axis=0)
        sums = tuple((int(h) << 32) + int(s) for h, s in zip(high, low, strict=True))
    return Moments(len(values), mean, centred.T @ centred, sums)


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's formula for two groups of rows."""
    if a is None or b is None:
        return b if a is None else a
    n, apart = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n * (b.n / n))
    return Moments(n, a.mean + apart * (b.n / n), scatter, tuple(x + y for x, y in zip(a.sums, b.sums, strict=True)))


def whole(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of whole numbers from the entries of all vectors."""
    scaled = np.clip(np.floor(flat * float(SCALE)), -float(MOST), float(MOST))
    return np.minimum(scaled.astype(np.int64).reshape(-1, size), MOST - OFFSET) + OFFSET


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found; components by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if v > 0 else 0.0 for v in self.variances]

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened rows, and each row's sum of (n * x - sums)^2, which stays exact."""
        n, sums = self.n, np.array(self.sums, dtype=object)
        fits = n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in self.sums) < 1 << 62
        far = n * x - sums.astype(np.int64) if fits else n * x.astype(object) - sums
        most = max(int(far.max()), -int(far.min()))
        if most * most * len(sums) < 1 << 63:
            deviations = (far * far).sum(axis=1).tolist()
        else:
            far = far.astype(object)
            deviations = [d if d < 1 << 63 else None for d in (far * far).sum(axis=1).tolist()]
        scale = np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1)), 0)
        return (far.astype(np.float64) / n) @ self.components * scale, deviations


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite; not empty."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _reduced(vectors: DataFrame, size: int, rows: Callable[[np.ndarray], np.ndarray]) -> Moments | None:
    """Moments of ``rows`` of all whole-number vectors; a partition's state is one moment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                found = merge(found, moments(rows(whole(b.column(0).flatten().to_numpy(zero_copy_only=False), size))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["state"])

    states = vectors.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    nothing = vectors.sparkSession.sparkContext.parallelize([None], 1)
    return states.union(nothing).treeReduce(merge)


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """From a table whose only column has arrays of ``size`` doubles; none without rows."""
    found = _reduced(vectors, size, lambda x: x)
    if found is None:
        return None
    covariance = found.scatter / found.n
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, size)]
    trace = float(np.trace(covariance))
    values = np.where(values > ROUNDING * size * max(values[-1], 0.0), values, 0.0)
    columns = columns[:, order]
    columns = columns * np.where(columns[np.abs(columns).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
    return Whitening(found.n, found.sums, columns, values[order], trace)


def identity_error(vectors: DataFrame, size: int, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from a pass over all rows."""
    found = _reduced(vectors, size, lambda x: model.apply(x)[0])
    known = model.variances > 0
    if not known.any():
        return 0.0
    return float(np.abs(found.scatter / found.n - np.eye(len(known)))[known][:, known].max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays by component), identity_error."""
    common.ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = usual["size"]
    rows = rows.where(F.size("vector") == size)
    model = fit(rows.select("vector"), size, components)
    error = identity_error(rows.select("vector"), size, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out, deviations = model.apply(whole(b.column(1).flatten().to_numpy(zero_copy_only=False), size))
            wide = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations, pa.int64()), wide], ["vec_id", "deviation", "whitened"])

    done = rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")
    return done.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, model.explained)).alias("explained"), F.lit(error).alias("identity_error"))
