"""Nearest vectors by cosine: block by block against all rows, or through an index of lists.

The index fits centroids on a sample, deals every row to the list of its nearest
one, and a search reads the ``probes`` lists nearest to each query; with all lists
probed it is exact. Recall is measured by ``recall``. Lists with very many rows are
dealt to several tasks, so a common vector burdens none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simigraph import store
from simigraph.functions.matchers import norm

#: Queries of a block and rows of a chunk that meet in one task; rows that centroids are fitted on, at most about.
QUERY_BLOCK, ROW_CHUNK, SAMPLE = 1000, 20_000, 20_000
MOST_LISTS = 4096


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, id and score of the best k; each task passes on at most k rows a query, as Spark limits ranks before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("_place", place).where(F.col("_place") <= k).select("query_id", "id", "score")


def _two_places(v: np.ndarray) -> np.ndarray:
    """As ``names.two_places``."""
    n = np.trunc((v - np.floor(v)) * 2.0**52).astype(np.int64) * 100
    whole, rest = n >> 52, n & ((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (whole % 2 == 1))
    return (np.floor(v) * 100 + (whole + up)) / 100.0


def _matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors side by side, filled up with zeros; their lengths, -1 of those with nulls; their norms."""
    norms = t.column("norm").fill_null(0.0).to_numpy()
    column = t.column("vector").combine_chunks()
    if len(column) and not column.null_count and pc.all(pc.equal(pc.list_value_length(column), width)).as_py() and not (flat := column.flatten()).null_count:
        return flat.to_numpy().reshape(-1, width), np.full(len(column), width), norms
    vectors = column.to_pylist()
    sizes = np.array([-1 if v is None or None in v else len(v) for v in vectors])
    out = np.zeros((len(vectors), width))
    for i in np.flatnonzero(sizes > 0):
        out[i, : sizes[i]] = vectors[i]
    return out, sizes, norms


#: Queries whose products with a chunk are in memory at a time.
_AT_ONCE = 100


def _best(rows: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query_id, id and score of the best k of (id, vector, norm) for the queries of the same keys, themselves left out.

    A matrix product finds who may be among the best; these are added up entry by
    entry, as ``matchers.cosine_score`` does, so scores and ties are the same.
    """

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0 for t in (r, q))
        (v, n_v, norm_v), (w, n_w, norm_w) = _matrix(r, width), _matrix(q, width)
        ids, asked = (np.array(t.column("id").to_pylist(), dtype=None if t.num_rows else np.int64) for t in (r, q))
        with np.errstate(all="ignore"):
            for at in range(0, len(asked) if len(ids) else 0, _AT_ONCE):
                part = slice(at, at + _AT_ONCE)
                lengths = norm_w[part, None] * norm_v
                none = (lengths == 0) | (n_w[part, None] != n_v) | (n_v < 0)
                score = lambda dot, of, no: np.where(no, 0.0, np.fmax(0.0, np.fmin(100.0, dot / of * 100)))
                near = score(w[part] @ v.T, lengths, none)
                near[asked[part, None] == ids] = -1.0
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.zeros(len(near))
                for i, row in enumerate(near):
                    some = np.flatnonzero((row >= 0) & (row >= least[i] - 0.0101))
                    dot = np.add.accumulate(w[at + i] * v[some], axis=1)[:, -1] if width else np.zeros(len(some))
                    exact = _two_places(score(dot, lengths[i, some], none[i, some]))
                    best = np.lexsort((ids[some], -exact))[:k]
                    found.append((np.full(len(best), at + i), some[best], exact[best]))
        places = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.array([], kind)
        taken = [q.column("id").take(pa.array(places(0, np.int64), pa.int64())), r.column("id").take(pa.array(places(1, np.int64), pa.int64())), pa.array(places(2, np.float64), pa.float64())]
        return pa.table(taken, ["query_id", "id", "score"])

    store.ship(rows.sparkSession)
    kind = lambda df: df.schema["id"].dataType.simpleString()
    met = rows.select(*keys, "id", "vector", "norm").groupBy(*keys).cogroup(queries.select(*keys, "id", "vector", "norm").groupBy(*keys))
    return _ranked(met.applyInArrow(run, f"query_id {kind(queries)}, id {kind(rows)}, score double"), k)


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of all (id, vector) for each query, itself left out. Tasks grow in number with both sides, not in size."""
    chunks, blocks = -(-rows.count() // ROW_CHUNK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    plain = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector"), norm(F.col("vector")).alias("norm"))
    q = plain(queries).select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), every(chunks).alias("chunk"))
    r = plain(rows).select("*", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), every(blocks).alias("block"))
    return _best(r, q, ["chunk", "block"], k)


@dataclass
class Index:
    """Centroids of unit length, and a table of (list, chunk, id, vector, norm)."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: DataFrame


def _lists(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """The rows with the ``probes`` nearest lists of each, from a column ``vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(b.schema.get_field_index("vector")).to_pylist(), np.float64)
            likeness = v @ centroids.T
            best = np.argsort(-likeness, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "lists"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, lists array<int>")


def build_index(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """Of (id, vector), by default with about the square root of the rows as lists."""
    spark = rows.sparkSession
    store.ship(spark)
    whole = rows.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"), norm(F.col("vector")).alias("norm"))
    n = whole.count()
    lists = min(lists or round(n**0.5) or 1, MOST_LISTS)
    some = whole if n <= sample else whole.where(F.pmod(F.xxhash64("id"), F.lit(n)) < sample)
    unit = some.where("norm > 0").select(array_to_vector(F.transform("vector", lambda x: x / F.col("norm"))).alias("features"))
    if unit.isEmpty():
        centroids = np.zeros((1, len(whole.first()["vector"]) if n else 1))
    else:
        found = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(unit)
        centroids = np.array(found.clusterCenters())
    dealt = store.materialise(_lists(whole, centroids, 1).select(F.get("lists", F.lit(0)).alias("list"), "id", "vector", "norm"), "lists")
    # As many rows as lists.
    sizes = store.materialise(dealt.groupBy("list").agg(F.ceil(F.count("*") / ROW_CHUNK).alias("chunks")), "sizes")
    return Index(centroids, dealt.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks"), sizes)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """query_id, id and score of the best k of the probed lists for each of (id, vector), itself left out."""
    q = queries.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"), norm(F.col("vector")).alias("norm"))
    blocks = -(-q.count() // (10 * QUERY_BLOCK)) or 1
    probed = _lists(q, index.centroids, probes).select("id", "vector", "norm", F.explode("lists").alias("list"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    probed = probed.join(F.broadcast(index.sizes), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return _best(rows, probed, ["list", "chunk", "block"], k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found."""
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
