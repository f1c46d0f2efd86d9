"""Connected components of matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph import store


def forest(edges: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """Edges with the same components: of each task's, those between nodes that its earlier ones don't connect, so fewer than its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            kept = []
            for i, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if u is not None and v is not None and (u := top(u)) != (v := top(v)):
                    above[max(u, v)] = min(u, v)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    both = edges.select(a, b)
    store.ship(both.sparkSession)
    return both.mapInArrow(run, both.schema)


def components(edges: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """node and component (its smallest node), by alternating large and small stars.

    Edges go to the shared folder after each step; minima are summed up before
    shuffling and joined back, so a hub in most edges burdens no task. The
    number of rounds grows with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = store.materialise(pairs, "edges")
    before = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: neighbours above a node are linked to its least one.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store.materialise(large, "edges")
        low = store.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Small star: a node and its neighbours below are linked to the least of them.
        ends = F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m")))
        small = large.join(low, "u").select(ends.alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        new = store.materialise(small.where("u <> v").distinct(), "edges")
        store.discard(pairs, least, large, low)
        pairs = new
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
