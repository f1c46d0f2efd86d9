"""Operator 5: near-duplicates by SimHash, with an index of byte positions and a count filter.

Fingerprints that differ in at most DISTANCE bits differ in at most DISTANCE of
their eight bytes, so they share eight less DISTANCE bytes at their positions:
the guaranteed number of matches. The inverted index lists distinct fingerprints
by positional bytes, four at a time: FAMILY holds sets of four positions such
that any five positions contain one, so pairs with the guaranteed number always
meet in a list. Of the pairs that meet, the shared positional bytes are tallied;
only pairs that reach the guaranteed number are kept, and only these are
verified by their differing bits. Larger distances than DISTANCE are refused, as
pairs would be lost.

Equal fingerprints count once. A list of one entry is dropped. A list longer than
BLOCK is replaced by lists of one positional byte more: a pair with the guaranteed
number shares a fifth byte beside the four of its list, so it meets in one of the
four places left, and an entry is copied four times instead of once for each block.
What is still longer than BLOCK is dealt to pairs of blocks by a hash, so no task
sees more than two blocks at once. Each list or block returns the links
of a spanning forest (pairs already joined in it are not repeated), so a group
of copies gives about as many links as members. Components are found by
alternating large and small stars between tables in the shared folder.

Null texts are empty; texts without words have fingerprint zero and are linked
like any other. Very long texts are read whole, their bits summed up in slices.
Documents with one id keep a row each. Null ids stay null and have no say in
component_id, which is null only if all ids of a component are. An empty table
gives an empty result. Only the two named columns are read, so others may have
any name; ``keep_one`` keeps them all.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.operators import groups

DISTANCE, SHINGLE, SEED = 3, 3, 42
BLOCK = 4096


def family() -> list[tuple[int, ...]]:
    """Sets of four of eight positions; any five positions contain one of them.

    Five positions have at least four in one half, or three in one half and two
    in the other. The halves' pairs fall into three matchings each; three
    positions of a half contain a pair of every matching.
    """
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    crossed = [(*a, *(4 + x for x in b)) for m in matchings for a in m for b in m]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *crossed]


FAMILY = family()
assert all(any(set(f) <= set(five) for f in FAMILY) for five in itertools.combinations(range(8), 5))


# Fingerprints

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    stops = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(s + 1 for s in stops[: -SHINGLE])]
    return majority(np.array([h(joined[a:z], SEED) for a, z in zip(starts, stops[SHINGLE - 1 :], strict=True)], np.uint64))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned hashes."""
    set_in = np.zeros(64, np.int64)
    for part in range(0, len(values), 65536):
        set_in += np.unpackbits(values[part : part + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t or "") for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], ["doc_id", "hash", "print"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, hash long, print long")


# Links


def candidates(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the pairs that share the guaranteed number of positional bytes."""
    x, y = (v.view(np.uint8).reshape(-1, 8) for v in (a, b))
    shared = np.zeros((len(a), len(b)), np.uint8)
    for p in range(8):
        shared += x[:, p, None] == y[None, :, p]
    return np.nonzero(shared >= 8 - distance)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """Links between two blocks of fingerprints, without those that others imply."""
    nodes = a if same else np.concatenate([a, b])
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, shift = [], 0 if same else len(a)
    for lo in range(0, len(a), 256):
        i, j = candidates(a[lo : lo + 256], b, distance)
        close = np.bitwise_count(a[lo + i] ^ b[j]) <= distance
        for x, y in zip((i[close] + lo).tolist(), (j[close] + shift).tolist(), strict=True):
            if x < y and (p := root(x)) != (q := root(y)):
                parent[q] = p
                links.append((x, y))
    values = nodes.view(np.int64).tolist()
    return [(values[x], values[y]) for x, y in links]


def _links_of_lists(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = None, [], []

        def worked_off() -> list[tuple[int, int]]:
            a = np.array(left, np.int64).view(np.uint64)
            if key[2] == key[3]:
                return _forest(a, a, True, distance) if len(a) > 1 else []
            return _forest(a, np.array(right, np.int64).view(np.uint64), False, distance) if left and right else []

        out: list[tuple[int, int]] = []
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if b.num_rows > 1 else []
            for lo, hi in itertools.pairwise([0, *change, b.num_rows]):
                if hi == lo:
                    continue
                now = tuple(int(c[lo]) for c in cols[:4])
                if now != key:
                    if key is not None:
                        out += worked_off()
                    key, left, right = now, [], []
                in_right = cols[4][lo:hi].astype(bool)
                prints = cols[5][lo:hi]
                left += prints[~in_right].tolist()
                right += prints[in_right].tolist()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if key is not None:
            out += worked_off()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of fingerprints whose components are those of all pairs within the distance."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the index holds distances up to {DISTANCE}, not {distance}")
    spark = distinct.sparkSession
    common.ship(spark)
    byte = lambda p: F.shiftrightunsigned("print", 8 * (7 - p)).bitwiseAND(F.lit(255).cast("long"))
    packed = [sum((byte(p) * F.lit(1 << 8 * k).cast("long") for k, p in enumerate(f)), F.lit(0).cast("long")) for f in FAMILY]
    index = distinct.select("print", F.posexplode(F.array(*packed)).alias("family", "bytes"))
    sizes = index.groupBy("family", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    sizes = common.materialise(sizes, "lists")
    short, long_ = (index.join(sizes.where(w), ["family", "bytes"]) for w in (F.col("n") <= block, F.col("n") > block))
    # With a fifth byte, family names both the four positions and the fifth one.
    fifth = F.array(*(F.array(*(byte(p) for p in range(8) if p not in f)) for f in FAMILY))
    longer = long_.select("family", "bytes", "print", F.posexplode(F.get(fifth, F.col("family"))).alias("k", "byte"))
    longer = longer.select((len(FAMILY) + 4 * F.col("family") + F.col("k")).alias("family"), (F.shiftleft("bytes", 8) + F.col("byte")).alias("bytes"), "print")
    longer_sizes = common.materialise(longer.groupBy("family", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "longer")
    listed = short.union(longer.join(longer_sizes, ["family", "bytes"]).select(*short.columns))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    # Block i meets the blocks i..blocks-1 on the left, and 0..i-1 on the right.
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), (j < own).alias("right")))
    dealt = listed.select("family", "bytes", "print", F.explode(meets).alias("m")).select("family", "bytes", "m.i", "m.j", "m.right", "print")
    n = common.shuffle_partitions(spark)
    sorted_ = dealt.repartition(n, "family", "bytes", "i", "j").sortWithinPartitions("family", "bytes", "i", "j", "right", "print")
    return sorted_.mapInArrow(_links_of_lists(distance), "a long, b long").distinct()


# Components


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes of (a, b)."""
    return groups.components(edges, "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, hash (of the text), print (signed long), component and component_id: the smallest doc_id that links lead to."""
    prints = common.materialise(fingerprints(docs, id_col, text_col), "prints")
    return grouped(prints, lambda distinct: links(distinct, distance))


def grouped(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, hash, print, component (its smallest print) and component_id, by the links (a, b) between prints."""
    distinct = common.materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(linked(distinct.select("print")))
    labelled = distinct.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    labelled = common.materialise(labelled, "labelled")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    smallest = common.materialise(smallest, "smallest")
    ids = common.materialise(labelled.join(smallest, "component").select("print", "component", "component_id"), "ids")
    return prints.join(ids, "print").select("doc_id", "hash", "print", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, found: DataFrame | None = None) -> DataFrame:
    """The documents without all but the one with the smallest id of each component.

    Components are those of ``found``, or of fingerprints within the distance.

    Exactly one row stays: of texts that share that id (or are all without one)
    the one of the smallest hash, and of rows that repeat as id and text one.
    """
    found = near_duplicates(docs, id_col, text_col, distance) if found is None else found
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "hash").agg(F.count("*").alias("n"))
    kept = least.groupBy("component").agg(F.min(F.struct("hash", "doc_id", "n")).alias("m")).select("m.doc_id", "m.hash", "m.n")
    kept = common.materialise(kept, "kept")
    # The input's columns lie in a struct while others are beside them, so no names clash.
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("hash"))

    def those(which: DataFrame) -> DataFrame:
        return rows.join(which.hint("shuffle_hash"), same, "left_semi").select("row.*")

    if kept.where("n > 1").isEmpty():
        return those(kept)
    return those(kept.where("n = 1")).unionByName(those(kept.where("n > 1")).dropDuplicates([id_col, text_col]))
