"""Operator 11: what each of five filters removes, in every order they can be applied.

A document fails A with fewer than 200 words, B with fewer than half of its
words distinct, C with more than 2 % capitals A-Z, D with any of ``#$%&*|``, and E
with a text that a smaller document id has too, anywhere in the table.

E is found by routing texts by fingerprint. Each input partition keeps the first
id of each text it meets; a document that comes with a larger id, or loses its
place to a smaller one, is surely not the minimum and is emitted there and then.
So a text leaves a partition about once, however many copies it has. What is left
goes to the partition of its xxHash64, sorted by that, where a chain holds the
different texts of one fingerprint in full, each with its smallest id, and emits
all others. A partition's memory is bounded by KEEP_BYTES of texts before the
shuffle (the table of firsts is sent on and begun anew beyond that) and by one
chain after it.

Failed filters are bits of a mask. Every document counts as one with the bits of
A to D; each emitted one moves a count from its mask to the mask with E. Both are
written as narrow rows, without texts, which join the labels. Counts are vectors by mask: documents,
good ones, toxic ones. They are summed up in each partition and merged for each
part by ``combineByKey``, so a part in a third of all rows sends one vector a
partition. All 120 orders are read off the 32 masks of a part.

Null and empty texts are empty: they fail A and are copies of each other. Null
sources are the part of the empty string. Rows of one id and text are copies of
each other only if a smaller id has the text as well. A null id is no smaller than
any and fails E never; it has no labels. A document is good or toxic if any of
its label rows says so. Very long texts are read whole. An empty table gives no
rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, re.compile(rb"[#$%&*|]")
COPY = 1 << FILTERS.index("E")
#: Texts that a partition holds before they are sent on.
KEEP_BYTES = 64 << 20
MASKS, COUNTS = 1 << len(FILTERS), 3

#: Parts that a task holds before their vectors are sent on.
PARTS_HELD = 20_000

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))

EMITTED = "doc_id long, part string, mask int, n long"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: What goes to a fingerprint: a text, its smallest id, and rows by part; or, without text and with its mask, a document that is emitted.
Routed = tuple[int, tuple[bytes | None, int, dict[str, int], int]]
#: doc_id, part, mask by A to D, rows.
Emitted = tuple[int, str, int, int]


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()
    n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
    chars = len(text.translate(None, _CONTINUED))
    return (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITALS_PERCENT * chars) << 2 | (SYMBOLS.search(text) is not None) << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask by A to D of each of (doc_id, part, text), and 1 as its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = pa.array([mask_of(t) for t in b.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, pa.array(np.ones(b.num_rows, np.int64))], ["doc_id", "part", "mask", "n"])

    return docs.mapInArrow(run, EMITTED)


def meet(kept: dict[bytes, tuple[int, dict[str, int]]], text: bytes, doc: int, parts: dict[str, int]) -> tuple[int, dict[str, int]] | None:
    """Take a document into the table of firsts; what isn't the text's smallest id for sure comes out."""
    if text not in kept:
        kept[text] = (doc, dict(parts))
        return None
    least, rows = kept[text]
    if doc == least:
        for p, n in parts.items():
            rows[p] = rows.get(p, 0) + n
        return None
    if doc > least:
        return doc, parts
    kept[text] = (doc, dict(parts))
    return least, rows


def firsts(rows: Iterable[tuple[int, str, bytearray]]) -> Iterator[Routed]:
    """The smallest id of each text of a partition, by fingerprint; others as emitted, by a hash of their id."""
    kept: dict[bytes, tuple[int, dict[str, int]]] = {}
    held = 0
    for doc, part, raw in rows:
        text = bytes(raw)
        new = text not in kept
        if out := meet(kept, text, doc, {part: 1}):
            yield xxhash.xxh64_intdigest(out[0].to_bytes(8, "little", signed=True)), (None, *out, mask_of(text))
        held += new * len(text)
        if held > KEEP_BYTES:
            yield from sent(kept)
            kept, held = {}, 0
    yield from sent(kept)


def sent(kept: dict[bytes, tuple[int, dict[str, int]]]) -> Iterator[Routed]:
    return ((xxhash.xxh64_intdigest(t), (t, *first, 0)) for t, first in kept.items())


def chains(routed: Iterable[Routed]) -> Iterator[Emitted]:
    """All but the smallest id of each text, from records in the order of their fingerprints."""
    for _, group in itertools.groupby(routed, key=lambda r: r[0]):
        kept: dict[bytes, tuple[int, dict[str, int]]] = {}
        for _, (text, doc, parts, mask) in group:
            if text is None:
                yield from ((doc, p, mask, n) for p, n in parts.items())
            elif out := meet(kept, text, doc, parts):
                failed = mask_of(text)
                yield from ((out[0], p, failed, n) for p, n in out[1].items())


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and rows of the documents that fail E, of (doc_id, part, text)."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", "part", F.col("text").cast("binary")).rdd
    n = max(common.shuffle_partitions(spark), rows.getNumPartitions())
    dealt = rows.mapPartitions(firsts).repartitionAndSortWithinPartitions(n, lambda fingerprint: fingerprint % n)
    return spark.createDataFrame(dealt.mapPartitions(chains), EMITTED, verifySchema=False)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic, 0 or 1; labels are of one row or more for each document."""
    fits = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(fits("quality").alias("good"), fits("toxic").alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias
    joined = rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", flag("good")("good"), flag("toxic")("toxic"))
    return joined.unionByName(rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def vectors(rows: DataFrame) -> RDD[tuple[str, np.ndarray]]:
    """part and its vector of documents, good and toxic ones by mask, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["part", "counts"])

        for b in batches:
            parts = b.column(0).dictionary_encode()
            names, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            mask, n, good, toxic = (b.column(k).to_numpy() for k in range(1, 5))
            block = np.zeros((len(names), MASKS, COUNTS), np.int64)
            for k, of in enumerate((n, n * good, n * toxic)):
                np.add.at(block[:, :, k], (codes, mask), of)
            for name, v in zip(names, block, strict=True):
                found[name] = found[name] + v if name in found else v
            if len(found) > PARTS_HELD:
                yield out()
                found.clear()
        yield out()

    sums = rows.select("part", "mask", "n", "good", "toxic").mapInArrow(run, "part string, counts binary").rdd
    pairs = sums.map(lambda r: (r["part"], np.frombuffer(bytes(r["counts"]), np.int64)))
    return pairs.combineByKey(lambda v: v.copy(), np.add, np.add)


def orders() -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step, place of its filter) of all rows, and which masks are kept, removed and redundant there."""
    masks = np.arange(MASKS)
    rows, kept, removed, redundant = [], [], [], []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = masks & (1 << f) != 0, masks & before != 0
            rows.append(("".join(FILTERS[k] for k in order), step, f))
            kept.append(~fails & ~gone)
            removed.append(fails & ~gone)
            redundant.append(fails & gone)
            before |= 1 << f
    return rows, *(np.array(x, np.int64) for x in (kept, removed, redundant))


def read_off(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part."""
    rows, kept, removed, redundant = orders()
    by = counts.reshape(MASKS, COUNTS)
    stays, goes, gone = kept @ by[:, 0], removed @ by, redundant @ by[:, 0]
    shapley = [int(sum(goes[k, 0] for k, r in enumerate(rows) if r[2] == f)) for f in range(len(FILTERS))]
    for k, (order, step, f) in enumerate(rows):
        yield (part, order, step, int(stays[k]), int(goes[k, 0]), int(gone[k]), int(by[1 << f, 0]), int(goes[k, 1]), int(goes[k, 2]), shapley[f])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    spark = docs.sparkSession
    common.ship(spark)
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), some(part_col).alias("part"), some(text_col).alias("text"))
    copies = repeated(rows)
    moved = F.explode(F.array(F.struct(F.col("mask"), (-F.col("n")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("n"))))
    shifts = copies.select("doc_id", "part", moved.alias("m")).select("doc_id", "part", "m.mask", "m.n")
    masks = common.materialise(judged(rows.withColumn("text", F.col("text").cast("binary"))).unionByName(shifts), "masks")
    counted = vectors(with_labels(masks, labels))
    return spark.createDataFrame(counted.flatMap(lambda x: read_off(*x)), AUDIT, verifySchema=False)
