"""Operator 8: Lempel-Ziv phrase fingerprints.

A text is parsed once from left to right: each phrase is the longest one seen
before plus one character. Texts that compress well together share phrases, so
the likeness of two texts is estimated from their phrase sets. Each phrase is
hashed, and a fingerprint is the SIZE smallest hashes of the set, written as
hexadecimal digits; the likeness of two fingerprints is the share of the
smallest SIZE hashes of both that both have, 1 for equal fingerprints and 0 if
one alone is empty.

``chain`` also compares each document with the next one in descending order and
with its edited text, whose end is replaced by the beginning of the next
document. Documents are dealt out by ranges of their ids, each range sorted and
read once with a look-ahead of one row; the first document of the range that
follows comes along as one more row. So every text is moved once, and no task
sees more than its range. Ids (and null) of more rows than a range holds are cut
into ranges of the texts' hashes; only rows that repeat as a whole share one.

Null texts are empty. Null ids come last. Documents with one id are ordered by
a hash of their text, then the text. A single document is its own next. Very
long texts are parsed whole. An empty table gives an empty result. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

SIZE, DIGITS = 64, 8
LEAST = -(1 << 63)


def parse(text: str, seen: set[str], phrase: str = "") -> tuple[list[str], str]:
    """The new phrases, and the one that the end of the text cuts short."""
    new, add, put = [], seen.add, None
    put = new.append
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            put(phrase)
            phrase = ""
    return new, phrase


def hashes(phrases: list[str]) -> np.ndarray:
    h = xxhash.xxh32_intdigest
    return np.array([h(p) for p in phrases], np.uint32)


def sketch(values: np.ndarray) -> np.ndarray:
    """The SIZE smallest distinct hashes."""
    return np.unique(values)[:SIZE]


def write(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE]
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def fingerprint(text: str) -> np.ndarray:
    return sketch(hashes(parse(text, set())[0]))


def edited_pair(text: str, after: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, and the sketches of both; what they begin with is parsed once."""
    cut = len(text) - len(text) // 3
    head, seen = text[:cut], set()
    first, rest = parse(head, seen)
    common_hashes = hashes(first)
    end = after[: len(text) - cut]
    other = set(seen)
    own = sketch(np.concatenate([common_hashes, hashes(parse(text[cut:], seen, rest)[0])]))
    if end == text[cut:]:
        return text, own, own
    return head + end, own, sketch(np.concatenate([common_hashes, hashes(parse(end, other, rest)[0])]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, str]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    held = None  # the row before, with its edited text and sketches still to be made
    waiting = None  # its output, but for the likeness to this row
    for part, tail, doc, text in _rows(batches):
        if held is not None and held[0] == part and not held[1]:
            edited, own, changed = edited_pair(held[3], text)
            if waiting is not None:
                out.append((*waiting[:-1], likeness(waiting[-1], own)))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            waiting = (held[2], len(held[3]), digest, write(own), write(changed), likeness(own, changed), own)
            if tail:
                out.append((*waiting[:-1], likeness(own, own if text == held[3] else fingerprint(text))))
                waiting = None
            if len(out) >= 2000:
                yield batch()
        held = (part, tail, doc, text)
    if out:
        yield batch()


def chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to the next document's."""
    spark = docs.sparkSession
    common.ship(spark)
    n = common.shuffle_partitions(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Bounds and first documents of the ranges: a row for each partition.
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    edges, times = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    # A cut lies before each of these keys, and further ones among the hashes of a key that comes again.
    above = np.append(np.cumsum(times[::-1])[::-1], 0)
    among = {k: np.array([LEAST + (1 << 64) * j // t for j in range(1, t)], np.int64) for k, t in zip(edges.tolist(), times.tolist(), strict=True) if t > 1}

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        k, h = k.to_numpy(), h.to_numpy()
        at = np.searchsorted(edges, k, "left")
        part = above[at].astype(np.int64)
        for hot, cuts in among.items():
            own = k == hot
            part[own] += np.searchsorted(cuts, h[own], "left") - len(cuts)
        return pd.Series(part.astype(np.int32))

    part = place("key", "hash").alias("part")
    firsts = rows.select("key", "hash", part).groupBy("part").agg(F.max(F.struct("key", -F.col("hash").cast("decimal(20,0)"))).alias("m"))
    firsts = sorted((r.part, r.m[0], int(-r.m[1])) for r in firsts.collect())
    follows = [(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)]  # the first range follows the last
    own = rows.select("key", "hash", "doc_id", "text", part, F.lit(False).alias("tail"))
    heads = rows.join(F.broadcast(spark.createDataFrame(follows, "key long, hash long, part int")), ["key", "hash"]).withColumn("tail", F.lit(True))
    # Of documents with one id at the head of a range, the first is what follows; the others are behind it.
    all_rows = own.unionByName(heads.select(*own.columns))
    dealt = all_rows.repartitionById(int(above[0]) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.desc("key"), "hash", "text")
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
