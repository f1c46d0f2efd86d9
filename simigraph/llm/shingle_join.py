"""Near-duplicates by exact likeness: all texts whose sets of five-word shingles
have a Jaccard likeness of 4/5 or more, for the pipeline's near-dedup stage.

Each set has a SimHash fingerprint. Those that differ in few bits are found by
the index of positional bytes with its count filter (``simhash.links``), and are
verified on the texts like all others. No radius of SimHash bits holds all pairs
that are wanted (at likeness 0.8 about ten of 64 bits differ, and any number may),
so a second index follows that loses none. Shingle
hashes of a text are put in order; of n, two sets that are like enough share one
within their first n - ceil(4n/5) + 1. These are listed by an inverted index,
and lists of one entry are dropped. Pairs must pass bounds that hold for every
pair wanted: by sizes, by places in the order, and by parities of the numbers of
shingles in buckets (at least as many as shingles, up to 2^MOST_BITS): sets that
differ in d shingles differ in d parities at most. What passes
is verified on the hashes of all shingles (64 bits from all five words; that two
different shingles of one pair of texts agree has a chance of about one in 10^13).

Pairs are taken in two rounds, so a large group gives no square of pairs. First
each fingerprint meets one near it, and
each entry of a list only the one that comes first; what passes is verified
on the texts, which settles lists of two. Then the entries of longer lists meet
all others, in blocks, that aren't joined with them by then; those of a list's
largest component don't meet one another, so they move once for each block of the
other entries, and a group that the first round has joined moves once. A block passes
on the entries that have a partner by the bounds, and a forest that joins their
components: no more rows than it has read. Components that are joined so far are
a cluster. Of each cluster only the texts that have a partner are compared, in
blocks again, each with those of other components, and a block returns a forest
of verified links.

Words are those of SimHash: parted by white space, A-Z as a-z. A text of fewer
than five words is one shingle, and one without words too. Of a very long text
the index holds a fifth of the shingles, as of any other.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common, simhash
from simigraph.llm.simhash import LOWER, SEED, components

SHINGLE, BLOCK = 5, 4096
#: Least and most bits of the parities, as powers of two. Beyond 2^MOST_BITS shingles they rule out less; nothing is lost.
LEAST_BITS, MOST_BITS = 6, 15
#: Texts, and their bytes, that a block of a cluster has.
TEXTS, TEXT_BYTES = 512, 32_000_000
#: Words that are hashed at once.
SLICE = 100_000
#: A pseudo-random number for each byte, and an odd base whose powers tell places apart.
BYTES = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = (np.full(1 << bits, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hashes(words: list[bytes]) -> np.ndarray:
    """A polynomial hash of each shingle's bytes, from sums over the bytes before."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    up, down = powers(max(16, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=sums[1:])
    blanks = np.flatnonzero(raw == 32)
    starts, stops = np.append(0, blanks + 1), np.append(blanks, len(raw))
    starts = starts[: len(starts) - SHINGLE + 1]
    h = (sums[stops[SHINGLE - 1 :]] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ h >> np.uint64(29)


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of all shingles, in order."""
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    last = len(words) - SHINGLE + 1
    found = np.sort(np.concatenate([_hashes(words[k : min(k + SLICE, last) + SHINGLE - 1]) for k in range(0, last, SLICE)]))
    return found[np.append(True, found[1:] != found[:-1])]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parities_of(values: np.ndarray) -> bytes:
    """One bit for each bucket: whether the number of values in it is odd."""
    bits = min(max(len(values).bit_length(), LEAST_BITS), MOST_BITS)
    counts = np.bincount((values & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parities that differ, for rows of both; those of more buckets are folded."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def features(text: str) -> tuple[int, int, np.ndarray, bytes, int]:
    """Hash of all words, size of the set, its first hashes in order, parities, fingerprint."""
    words = words_of(text)
    node, values = xxhash.xxh64_intdigest(b" ".join(words), SEED), shingles(words)
    n = len(values)
    return node, n, values[: n - (4 * n + 4) // 5 + 1], parities_of(values), simhash.majority(values)


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or "") for t in b.column(2).to_pylist()]
            prints = pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64))
            first = pa.array([f[2].view(np.int64) for f in found], pa.list_(pa.int64()))
            bits = pa.array(np.array([f[4] for f in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints, pa.array([f[1] for f in found], pa.int32()), first, pa.array([f[3] for f in found], pa.binary()), bits], ["doc_id", "hash", "print", "n", "first", "odd", "bits"])

    common.ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, hash long, print long, n int, first array<long>, odd binary, bits long")


def may_be_alike(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Bounds by sizes, and by the places of the first hash that two sets share."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - place, m - other) >= 4 * (n + m))


class Parities:
    """Parities of many sets; those of as many buckets are one table."""

    def __init__(self, odd: list[bytes]):
        self.width = np.array([len(x) for x in odd]) // 8
        rows = np.array(odd, object)
        self.tables = {w: np.frombuffer(b"".join(rows[self.width == w]), np.uint64).reshape(-1, w) for w in np.unique(self.width).tolist()}
        self.row = np.zeros(len(odd), np.int64)
        for w in self.tables:
            self.row[self.width == w] = np.arange((self.width == w).sum())

    def near(self, a: int, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Those of b whose parities may be those of a set like a's."""
        out = [b[:0]]
        for w, table in self.tables.items():
            of = b[self.width[b] == w]
            step = max(1, 2_000_000 // w)
            for at in range(0, len(of), step):
                some = of[at : at + step]
                own = np.broadcast_to(self.tables[self.width[a]][self.row[a]], (len(some), self.width[a]))
                out.append(some[9 * differ(own, table[self.row[some]]) <= n[a] + n[some]])
        return np.concatenate(out)


def _blocks(batches: Iterator[pa.RecordBatch], work: Callable[[list[np.ndarray]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``work`` on the columns of each block; rows come in order of the first three columns (key, i, j)."""
    key, held = None, []

    def worked_off() -> Iterator[pa.RecordBatch]:
        if held and (out := work([np.concatenate(c) for c in zip(*held, strict=True)])) is not None:
            yield out

    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1 if b.num_rows > 1 else []
        for lo, hi in itertools.pairwise([0, *change, b.num_rows]):
            if hi == lo:
                continue
            now = tuple(int(c[lo]) for c in cols[:3])
            if now != key:
                yield from worked_off()
                held = []
            key = now
            held.append(tuple(c[lo:hi] for c in cols))
    yield from worked_off()


def _sides(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block's left side, and those they meet: of the right side, or the same."""
    right = cols[3].astype(bool)
    return np.flatnonzero(~right), np.flatnonzero(~right if cols[1][0] == cols[2][0] else right)


def _joined_by_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, component) of a forest of the block's pairs that pass the bounds, and (print, null) of all entries in such pairs."""

    def work(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        left, other = _sides(cols)
        prints, n, place, comp = cols[4], cols[5].astype(np.int64), cols[6].astype(np.int64), cols[7]
        parities, label, paired = Parities(cols[8].tolist()), comp.copy(), np.zeros(len(prints), bool)
        edges = []
        for a in left.tolist():
            b = other[comp[other] != comp[a]]
            b = b[(5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (9 * np.minimum(n[a] - place[a], n[b] - place[b]) >= 4 * (n[a] + n[b]))]
            if len(b) and len(b := parities.near(a, b, n)):
                paired[b] = paired[a] = True
                for x in np.unique(label[b]).tolist():
                    if x != label[a]:
                        edges.append((int(comp[a]), int(comp[b[label[b] == x][0]])))
                        label[label == x] = label[a]
        if not edges:
            return None
        alone = prints[paired].tolist()
        first, second = [a for a, _ in edges] + alone, [b for _, b in edges] + [None] * len(alone)
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    return _blocks(batches, work)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the verified links between texts of a block that are of different components."""

    def work(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        left, other = _sides(cols)
        prints, comp = cols[4], cols[5].copy()
        sets = [shingles(words_of(t)) for t in cols[6].tolist()]
        n, parities = np.array([len(x) for x in sets]), Parities([parities_of(x) for x in sets])
        links = []
        for a in left.tolist():
            b = other[comp[other] != comp[a]]
            b = parities.near(a, b[5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])], n)
            for x in b.tolist():
                if comp[x] != comp[a] and alike(sets[a], sets[x]):
                    links.append((int(prints[a]), int(prints[x])))
                    comp[comp == comp[x]] = comp[a]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"]) if links else None

    return _blocks(batches, work)


def _close_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    as_row = lambda x: np.frombuffer(x, np.uint64)[None, :]
    for b in batches:
        ok = [9 * int(differ(as_row(p), as_row(q))[0]) <= n + m for n, p, m, q in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = functools.lru_cache(maxsize=64)(lambda text: shingles(words_of(text)))
    for b in batches:
        ok = [alike(of(x or ""), of(y or "")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def near_prints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of prints by SimHash, the smaller first: each with one of its own fingerprint, and one of each fingerprint with one near it."""
    heads = common.materialise(sets.groupBy("bits").agg(F.min("print").alias("head")), "heads")
    own = sets.join(heads, "bits").select(F.col("head").alias("a"), F.col("print").alias("b")).where("a <> b")
    near = simhash.links(heads.select(F.col("bits").alias("print"))).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    near = near.groupBy("y").agg(F.min("x").alias("x")).join(heads.toDF("x", "p"), "x").join(heads.toDF("y", "q"), "y")
    return own.union(near.select(F.least("p", "q"), F.greatest("p", "q")))


def links(docs: DataFrame, sets: DataFrame, text_col: str = "text", block: int = BLOCK, text_block: int = TEXTS) -> DataFrame:
    """Pairs (a, b) of prints whose components are those of all pairs that are alike.

    ``sets`` has one row for each print.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")

    def texts_of(prints: DataFrame) -> DataFrame:
        """print and one text of each."""
        wanted = common.materialise(sets.join(prints, "print", "left_semi").select("print", "hash"), "wanted")
        rows = docs.select(F.xxhash64(text).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
        return common.materialise(rows.join(wanted, "hash").dropDuplicates(["print"]).select("print", "text"), "texts")

    def verify(pairs: DataFrame, tag: str) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("print")).union(pairs.select("b")))
        pairs = pairs.repartition(common.shuffle_partitions(spark), "a", "b")
        both = pairs.join(texts.toDF("a", "s"), "a").join(texts.toDF("b", "t"), "b").select("a", "b", "s", "t")
        return common.materialise(both.mapInArrow(_verified, "a long, b long"), tag)

    index = sets.select("print", "n", F.posexplode("first").alias("place", "key"))
    lists = index.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("place", "n", "print")).alias("head")).where("size > 1")
    lists = common.materialise(lists, "lists")
    listed = common.materialise(index.join(lists, "key"), "listed")
    meets = listed.where((F.col("print") != F.col("head.print")) & may_be_alike(F.col("n"), F.col("place"), F.col("head.n"), F.col("head.place")))
    first = meets.select(F.least("print", "head.print").alias("a"), F.greatest("print", "head.print").alias("b"))
    first = first.union(near_prints(sets.select("print", "bits"))).distinct()
    small = sets.select("print", "n", "odd")
    counted = first.join(small.toDF("a", "n", "p"), "a").join(small.toDF("b", "m", "q"), "b").select("a", "b", "n", "p", "m", "q")
    first = common.materialise(counted.mapInArrow(_close_parities, "a long, b long"), "first")
    found = verify(first, "linked")
    joined = common.materialise(components(found), "joined")
    entries = listed.where("size > 2").join(joined.withColumnRenamed("node", "print"), "print", "left").select("key", "print", "n", "place", "size", F.coalesce("component", "print").alias("component"))
    entries = common.materialise(entries, "entries")
    open_ = common.materialise(largest(entries, "key"), "open")
    left = entries.join(open_, "key").join(sets.select("print", "odd"), "print")
    apart = F.when(F.col("others") + F.col("members") > block, F.ceil(F.col("members") / block)).otherwise(0)
    sorted_ = deal(left, "key", F.ceil(F.col("others") / block), apart, "n", "place", "component", "odd")
    second = common.materialise(sorted_.mapInArrow(_joined_by_bounds, "a long, b long").distinct(), "second")
    # Texts to compare: those with a partner, by the cluster of their component.
    clusters = common.materialise(components(second.where("b is not null")), "clusters").toDF("component", "cluster")
    paired = second.where("b is null").select(F.col("a").alias("print")).join(joined.withColumnRenamed("node", "print"), "print", "left")
    paired = paired.select("print", F.coalesce("component", "print").alias("component")).join(clusters, "component")
    texts = common.materialise(paired.join(texts_of(paired.select("print")), "print").select("cluster", "print", "component", "text"), "texts")
    sizes = common.materialise(largest(texts, "cluster", F.octet_length("text")), "open")
    others, members = (F.greatest(F.lit(1), F.ceil(F.col(n) / text_block), F.ceil(F.col(weight) / TEXT_BYTES)) for n, weight in (("others", "others_weight"), ("members", "members_weight")))
    small = (F.col("others") + F.col("members") <= text_block) & (F.col("others_weight") + F.col("members_weight") <= TEXT_BYTES)
    compared = deal(texts.join(sizes, "cluster"), "cluster", others, F.when(small, 0).otherwise(members), "component", "text")
    return found.union(common.materialise(compared.mapInArrow(_linked, "a long, b long"), "linked"))


def largest(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Of each key with several components: the largest one (main), its rows (members) and all others, with sums of the weight."""
    counted = rows.groupBy(key, "component").agg(F.count("*").alias("n"), F.sum(F.lit(0) if weight is None else weight).cast("long").alias("weight"))
    of = counted.groupBy(key).agg(F.max(F.struct("n", "weight", "component")).alias("m"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).where("m.n < n")
    return of.select(key, F.col("m.component").alias("main"), F.col("m.n").alias("members"), (F.col("n") - F.col("m.n")).alias("others"), F.col("m.weight").alias("members_weight"), (F.col("weight") - F.col("m.weight")).alias("others_weight"))


def deal(rows: DataFrame, key: str, others: Column, members: Column, *columns: str) -> DataFrame:
    """Each key's rows in pairs of blocks, in order of (key, i, j): block i meets i.. on the left, and 0..i-1 on the right.

    ``others`` is the number of blocks of rows that aren't of the component
    ``main``; the ``members`` blocks of those that are come after them, and never
    meet one another, so a large component and few other rows move about once.
    Where ``members`` is 0, all rows are dealt alike: a key that fits one block is one.
    """
    others, members = others.cast("int"), members.cast("int")
    is_main, h = (members > 0) & (F.col("component") == F.col("main")), F.xxhash64("print")
    own = F.when(is_main, others + F.pmod(h, members)).otherwise(F.pmod(h, others)).cast("int")
    last = F.when(is_main, others).otherwise(others + members) - 1
    meets = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), (j < own).alias("right")))
    dealt = rows.select(key, F.explode(meets).alias("m"), "print", *columns).select(key, "m.i", "m.j", "m.right", "print", *columns)
    return dealt.repartition(common.shuffle_partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), print (of its words) and component_id: the smallest doc_id that links lead to."""
    rows = common.materialise(sets_of(docs, id_col, text_col), "prints")
    sets = common.materialise(rows.select("print", "hash", "n", "first", "odd", "bits").dropDuplicates(["print"]), "sets")
    return simhash.grouped(rows.select("doc_id", "hash", "print"), lambda _: links(docs, sets, text_col))
