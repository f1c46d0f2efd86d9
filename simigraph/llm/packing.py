"""Operator 2: best-fit packing into sequences of several permitted lengths.

A sequence costs its length, a part that grows with the square of it, and a
fixed part, so neither the shortest nor the longest length is the cheapest for
its room. Pieces are packed in descending order of size. A piece goes into the
open bin with the least room that holds it; if there is none, a bin is opened.
Its length is chosen together with what is still to come: each permitted length
is filled on trial with the piece and, greedily, the largest remaining ones, and
the one with the least cost for each token held is opened (ties: the shorter).
At the end each bin is downsized to the cheapest permitted length that holds its
contents. The same is done with each single length preferred for all bins, and
the cheapest of these plans is kept, so a group costs no more than with any one
length. Items longer than the longest length are cut into pieces of that length
first; nothing is dropped.

Pieces are dealt out by a hash to groups of GROUP_PIECES on average, and each
group is packed by itself: it leaves no more than a few bins worse than packing
all at once, and no task holds more than the places and sizes of its group.

Null or non-positive sizes are empty items: piece 0 of size 0, in a bin of
their own group. Repeated rows and rows without id are items of their own, dealt
out by where they stand in the table. Very long texts are as many pieces, in as
many groups. An empty table gives an empty result. Only the two named columns
are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

#: Permitted lengths, and what a sequence costs besides its length: a fixed part, and its square over QUADRATIC.
LENGTHS, OVERHEAD, QUADRATIC = (256, 512, 1024, 2048, 4096), 64, 8192
GROUP_PIECES = 20_000


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def trial_fill(room: int, counts: list[int], present: int) -> int:
    """What the largest remaining sizes fill of the room, taken greedily."""
    filled = 0
    while fits := present & ((1 << room + 1) - 2):
        s = fits.bit_length() - 1
        filled += (n := min(counts[s], room // s)) * s
        room -= n * s
        present &= (1 << s) - 1
    return filled


def plan(sizes: Sequence[int], lengths: Sequence[int], price: Callable[[int], float], preferred: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bins, offsets and lengths; bins open at the preferred length (a longer one for longer pieces), or by trial."""
    top = lengths[-1]
    final, k = [], len(lengths)
    for u in range(top, -1, -1):  # the cheapest length for each content
        while k and lengths[k - 1] >= u:
            k -= 1
        final.append(min(lengths[k:], key=lambda x: (price(x), x)))
    final.reverse()
    counts, present = [0] * (top + 1), 0
    for s in sizes:
        counts[s] += 1
        present |= 1 << s
    open_mask, rooms = 0, [[] for _ in range(top + 1)]  # bins by room left; bit r of the mask: some bin has room r
    used, bins, offsets = [], [], []
    for s in sizes:
        counts[s] -= 1
        if not counts[s]:
            present &= ~(1 << s)
        fits = open_mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = rooms[r].pop()
            if not rooms[r]:
                open_mask &= ~(1 << r)
        else:
            able = [x for x in lengths if x >= s]
            if preferred is not None:
                r = max(able[0], preferred)
            elif len(able) == 1:
                r = able[0]
            else:
                held = [s + trial_fill(x - s, counts, present) for x in able]
                r = min(zip(able, held, strict=True), key=lambda c: (price(final[c[1]]) / max(c[1], 1), c[0]))[0]
            k = len(used)
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += s
        left = r - s
        rooms[left].append(k)
        open_mask |= 1 << left
    return bins, offsets, [final[u] for u in used]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """For pieces in descending order: bin and offset of each; and the final length of each bin. The cheapest plan."""
    lengths = sorted(lengths)
    plans = [plan(sizes, lengths, price, preferred) for preferred in (None, *lengths)]
    return min(plans, key=lambda p: sum(map(price, p[2])))


def pack_documents(docs: DataFrame, size: Column, id_col: str = "doc_id", lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, first, n_tokens, bin, offset, bin_length, bin_used.

    ``bin`` is the group's number times 2^32 plus the bin's number in it.
    """
    spark = docs.sparkSession
    common.ship(spark)
    longest = max(lengths)
    size = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    items = common.materialise(items, "sizes")
    n_pieces = items.agg(F.sum(F.greatest(F.ceil(F.col("size") / longest), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-n_pieces // group_pieces))
    starts = F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(longest).cast("long"))
    pieces = items.select("doc_id", "row", "size", F.posexplode(starts).alias("piece", "first"))
    pieces = pieces.select("doc_id", "piece", "first", F.least(F.col("size") - F.col("first"), F.lit(longest)).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)).cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def packed() -> pa.RecordBatch:
            bins, offsets, final = pack([r[3] for r in rows], lengths)
            used = np.bincount(bins, [r[3] for r in rows]).astype(np.int64)
            cols = [
                [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows],
                [(part << 32) + k for k in bins], offsets, [final[k] for k in bins], [int(used[k]) for k in bins],
            ]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "first", "n_tokens", "bin", "offset", "bin_length", "bin_used"])

        for b in batches:
            for doc, piece, first, n, group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != part and rows:
                    yield packed()
                    rows = []
                part = group
                rows.append((doc, piece, first, n))
        if rows:
            yield packed()

    dealt = pieces.repartitionById(groups, F.col("part")).sortWithinPartitions("part", F.desc("n_tokens"), "doc_id", "piece")
    return dealt.select("doc_id", "piece", "first", "n_tokens", "part").mapInArrow(run, "doc_id long, piece int, first long, n_tokens long, bin long, offset long, bin_length long, bin_used long")


def pack_sequences(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The sequences themselves, of (doc_id, ids): bin, bin_length, bin_used, ids, and pieces in their order.

    Each of ``pieces`` says what lies where: doc_id, piece, first (its place in the
    document), offset (its place in the sequence) and n_tokens. Documents are cut
    into their pieces where they are read, so a long one isn't copied for each; a
    sequence gathers what it holds, no more than the longest length in ids and the
    pieces of its group. Null ids lists are empty.
    """
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    rows = common.materialise(tokens.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")), "tokens")
    longest = max(lengths)
    places = pack_documents(rows.select("row", "ids"), F.size("ids"), "row", lengths, group_pieces).withColumnRenamed("doc_id", "row")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1)), F.lit(longest))
    cut = rows.select("row", "doc_id", F.posexplode(F.transform(starts, lambda s: F.slice("ids", s, F.lit(longest)))).alias("piece", "part_ids"))
    placed = cut.join(places, ["row", "piece"])
    piece = F.struct("offset", "n_tokens", "doc_id", "piece", "first", "part_ids")
    gathered = placed.groupBy("bin", "bin_length", "bin_used").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    shown = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["first"].alias("first"), x["offset"].alias("offset"), x["n_tokens"].alias("n_tokens")))
    return gathered.select("bin", "bin_length", "bin_used", F.flatten(F.transform("p", lambda x: x["part_ids"])).alias("ids"), shown.alias("pieces"))
