"""Operator 1: token ids as canonical, length-limited Huffman files.

Ids of all documents, in ascending document order, are written as independent
blocks. The code comes from the ids' global counts: package-merge gives the
best code lengths up to a limit, and lengths alone make the canonical code, so
a codebook is one byte for each id. A block holds whole documents, their
lengths, the bit stream, and the bit offset of every INTERVAL-th id as a
difference. A reader decodes the stretches between these checkpoints side by
side with one table look-up an id; it needs no other block.

Files are Parquet whose ``block`` column holds the binary blocks, so that
Spark's committer makes writing safe against lost executors and any store that
Spark reaches can hold them.

Null texts are empty; null document ids come first; documents with equal ids
are ordered by a hash of their ids, then by their place in the table, so that
rows of one id or rows that repeat are dealt to many ranges. A very long text is
encoded whole; a block closes after it, so a block holds little more ids than
the limit or its longest document. An empty table gives empty files. Only the
two named columns are read, so others may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.llm.tokens import encoder

MAGIC = b"HUF1"
#: Ids between two bit-offset checkpoints; ids after which a block is closed.
INTERVAL, BLOCK_IDS = 64, 1 << 18
#: Longest code; grows only for vocabularies that need more.
LONGEST = 16


# The code


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each id by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    row, leaf_rows = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        leaf_rows.append(order < n)
        row = both[order]
    depth, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaves in reversed(leaf_rows):
        k = int(leaves[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    lengths[used] = depth
    return lengths


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[used].astype(np.int64)
        self.longest = int(size[-1]) if len(used) else 1
        share = np.left_shift(1, self.longest - size)
        self.codes = np.zeros(len(lengths), np.uint64)
        if len(used):
            self.codes[used] = (np.cumsum(share) - share) >> (self.longest - size)
        self.symbol = np.zeros(1 << self.longest, np.uint32)
        self.step = np.ones(1 << self.longest, np.int64)
        filled = int(share.sum())
        self.symbol[:filled] = np.repeat(used.astype(np.uint32), share)
        self.step[:filled] = np.repeat(size, share)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The bit stream, the bit offset of each checkpoint, and the number of bits."""
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id has no code")
        stop = np.cumsum(size)
        start = stop - size
        bits = int(stop[-1]) if len(ids) else 0
        word, shift = start >> 5, (64 - size - (start & 31)).astype(np.uint64)
        window = self.codes[ids] << shift
        words = np.zeros((bits + 31 >> 5) + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(window >> np.uint64(32), first)
            low = window & np.uint64(0xFFFFFFFF)
            over = np.flatnonzero(low)
            words[word[over] + 1] += low[over]
        return words.astype(">u4").tobytes()[: bits + 7 >> 3], start[::INTERVAL], bits

    def unpack(self, stream: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """Decode all stretches between checkpoints in step."""
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        last, mask = len(window) - 1, (1 << self.longest) - 1
        at, out = marks.astype(np.int64), np.empty((INTERVAL, len(marks)), np.uint32)
        for k in range(INTERVAL):
            seen = window[np.minimum(at >> 3, last)] >> (32 - self.longest - (at & 7)).astype(np.uint32) & mask
            out[k] = self.symbol[seen]
            at += self.step[seen]
        return out.T.reshape(-1)[:n]


# Blocks


def write_block(book: Codebook, docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    stream, marks, _ = book.pack(ids)
    head = struct.pack("<4sIQI", MAGIC, len(docs), len(ids), len(marks))
    return b"".join(
        [
            head,
            np.array([d or 0 for d in docs], np.int64).tobytes(),
            np.array([d is None for d in docs], np.uint8).tobytes(),
            np.array(sizes, np.uint64).tobytes(),
            np.diff(marks, prepend=0).astype(np.uint16).tobytes(),
            stream,
        ]
    )


def read_block(book: Codebook, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, n_docs, n_ids, n_marks = struct.unpack_from("<4sIQI", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 20

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(block, kind, n, at)
        at += part.nbytes
        return part

    docs, null, sizes = take(np.int64, n_docs), take(np.uint8, n_docs), take(np.uint64, n_docs)
    marks = np.cumsum(take(np.uint16, n_marks).astype(np.int64))
    ids = book.unpack(block[at:], marks, n_ids)
    return [None if x else d for d, x in zip(docs.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), ids


# Spark


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids' bytes of each document, with the end id."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("word", tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            raw = [enc.encode(t or "") + end for t in b.column(1).to_pylist()]
            n = [len(r) // len(end) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(encoded: DataFrame, size: int, dtype: type) -> np.ndarray:
    """How often each id occurs; the driver gets at most one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def _packer(lengths: bytes, dtype: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, shard = Codebook(np.frombuffer(lengths, np.uint8)), TaskContext.get().partitionId()
        docs, sizes, parts, held, start, number = [], [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype).astype(np.int64)
            row = [[shard], [number], [start], [len(ids)], [write_block(book, docs, sizes, ids)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "number", "first", "n_ids", "block"])

        for b in batches:
            for doc, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append(doc)
                sizes.append(n)
                parts.append(raw)
                held += n
                if held >= BLOCK_IDS:
                    yield block()
                    start, number, held, docs, sizes, parts = start + held, number + 1, 0, [], [], []
        if docs:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, count, make the code, and write ``path``/codebook, /blocks and /shards.

    Shards are ranges of document ids. The ids are kept once between encoding
    and packing, and deleted afterwards.
    """
    spark = docs.sparkSession
    enc = encoder("word", tokenizer)
    size = max(enc.tok.get_vocab_size(True), end_id + 1)
    kept = common.new_path(spark, "ids")
    encode_documents(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.schema("doc_id long, n_tokens long, ids binary").parquet(kept)
    lengths = code_lengths(count_ids(encoded, size, enc.dtype)).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    n = common.shuffle_partitions(spark)
    order = ["doc_id", F.xxhash64("ids"), "row"]
    numbered = encoded.withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
    blocks = ranged.mapInArrow(_packer(lengths, enc.dtype), "shard int, number int, first long, n_ids long, block binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    common.delete_path(spark, kept)
    # One row for each shard, which are as many as shuffle partitions.
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, rows = 0, []
    for r in totals:
        rows.append((r.shard, base))
        base += r.n
    spark.createDataFrame(rows, "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless ``digest_only``, ids of each document.

    Every block is decoded by itself in whatever task has it.
    """
    common.ship(spark)
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)  # a byte for each id of the vocabulary
    names = ["shard", "at", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * (not digest_only)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * (not digest_only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for shard, first, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, sizes, ids = read_block(book, block)
                stops = np.cumsum(sizes)
                starts, raw = stops - sizes, ids.astype("<u4")
                spans = list(zip(starts.tolist(), stops.tolist(), strict=True))
                cols = [[shard] * len(docs), (first + starts).tolist(), docs, sizes.tolist(), [zlib.crc32(raw[a:z].tobytes()) for a, z in spans]]
                if not digest_only:
                    cols.append([raw[a:z].astype(np.int32) for a, z in spans])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * (not digest_only)
    decoded = spark.read.parquet(f"{path}/blocks").select("shard", "first", "block").mapInArrow(run, schema)
    shards = spark.read.schema("shard int, base long").parquet(f"{path}/shards")
    out = decoded.join(F.broadcast(shards), "shard").withColumn("start", F.col("at") + F.col("base"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * (not digest_only))
