"""Operator 10: BPE encoding and decoding with content-defined chunks.

A rolling hash over the bytes cuts a text where its last 32 bytes say so, so
passages that documents share are cut alike; a text without a cut is one chunk.
Every chunk is encoded once and its ids are reused wherever its bytes come
again; the store of chunks is bounded and belongs to a Python worker. Ids next
to a cut may differ from those of the whole text: around each join a window from
the last change to white space on the left to the first one on the right is
encoded anew. A window wider by one change on each side must then give the same
ids for all it covers; if it doesn't, the whole text is encoded by the library.

Null texts are empty, with no ids. Texts that hold a special token's string go
to the library whole, and so do texts of a chunk in which a token lies across a
change to white space. Very long texts are chunked like others and never cut
short. Rows are handled one by one: repeated rows, null ids and empty tables
need no rule. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.llm.tokens import ByteBpe, encoder

#: A cut comes at one byte in 2^CUT_BITS on average; chunks have LEAST bytes at least.
CUT_BITS, LEAST = 10, 256
#: Bytes of ids that a worker keeps.
STORE_BYTES = 48_000_000

#: The gear table: a fixed sequence of 256 pseudo-random numbers.
GEAR = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 32, 256, np.uint32)

INNER = re.compile(r"\S(?=\s)")


def cuts(data: bytes) -> list[int]:
    """Offsets at which chunks end, without the last; each starts a character."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # h of a byte then sums up 2k bytes, older ones shifted further
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for p in at.tolist():
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST and len(data) - p >= LEAST:
            out.append(p)
            last = p
    return out


def split(text: str) -> list[str]:
    """Chunks, each with a change from other characters to white space within."""
    data = text.encode()
    chunks, at = [], 0
    for p in [*cuts(data), len(data)]:
        part = data[at:p].decode()
        if chunks and INNER.search(chunks[-1]) is None:
            chunks[-1] += part
        else:
            chunks.append(part)
        at = p
    if len(chunks) > 1 and INNER.search(chunks[-1]) is None:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    return chunks


def changes(text: str) -> list[int]:
    """The last two changes from other characters to white space, the later first."""
    out, rest = [], text
    while len(out) < 2:
        tail = rest.rstrip()
        if tail == rest:
            parts = rest.rsplit(None, 1)
            tail = parts[0] if len(parts) == 2 else ""
        if not tail or len(tail) == len(rest):
            break
        out.append(len(tail))
        rest = tail
    return [p for p in out if text[p - 1 : p].strip() and p < len(text)]


class Chunk:
    """A chunk's ids, and where its first and last changes to white space are in text and ids.

    ``joins`` is false if there is no change, or a token lies across one.
    """

    __slots__ = ("first", "ids", "joins", "last", "next", "previous")

    def __init__(self, enc: ByteBpe, text: str):
        self.ids = np.frombuffer(enc.encode(text), enc.dtype)
        firsts = [m.end() for _, m in zip(range(2), INNER.finditer(text), strict=False)]
        lasts = changes(text)
        self.joins = bool(firsts and lasts)
        if not self.joins:
            return
        ends = np.cumsum(enc.length_of[self.ids])

        def place(p: int) -> tuple[int, int]:
            b = len(text[:p].encode())
            i = int(np.searchsorted(ends, b, "left")) + 1 if b else 0
            if b and (i > len(ends) or ends[i - 1] != b):
                self.joins = False
            return p, i

        self.first, self.next = place(firsts[0]), place(firsts[-1])
        self.last, self.previous = place(lasts[0]), place(lasts[-1])


class Store:
    """Chunks by digest, the least recently used of them dropped at STORE_BYTES."""

    def __init__(self, enc: ByteBpe):
        self.enc, self.held, self.size, self.hits, self.misses = enc, OrderedDict(), 0, 0, 0

    def get(self, text: str) -> Chunk:
        key = hashlib.blake2b(text.encode(), digest_size=16).digest()
        if (found := self.held.get(key)) is not None:
            self.held.move_to_end(key)
            self.hits += 1
            return found
        self.misses += 1
        made = self.held[key] = Chunk(self.enc, text)
        self.size += made.ids.nbytes + 600
        while self.size > STORE_BYTES and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].ids.nbytes + 600
        return made


def encode(enc: ByteBpe, store: Store, text: str) -> np.ndarray:
    """The ids that the tokenizer gives the whole text."""
    if not text:
        return np.zeros(0, enc.dtype)
    if enc.odd(text):
        return enc.ids(enc.whole(text))
    chunks = split(text)
    made = [store.get(c) for c in chunks]
    if len(made) == 1:
        return made[0].ids
    if not all(c.joins for c in made):
        return enc.ids(enc.whole(text))
    out = [made[0].ids[: made[0].last[1]]]
    for k in range(1, len(made)):
        a, b, left, right = made[k - 1], made[k], chunks[k - 1], chunks[k]
        join = enc.ids(enc.encode(left[a.last[0] :] + right[: b.first[0]]))
        wide = enc.ids(enc.plain(left[a.previous[0] :] + right[: b.next[0]]))
        near = np.concatenate([a.ids[a.previous[1] : a.last[1]], join, b.ids[b.first[1] : b.next[1]]])
        if not np.array_equal(wide, near):
            return enc.ids(enc.whole(text))
        out += [join, b.ids[b.first[1] : b.last[1] if k < len(made) - 1 else None]]
    return np.concatenate(out)


def decode(enc: ByteBpe, ids: np.ndarray) -> str:
    """As the library does: bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(enc.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document, or their digests."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("byte", tokenizer)
        store = enc.__dict__.setdefault("chunks", None) or Store(enc)
        enc.chunks = store
        for b in batches:
            n, ids_out, text_out = [], [], []
            for text in b.column(1).to_pylist():
                ids = encode(enc, store, text or "")
                back = decode(enc, ids)
                n.append(len(ids))
                if digests:
                    ids_out.append(hashlib.sha256(",".join(map(enc.digits_of.__getitem__, ids.tolist())).encode()).hexdigest())
                    text_out.append(hashlib.sha256(back.encode()).hexdigest())
                else:
                    ids_out.append(ids.astype(np.int32))
                    text_out.append(back)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32())), pa.array(text_out, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {'string' if digests else 'array<int>'}, {names[3]} string")
