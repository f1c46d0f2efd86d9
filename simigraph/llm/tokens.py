"""Exact, memoised encoders over the public tokenizer files.

Each encoder splits a text into units that its tokenizer provably treats
apart, keeps the ids of units in a bounded memo, and hands what is not in the
memo to the library in batches. A unit with characters outside a plain range,
or a very long one, always goes to the library the contract names.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np

#: Memo limits of one Python worker: units, and characters in all of them.
MEMO_UNITS, MEMO_CHARS = 400_000, 16_000_000
#: A longer unit goes to the library that merges with a heap.
LONG_UNIT = 1_000
#: Characters that NFC leaves alone and whose lower case is one character by itself.
PLAIN = re.compile("[\x00-\x1b\x20-\x7e¡-įı-ž]*")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Forgets everything when it is full, so its memory is bounded."""

    chars = 0

    def room(self, units: set[str]) -> set[str]:
        """The units still to be looked up, after making room for them."""
        new = {u for u in units if u not in self}
        if len(self) + len(new) > MEMO_UNITS or self.chars > MEMO_CHARS:
            self.clear()
            self.chars, new = 0, set(units)
        self.chars += sum(map(len, new))
        return new


def _vocabulary(path: str):
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _ranks(rank: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("memo", pat_str=pattern, mergeable_ranks=rank, special_tokens={})


class WordBpe:
    """BPE with word ends, lower case, white space dropped: units are what blanks and line ends separate."""

    END = "</w>"
    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex

        self.tok = _library(path)
        self.dtype = np.uint16 if self.tok.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.memo = Memo()
        self.find = regex.compile(self.PRETOKEN).findall
        file = _vocabulary(path)
        self.specials = [t["content"] for t in file["added_tokens"]]
        alphabet = byte_alphabet()
        special = set(self.specials)
        rank = {}
        for piece, i in file["model"]["vocab"].items():
            if piece not in special:
                stem = piece.removesuffix(self.END)
                rank[bytes(alphabet[c] for c in stem) + b"\n" * (stem != piece)] = i
        self.fast = _ranks(rank, r"[^\n]+\n")
        self.ends = np.zeros(max(rank.values()) + 1, bool)
        self.ends[[i for b, i in rank.items() if b.endswith(b"\n")]] = True

    def units(self, text: str) -> list[str]:
        return [u for u in text.replace("\n", " ").split(" ") if u]

    def encode(self, text: str) -> bytes:
        """The ids, little-endian, as wide as ``dtype``."""
        units = self.units(text)
        try:
            return b"".join(map(self.memo.__getitem__, units))
        except KeyError:
            self.learn(set(units))
            return b"".join(map(self.memo.__getitem__, units))

    def learn(self, units: set[str]) -> None:
        plain, other = [], []
        for u in sorted(self.memo.room(units)):
            easy = len(u) <= LONG_UNIT and PLAIN.fullmatch(u) and "<|" not in u
            (plain if easy else other).append(u)
        if other:
            for u, e in zip(other, self.tok.encode_batch(other, add_special_tokens=False), strict=True):
                self.memo[u] = np.asarray(e.ids, self.dtype).tobytes()
        if plain:
            parts = [self.find(u.lower()) for u in plain]
            joined = [p for ps in parts for p in ps]
            ids = np.asarray(self.fast.encode_ordinary("\n".join(joined) + "\n") if joined else [], np.int64)
            stops = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            at = stops[np.cumsum([0, *map(len, parts)])] * np.dtype(self.dtype).itemsize
            raw = ids.astype(self.dtype).tobytes()
            for u, a, b in zip(plain, at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.memo[u] = raw[a:b]


class ByteBpe:
    """Byte-level BPE: units are a run of white space with the run of other characters after it.

    No token covers a change from other characters to white space, so ids of
    units can be joined. Texts with the special token's string, or with the
    control characters on which notions of white space differ, are encoded
    whole by the library.
    """

    UNIT = re.compile(r"\s*\S+|\s+")
    ODD = re.compile("[\x1c-\x1f\x85]")

    def __init__(self, path: str):
        import public_tokenizers

        self.tok = _library(path)
        self.dtype = np.uint16 if self.tok.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.width = np.dtype(self.dtype).itemsize
        self.memo = Memo()
        file = _vocabulary(path)
        self.specials = [t["content"] for t in file["added_tokens"]]
        alphabet = byte_alphabet()
        special = set(self.specials)
        rank = {bytes(alphabet[c] for c in p): i for p, i in file["model"]["vocab"].items() if p not in special}
        self.fast = _ranks(rank, public_tokenizers.PATTERN)
        size = 1 + max([*rank.values(), *(t["id"] for t in file["added_tokens"])])
        self.bytes_of = [b""] * size
        for b, i in rank.items():
            self.bytes_of[i] = b
        for t in file["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.digits_of = [str(i) for i in range(size)]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def odd(self, text: str) -> bool:
        return self.ODD.search(text) is not None or any(s in text for s in self.specials)

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return self.whole(text)
        units = self.UNIT.findall(text)
        try:
            return b"".join(map(self.memo.__getitem__, units))
        except KeyError:
            self.learn(set(units))
            return b"".join(map(self.memo.__getitem__, units))

    def learn(self, units: set[str]) -> None:
        joined, other = [], []
        for u in sorted(self.memo.room(units)):
            easy = len(u) <= LONG_UNIT and u[0].isspace() and not u[-1].isspace() and PLAIN.fullmatch(u)
            (joined if easy else other).append(u)
        if other:
            for u, e in zip(other, self.tok.encode_batch(other, add_special_tokens=False), strict=True):
                self.memo[u] = np.asarray(e.ids, self.dtype).tobytes()
        if joined:
            ids = np.asarray(self.fast.encode_ordinary("".join(joined)), np.int64)
            ends = np.cumsum(self.length_of[ids])
            stops = np.cumsum([len(u.encode()) for u in joined])
            at = np.searchsorted(ends, stops, "left") + 1
            if at[-1] > len(ends) or (ends[at - 1] != stops).any():  # a token crosses two units
                for u, e in zip(joined, self.tok.encode_batch(joined, add_special_tokens=False), strict=True):
                    self.memo[u] = np.asarray(e.ids, self.dtype).tobytes()
                return
            raw, at = ids.astype(self.dtype).tobytes(), (np.append(0, at) * self.width).tolist()
            for u, a, b in zip(joined, at[:-1], at[1:], strict=True):
                self.memo[u] = raw[a:b]

    def plain(self, text: str) -> bytes:
        """Without the memo, for checking what was put together from parts."""
        if PLAIN.fullmatch(text) and not self.odd(text) and len(text) <= LONG_UNIT:
            return np.asarray(self.fast.encode_ordinary(text), self.dtype).tobytes()
        return self.whole(text)

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype)


class PieceCounter:
    """Number of sentencepiece ids of a text.

    In the model no piece has the blank mark after another character, and none
    has a line end, so a run of blanks with what follows it, and a line end
    with what follows it, are counted apart. Texts that hold the blank mark
    itself, and models for which this doesn't hold, are encoded whole.
    """

    MARK = "▁"
    UNIT = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        mixed = any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in pieces)
        kept = self.sp.encode("ﬁ  x", out_type=str)
        self.splits = not mixed and "".join(kept) == f"{self.MARK}ﬁ{self.MARK * 2}x" and len(self.sp.encode("\n")) == 2
        self.memo = Memo()

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or self.MARK in text:
            return len(self.sp.encode(text))
        units = self.UNIT.findall(text)
        if text[0] not in " \n":
            units[0] = " " + units[0]  # the library puts one blank before a text
            extra = 0
        else:
            extra = len(self.sp.encode(text[0])) - 1 if text[0] == "\n" else 0
            if text[0] == " ":
                units[0] = " " + units[0]
        try:
            return extra + sum(map(self.memo.__getitem__, units))
        except KeyError:
            self.learn(set(units))
            return extra + sum(map(self.memo.__getitem__, units))

    def learn(self, units: set[str]) -> None:
        new = sorted(self.memo.room(units))
        asked = [u[1:] if u[0] == " " else u for u in new]
        for u, ids in zip(new, self.sp.encode(asked, num_threads=1), strict=True):
            self.memo[u] = 1 if u == " " else len(ids) - (u[0] == "\n")


@functools.lru_cache(maxsize=4)
def encoder(kind: str, path: str):
    """One of each kind in a Python worker, which keeps its memo from task to task."""
    return {"word": WordBpe, "byte": ByteBpe, "piece": PieceCounter}[kind](path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
