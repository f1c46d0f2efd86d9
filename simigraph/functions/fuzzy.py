"""Fuzzy likeness of two strings, in Arrow batches.

``ratio`` is 200 * LCS / (lengths). ``partial_ratio`` slides the shorter string
over the longer; the token ratios compare sorted and shared words. In a batch the
longest common subsequences of all pairs, and of all windows of all pairs, are
found side by side: each pair is one word of 64 bits, one for each character of
the shorter string, and a step takes the next character of all longer ones. Pairs
whose shorter string is longer than a word are done one by one with big integers.
"""

from __future__ import annotations

import difflib
import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def positions(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs(at: dict[str, int], n: int, other: str) -> int:
    """With the positions of the first string's characters, and its length."""
    full = (1 << n) - 1
    s, get = full, at.get
    for c in other:
        u = s & get(c, 0)
        s = (s + u | s - u) & full
    return n - s.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs(positions(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a

    def best(short: str, long: str) -> float:
        at, n, m, top = positions(short), len(short), len(long), 0.0
        for end in range(1, m + n):
            part = long[max(0, end - n) : min(end, m)]
            if 200.0 * len(part) / (n + len(part)) <= top:
                continue
            top = max(top, 200.0 * lcs(at, n, part) / (n + len(part)))
            if top == 100.0:
                break
        return top

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = x & y, x - y, y - x
    if shared and (not only_a or not only_b):
        return 100.0
    s, da, db = (" ".join(sorted(k)) for k in (shared, only_a, only_b))
    gap = bool(s)
    len_a, len_b = len(s) + gap + len(da), len(s) + gap + len(db)
    same = len(s) + gap + lcs(positions(da), len(da), db)
    out = 200.0 * same / (len_a + len_b)
    if s:
        out = max(out, 200.0 * len(s) / (len(s) + len_a), 200.0 * len(s) / (len(s) + len_b))
    return out


@functools.lru_cache(maxsize=100_000)
def fuzzy(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    return 0.25 * ratio(a, b) + 0.20 * partial_ratio(a, b) + 0.25 * token_sort_ratio(a, b) + 0.30 * token_set_ratio(a, b)


WORD = 64
#: Entries of the table of positions, so that names of many alphabets don't fill memory.
TABLE = 1 << 22


class Lanes:
    """Positions of the characters of many short strings, and the codes of the long strings beside them."""

    def __init__(self, short: Sequence[str], long: Sequence[str]):
        self.n = np.array([len(x) for x in short], np.int64)
        self.m = np.array([len(x) for x in long], np.int64)
        points = lambda strings: np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, codes = np.unique(np.concatenate([points(short), points(long)]), return_inverse=True)
        s, self.text = codes[: self.n.sum()], codes[self.n.sum() :]
        self.start = np.concatenate([[0], np.cumsum(self.m)[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(short)), self.n)
        bit = np.arange(len(s)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.at = np.zeros((len(short), max(len(kinds), 1)), np.uint64)
        np.bitwise_or.at(self.at, (owner, s), np.uint64(1) << bit.astype(np.uint64))
        self.full = np.where(self.n == WORD, np.uint64(2**64 - 1), (np.uint64(1) << (self.n % WORD).astype(np.uint64)) - np.uint64(1))

    def common(self, pair: np.ndarray, first: np.ndarray, length: np.ndarray, each: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """Lengths of the common subsequences of each lane: a pair's short string and a piece of its long one. ``each`` sees them after every step."""
        order = np.argsort(-length, kind="stable")
        pair, first, length = pair[order], first[order], length[order]
        place, state = self.start[pair] + first, self.full[pair].copy()
        live = len(pair)
        for k in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -k, side="left"))  # lanes longer than k
            p, s = pair[:live], state[:live]
            u = s & self.at[p, self.text[place[:live] + k]]
            state[:live] = s + u | s - u
            if each:
                each(k + 1, order[:live], self.n[p] - np.bitwise_count(state[:live] & self.full[p]))
        out = np.empty(len(pair), np.int64)
        out[order] = self.n[pair] - np.bitwise_count(state & self.full[pair])
        return out


def lcs_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Of pairs whose shorter string fits a word."""
    if not len(a):
        return np.zeros(0, np.int64)
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    lanes = Lanes(short, long)
    every = np.arange(len(short))
    return lanes.common(every, np.zeros_like(every), lanes.m)


def partial_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``partial_ratio`` of pairs that aren't empty and whose shorter string fits a word."""
    short, long = map(list, zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True))
    owner = list(range(len(short)))
    for k in range(len(owner)):  # of equal lengths, each slides over the other
        if len(short[k]) == len(long[k]):
            short.append(long[k])
            long.append(short[k])
            owner.append(k)
    lanes = Lanes(short, long)
    pair = np.repeat(np.arange(len(short)), lanes.m)
    first = np.arange(len(pair)) - np.repeat(lanes.start, lanes.m)
    length = np.minimum(lanes.n[pair], lanes.m[pair] - first)
    top = np.zeros(len(a))
    owners = np.array(owner)

    def begun(k: int, lane: np.ndarray, common: np.ndarray) -> None:
        """Pieces that end before the short string's length are seen on the way from the beginning."""
        head = first[lane] == 0
        p = pair[lane[head]]
        np.maximum.at(top, owners[p], 200.0 * common[head] / (lanes.n[p] + k))

    common = lanes.common(pair, first, length, begun)
    np.maximum.at(top, owners[pair], 200.0 * common / (lanes.n[pair] + length))
    return top


def fuzzy_many(a: Sequence[str], b: Sequence[str]) -> list[float]:
    """``fuzzy`` of many pairs."""
    pairs = list(dict.fromkeys(zip(a, b, strict=True)))
    known: dict[tuple[str, str], float] = {}
    todo = []
    for p in pairs:
        if not p[0] or not p[1] or min(map(len, p)) > WORD:
            known[p] = fuzzy(*p)
        else:
            todo.append(p)
    kinds = len(set().union(*map(set, todo[:1000]), *(set(x) | set(y) for x, y in todo[1000:]))) if todo else 1
    size = max(1, TABLE // (2 * max(kinds, 1)))
    for k in range(0, len(todo), size):
        known.update(_batch(todo[k : k + size]))
    return [known[p] for p in zip(a, b, strict=True)]


def _batch(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    a, b = zip(*pairs, strict=True)
    length = lambda x: np.array([len(s) for s in x])
    whole = 200.0 * lcs_many(a, b) / (length(a) + length(b))
    words = [(x.split(), y.split()) for x, y in pairs]
    sorted_a, sorted_b = [" ".join(sorted(x)) for x, _ in words], [" ".join(sorted(y)) for _, y in words]
    lengths = length(sorted_a) + length(sorted_b)
    by_word = np.where(lengths > 0, 200.0 * lcs_many(sorted_a, sorted_b) / np.maximum(lengths, 1), 100.0)
    parts = []
    for x, y in words:
        p, q = set(x), set(y)
        parts.append(tuple(" ".join(sorted(s)) for s in (p & q, p - q, q - p)))
    rest = lcs_many([p[1] for p in parts], [p[2] for p in parts])
    by_set = []
    for (x, y), (s, da, db), common in zip(words, parts, rest.tolist(), strict=True):
        if not x or not y:
            by_set.append(0.0)
            continue
        if s and (not da or not db):
            by_set.append(100.0)
            continue
        gap = bool(s)
        len_a, len_b = len(s) + gap + len(da), len(s) + gap + len(db)
        best = 200.0 * (len(s) + gap + common) / (len_a + len_b)
        by_set.append(max(best, 200.0 * len(s) / (len(s) + len_a), 200.0 * len(s) / (len(s) + len_b)) if s else best)
    scores = 0.25 * whole + 0.20 * partial_many(a, b) + 0.25 * by_word + 0.30 * np.array(by_set)
    return dict(zip(pairs, scores.tolist(), strict=True))


def fuzzy_score(a: Column, b: Column) -> Column:
    """To two places. Not deterministic for the planner, so that a filter on it doesn't compute it twice."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(s, 2) for s in fuzzy_many(x.fillna("").tolist(), y.fillna("").tolist())], dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()(a, b)


def sequence_score(a: Column, b: Column) -> Column:
    """The standard library's matching blocks instead, with the same rule for empty names."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 100.0 if x == y else 0.0
        return difflib.SequenceMatcher(None, x, y).ratio() * 100

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()(a, b)
