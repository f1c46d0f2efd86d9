"""Operator 12: language by known words, and by character n-grams for unseen ones.

A model is fitted on labelled documents: how often each word occurs in each
language, and how often each n-gram of up to LONGEST characters does in the
padded words. A text's words (runs of letters, lower-cased) are scored one by one:
a word of the model by its log frequency in each language; any other by the mean
log frequency of those of its n-grams that the model has, of the longest length at
which it has any. A word none of whose n-grams is known says nothing. The
language with the largest sum, with the log share of its documents added, wins
(ties: the first in order), and its posterior is the score.

Fitting takes at most about SAMPLE_ROWS different labelled rows, chosen by their
hash, whole texts of each; where there are fewer, all. The model holds the WORDS
most frequent words of at most WORD_CHARS characters and the GRAMS most frequent
n-grams of each length (ties: in order), so what is broadcast has a bound that
doesn't grow with the table. Everything else covers all rows.

Null texts and texts without a letter are ``und`` with score 0, as are all where
no row could be learnt from. Rows without a language aren't learnt from. Repeated
rows are learnt from once and predicted each. A null id is not held out. Very long
texts and words are read whole. An empty table gives no rows. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

#: Rows to learn from, words and n-grams (of each length) of the model, characters of a word it may hold.
SAMPLE_ROWS, WORDS, GRAMS, WORD_CHARS = 40_000, 100_000, 50_000, 40
LONGEST = 4
#: Additive smoothing of words and n-grams.
ALPHA = 0.5
#: Marks the ends of a word, and is no letter.
END = " "
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
#: Scores of unseen words that a worker remembers.
MEMO = 200_000


@dataclass(frozen=True)
class Model:
    """Log frequencies by language, one row for each word and n-gram; ``grams`` by length."""

    languages: tuple[str, ...]
    prior: np.ndarray
    words: dict[str, int]
    grams: tuple[dict[str, int], ...]
    word_logs: np.ndarray
    gram_logs: tuple[np.ndarray, ...]

    def unseen(self, word: str) -> np.ndarray | None:
        padded = END + word + END
        for n in range(LONGEST, 0, -1):
            known = self.grams[n - 1]
            found = [k for i in range(len(padded) - n + 1) if (k := known.get(padded[i : i + n])) is not None]
            if found:
                return self.gram_logs[n - 1][found].mean(axis=0)
        return None

    def predict(self, text: str | None, memo: dict[str, np.ndarray | None]) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total, rows, times = self.prior.copy(), [], []
        for w, c in Counter(words).items():
            k = self.words.get(w)
            if k is not None:
                rows.append(k)
                times.append(c)
                continue
            if w not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = self.unseen(w)
            if (logs := memo[w]) is not None:
                total += logs * c
        if rows:
            total += np.array(times, np.float64) @ self.word_logs[rows]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _logs(rows: list[tuple[str, str, int]], totals: dict[str, int], languages: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """Places of the units, and their smoothed log frequencies by language."""
    places = {u: k for k, u in enumerate(sorted({r[0] for r in rows}))}
    counts = np.zeros((len(places), len(languages)))
    at = {name: k for k, name in enumerate(languages)}
    for unit, language, n in rows:
        counts[places[unit], at[language]] += n
    whole = np.array([totals.get(name, 0) for name in languages])
    return places, np.log((counts + ALPHA) / (whole + ALPHA * (len(places) + 1)))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """unit, lang and n of the most frequent units of (unit, lang, n)."""
    top = counts.groupBy("unit").agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), "unit").limit(most).select("unit")
    return counts.join(F.broadcast(top), "unit", "left_semi")


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and text of about so many different rows of (doc_id, text, lang), by their hash; of all if there are fewer."""
    n = labelled.count()
    share = min(1.0, rows / n) if n else 0.0
    hashed = labelled.withColumn("_h", F.xxhash64("doc_id", "lang", "text"))
    some = hashed if share >= 1 else hashed.where(F.shiftrightunsigned("_h", 1) < F.lit(int(share * (1 << 63))))
    return some.dropDuplicates(["_h"]).select("lang", "text")


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """From (doc_id, text, lang)."""
    texts = common.materialise(sample(labelled, rows), "sample")
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("unit"))
    counted = common.materialise(words.groupBy("unit", "lang").agg(F.count("*").alias("n")), "words")
    shares = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages
    languages = tuple(sorted(shares))
    word_totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    take = lambda df: [(r["unit"], r["lang"], r["n"]) for r in df.collect()]  # noqa: E731  at most WORDS or GRAMS units
    places, logs = _logs(take(_frequent(counted.where(F.length("unit") <= WORD_CHARS), WORDS)), word_totals, languages)
    padded = F.concat(F.lit(END), "unit", F.lit(END))
    grams, gram_logs = [], []
    for n in range(1, LONGEST + 1):
        starts = F.sequence(F.lit(1), F.length("unit") + 3 - n)
        each = counted.where(F.length("unit") + 2 >= n).select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).alias("unit"))  # noqa: B023
        by = common.materialise(each.groupBy("unit", "lang").agg(F.sum("n").alias("n")), "grams")
        totals = {r["lang"]: r["n"] for r in by.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        found, found_logs = _logs(take(_frequent(by, GRAMS)), totals, languages)
        grams.append(found)
        gram_logs.append(found_logs)
        common.discard(by)
    common.discard(texts, counted)
    all_rows = sum(shares.values())
    return Model(languages, np.array([math.log(shares[x] / all_rows) for x in languages]), places, tuple(grams), logs, tuple(gram_logs))


def predict(docs: DataFrame, model: Broadcast[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray | None] = {}
        for b in batches:
            found = [model.value.predict(t.as_py(), memo) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; learns from those that aren't held out and have text and language."""
    spark = docs.sparkSession
    common.ship(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(named.where("not held_out and text is not null and lang is not null").select("doc_id", "text", "lang"), rows)
    return predict(named.select("doc_id", "held_out", "text"), spark.sparkContext.broadcast(model))
