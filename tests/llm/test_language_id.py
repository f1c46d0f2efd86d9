"""Operator 12 against plain Python, and its accuracy on held-out documents."""

import math
import os
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from simigraph.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2

SYLLABLES = {"aa": "ba ko mi lu sen", "bb": "tra vel ost gri ba", "cc": "щи да ро не"}


def corpus(n):
    rnd = random.Random(8)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 30))]
        out.append((i, " ".join(words).capitalize() + rnd.choice([".", " 12", "²!"]), lang, "s", 0))
    return out


def by_force(rows):
    """The model with tables of all words and n-grams, and predictions for all rows."""
    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split(" ")
    learnt = {r[:3] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None}
    docs, words, grams = Counter(), defaultdict(Counter), [defaultdict(Counter) for _ in range(language_id.LONGEST + 1)]
    for _, t, lang in learnt:
        docs[lang] += 1
        for w in filter(None, letters(t)):
            words[lang][w] += 1
            for n in range(1, language_id.LONGEST + 1):
                p = f" {w} "
                for i in range(len(p) - n + 1):
                    grams[n][lang][p[i : i + n]] += 1
    sets = {id(table): {u for c in table.values() for u in c} for table in (words, *grams)}
    units = lambda table: sets[id(table)]
    log = lambda table, u, lang: math.log((table[lang][u] + language_id.ALPHA) / (sum(table[lang].values()) + language_id.ALPHA * (len(units(table)) + 1)))
    out = []
    for i, t, *_ in rows:
        found = [w for w in letters(t or "") if w]
        if not found or not docs:
            out.append((i, "und", 0.0))
            continue
        sums = {lang: math.log(c / sum(docs.values())) for lang, c in docs.items()}
        for w in found:
            if w in units(words):
                for lang in sums:
                    sums[lang] += log(words, w, lang)
                continue
            for n in range(language_id.LONGEST, 0, -1):
                known = [g for k in range(len(w) + 3 - n) if (g := f" {w} "[k : k + n]) in units(grams[n])]
                if known:
                    for lang in sums:
                        sums[lang] += sum(log(grams[n], g, lang) for g in known) / len(known)
                    break
        best = min(sums, key=lambda x: (-sums[x], x))
        out.append((i, best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())))
    return out


def test_predictions_equal_brute_force(spark):
    rows = corpus(40)
    rows += [(100, None, "aa", "s", 0), (101, "", "bb", "s", 0), (102, "12 ½ _²", "aa", "s", 0), (103, "kotra zzz 漢字", None, "s", 0), (104, "漢字", None, "s", 0), (105, "Bami bami", "aa", "s", 0), (105, "Bami bami", "aa", "s", 0), (None, "Щида", "cc", "s", 0), (106, "ba", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, unit string, n long").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, held_out()).collect()), key=key)
    want = sorted(by_force(rows), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], rel=1e-6) for g, w in zip(got, want, strict=True))
    held = {r.doc_id: r.held_out for r in language_id.identify(docs, held_out()).collect()}
    assert held[None] is False and all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(40))


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", None, "s", 0), (2, None, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, unit string, n long")
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, held_out()).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), held_out()).count() == 0


def test_long_words_and_copies(spark):
    rows = corpus(60) + [(1000 + i, "Bako misen", "aa", "s", 0) for i in range(60)] + [(5000, "mi" * 300_000, None, "s", 0), (5001, "трос " * 200_000 + "щи", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, unit string, n long")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, held_out(), rows=30).collect()}
    assert got[5000] == "aa" and got[5001] == "cc" and len(got) == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test data isn't here")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").collect()}
    held = [r for r in queries.op12_language_id(spark, SF).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert len(held) > 200 and right / len(held) >= 0.97, right / len(held)
    assert all(0 <= r.score <= 1 for r in held)
