"""Operators 1, 7, 10 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simigraph.llm import bpe_chunks, token_cache, token_files
from simigraph.llm.queries import BYTE_BPE, PIECES, WORD_BPE
from simigraph.llm.tokens import encoder

TRICKY = ["", " ", "\n", " \n a", "a\n\n b", "it's 'S don't\t x", "a<|endoftext|>b <|startoftext|> c", "İstanbul ΣΑΣ ﬁ ½ x²", "a▁b ▁ c", "  lead", "trail  ", "x y z", "é é", "\x1cabc\x1d d", "\x00 a", "a\r\nb", "x" * 3000, "漢" * 2500, "a \n\t b", "a "]


def random_texts(n, size):
    rnd = random.Random(7)
    return ["".join(rnd.choice(" \n\tab'stré.,!?#1²ﬁİΣ文▁<|é\r" + "abc" * 9) for _ in range(rnd.randint(1, size))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "path"), [("word", WORD_BPE), ("byte", BYTE_BPE)])
def test_encoders_equal_the_library(kind, path):
    e = encoder(kind, path)
    for t in TRICKY + random_texts(300, 60):
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_piece_counts_equal_the_library():
    e = encoder("piece", PIECES)
    assert e.splits
    for t in TRICKY + random_texts(300, 60):
        assert e.count(t) == len(e.sp.encode(t)), t[:50]


def test_chunks_equal_the_library():
    e = encoder("byte", BYTE_BPE)
    store = bpe_chunks.Store(e)
    shared = " ".join(random_texts(30, 400))
    for t in [*TRICKY, *random_texts(60, 9000), shared, "x " + shared, shared + " y"]:
        ids = bpe_chunks.encode(e, store, t)
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids
        assert bpe_chunks.decode(e, ids) == e.tok.decode(ids.tolist(), skip_special_tokens=False)
    assert store.hits >= 4


@given(st.lists(st.integers(0, 40), max_size=400), st.integers(6, 9))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip_and_limit(ids, longest):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=41)
    lengths = token_files.code_lengths(counts, longest)
    used = lengths[lengths > 0].astype(float)
    assert len(used) == np.count_nonzero(counts) and (len(used) == 0 or (used.max() <= longest and (2.0**-used).sum() <= 1))
    book = token_files.Codebook(lengths)
    block = token_files.write_block(book, [3, None], [len(ids), 0], ids)
    docs, sizes, back = token_files.read_block(book, block)
    assert docs == [3, None] and sizes.tolist() == [len(ids), 0] and back.tolist() == ids.tolist()


def test_code_lengths_are_the_best_where_the_limit_is_far():
    import heapq

    rnd = random.Random(1)
    counts = np.array([rnd.randint(1, 1000) for _ in range(60)])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (token_files.code_lengths(counts).astype(int) * counts).sum() == cost


def test_token_files(spark, odd, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(odd, path, WORD_BPE, 1)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    tok = encoder("word", WORD_BPE).tok
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 3, 4, 5, 6, 7]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        if r.doc_id is not None:
            assert r.ids == [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    token_files.write_token_files(odd.limit(0), f"{path}-none", WORD_BPE, 1)
    assert token_files.read_token_files(spark, f"{path}-none").count() == 0


def test_token_cache_counts_once(spark, odd, tmp_path):
    cache = f"file://{tmp_path}/cache"
    sp = encoder("piece", PIECES).sp
    out = token_cache.count_tokens(odd, cache, PIECES, 4096).collect()
    assert len(out) == 10
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for r in out:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    stored = spark.read.parquet(cache)
    distinct = stored.select("digest").distinct().count()
    assert distinct == 5
    n = stored.count()
    token_cache.count_tokens(odd, cache, PIECES, 4096).count()
    assert spark.read.parquet(cache).count() == n  # nothing was missing
    # Another version's counts aren't used.
    other = token_cache.read_cache(spark, cache, "another")
    assert other.count() == 0
    assert token_cache.count_tokens(odd.limit(0), f"{cache}2", PIECES, 1).count() == 0


def test_encode_decode(odd):
    tok = encoder("byte", BYTE_BPE).tok
    out = bpe_chunks.encode_decode(odd, BYTE_BPE).collect()
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for r in out:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert r.ids == tok.encode(t, add_special_tokens=False).ids and r.decoded == t
    d = bpe_chunks.encode_decode(odd.where("doc_id = 7"), BYTE_BPE, digests=True).first()
    ids = tok.encode(texts[7], add_special_tokens=False).ids
    assert d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert d.decoded_sha256 == hashlib.sha256(texts[7].encode()).hexdigest()


def test_vocabularies_are_where_the_parameter_says():
    assert WORD_BPE == public_tokenizers.path("word_bpe_49k.json")
