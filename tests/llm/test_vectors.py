"""Operator 13 against numpy on all rows at once."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from simigraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n int"


def table(spark, vectors, parts=5):
    rows = [(i, v, 1, "x", 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_force(vectors):
    x = np.array([[floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = x - Fraction(1, n) * np.array([Fraction(int(s)) for s in sums])
    centred = centred.astype(float)
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], columns[:, ::-1]


@pytest.mark.parametrize("dimensions", [3, 40])
def test_whitening_equals_direct_fit(spark, dimensions):
    rnd = random.Random(4)
    vectors = [[rnd.gauss(0, 1 + k % 7) + (3 if k == 1 else 0) for k in range(dimensions)] for _ in range(300)]
    vectors += [vectors[0]] * 150  # a third are copies
    bad = [None, [], [None] * dimensions, [float("nan")] * dimensions, [float("inf")] + [0.0] * (dimensions - 1), [1.0] * (dimensions - 1)]
    out = whitening.whiten(table(spark, vectors + bad)).collect()
    x, n, sums, centred, values, columns = by_force(vectors)
    assert sorted(r.vec_id for r in out) == list(range(n))
    k = min(32, dimensions)
    for r in out:
        assert r.n == n and r.identity_error < 1e-9 and len(r.whitened) == k
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert np.allclose(r.explained, values[:k] / values.sum(), rtol=1e-9)
        assert np.allclose(np.abs(r.whitened), np.abs(centred[r.vec_id] @ columns[:, :k] / np.sqrt(values[:k])), atol=1e-8)


def test_few_rows_and_no_variance(spark):
    out = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0]])).collect()
    assert [r.deviation for r in out] == [64**2 + 128**2] * 2 and out[0].identity_error < 1e-9
    assert {abs(round(r.whitened[0], 9)) for r in out} == {1.0} and {r.whitened[1] for r in out} == {0.0}
    one = whitening.whiten(table(spark, [[1.0, 2.0]])).first()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)
    assert whitening.whiten(table(spark, [None])).count() == 0
    assert whitening.whiten(table(spark, [[1.0]]).limit(0)).count() == 0


def test_values_out_of_range(spark):
    out = whitening.whiten(table(spark, [[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0]])).collect()
    assert len(out) == 3 and all(np.isfinite(r.whitened).all() for r in out)
    assert {r.deviation is None for r in out} == {True, False} or {r.deviation for r in out} == {None}


def test_merging_in_any_order():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-(10**6), 10**6, (1000, 5))
    cuts = [0, 1, 2, 500, 503, 999, 1000]
    parts = [whitening.moments(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    rnd.shuffle(parts)
    got = None
    for p in parts:
        got = whitening.merge(got, p)
    want = x - x.mean(axis=0)
    assert got.n == 1000 and got.sums == tuple(x.sum(axis=0).tolist())
    assert np.allclose(got.scatter, want.T @ want, rtol=1e-12)
