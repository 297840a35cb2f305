"""Whitening against numpy's own eigendecomposition of the integer covariance."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiver.llm import whitening as W


def plain(vectors, k=8):
    """n, deviations, whitened (signs apart), explained, by Python integers and one eigendecomposition."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    exact = [[sum(r[i] * r[j] for r in far) for j in range(d)] for i in range(d)]
    cov = np.array([[v / n**3 for v in row] for row in exact])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, d)
    return n, [sum(c * c for c in r) for r in far], np.array(far) / n @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, w string, component string").repartition(parts, "vec_id")


def check(got, ids, vectors):
    n, deviation, whitened, explained = plain(vectors)
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    k = whitened.shape[1]
    assert set(rows) == {(i, c) for i in ids for c in range(1, k + 1)}
    ours = np.array([[rows[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((ours * whitened).sum(0))
    assert np.abs(ours - whitened * signs).max() < 1e-7
    for i, v in zip(ids, deviation, strict=True):
        assert all(rows[i, c].deviation == v and rows[i, c].n == n for c in range(1, k + 1))
    assert np.allclose([rows[ids[0], c].explained for c in range(1, k + 1)], explained, rtol=1e-9)
    assert max(r.identity_error for r in rows.values()) < 1e-9 and len({r.identity_error for r in rows.values()}) == 1


def test_query_on_the_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(W.op12_embedding_whitening(spark, sf), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows_are_left_out_and_a_hot_vector_is_deflated(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(90, 10)) * np.arange(1, 11) / 10).astype(np.float32).tolist()
    vectors[30:60] = [vectors[0]] * 30
    rows = [(i, v, "clash", "clash") for i, v in enumerate(vectors)]
    odd = [None, [], [None] * 10, [float("nan")] + [0.0] * 9, [float("inf")] + [0.0] * 9, [1.0] * 9, [3e38] * 10]
    got = W.whiten(spark, frame(spark, [*rows, *((1000 + i, v, "x", None) for i, v in enumerate(odd))], 40))
    check(got, list(range(90)), vectors)
    null = W.whiten(spark, frame(spark, [(None, v, "", "") for v in vectors[:30]])).collect()
    assert len(null) == 30 * 8 and {r.vec_id for r in null} == {None}


def test_nothing_to_whiten(spark):
    one = [0.5, 0.25]
    assert W.whiten(spark, frame(spark, [])).count() == 0
    assert W.whiten(spark, frame(spark, [(1, None, "", "")])).count() == 0
    assert W.whiten(spark, frame(spark, [(i, one, "", "") for i in range(5)])).count() == 0
    line = W.whiten(spark, frame(spark, [(i, [i / 4, i / 2], "", "") for i in range(5)]))
    assert {r.component for r in line.collect()} == {1}


def test_every_level_of_the_merge(spark):
    rng = np.random.default_rng(5)
    laid = W.lattice(spark, frame(spark, [(i, v, "", "") for i, v in enumerate(rng.normal(size=(400, 4)).tolist())], 8))
    many = laid.repartition(20, "key")
    few, lots = W.fit(spark, laid), W.fit(spark, many)
    assert few.n == lots.n == 400 and (few.sums == lots.sums).all()
    assert np.allclose(few.values, lots.values, rtol=1e-12) and np.allclose(np.abs((few.vectors * lots.vectors).sum(0)), 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([0.0, 1.0, 1e-9]))
def test_rank_one_updates_equal_a_fresh_decomposition(dim, n, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(n, dim)) + spread * rng.normal(size=(n, dim))
    whole, half = W.Spectrum(dim), W.Spectrum(dim)
    whole.add(x[: n // 2])
    half.add(x[n // 2 :])
    whole.merge(W.Spectrum.unpacked(*half.packed().values()))
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    scale = max(1.0, np.abs(scatter).max())
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-11 * scale
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(dim)).max() < 1e-11
    assert (np.diff(whole.values) >= 0).all()


@pytest.mark.parametrize("rho", [1e-8, 1.0, 1e8])
def test_roots_lie_between_the_poles(rho):
    rng = np.random.default_rng(1)
    d = np.sort(rng.normal(size=30))
    z2 = rng.random(30) ** 8
    near, t = W.secular_roots(d, z2, rho)
    exact = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(d[near] + t, exact, rtol=0, atol=1e-13 * max(1, rho * 10))
