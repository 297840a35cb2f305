"""Scans leave rows out by products in single precision, and rank as before."""

import tracemalloc

import numpy as np
import pytest

from quiver.operators import ivf, pq
from quiver.operators.topk_kernel import Columns, TopK, exact, within


@pytest.mark.parametrize("metric", ["l2", "l2sq", "ip", "cosine"])
@pytest.mark.parametrize("size", [1.0, 1e-22, 1e9, 1e19])
def test_single_precision_ranks_exactly(metric, size):
    rng = np.random.default_rng(5)
    X = (rng.normal(size=(300, 12)) + 50).astype(np.float32)  # far from zero, so that products cancel
    X[100:200] = X[:100] * np.float32(1 + 1e-6)  # within single precision's rounding of one another
    X[200:220], X[220] = X[:20], 0
    X = (X * np.float32(size)).astype(np.float64)
    ids, Q = rng.permutation(300), X[::7]
    norms = np.sqrt((Q * Q).sum(1))
    D, _, _ = Columns(metric, X).distances(Q, norms)
    assert D.dtype == (np.float64 if size == 1e19 else np.float32)
    top = TopK(np.arange(len(Q)), Q, 9, metric)
    top.add(ids[:130], X[:130])
    top.add(ids[130:], X[130:])
    d = exact(metric, Q, np.broadcast_to(X, (len(Q), *X.shape)))
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :9]
    assert np.array_equal(top.best_i, ids[order])
    assert np.array_equal(top.best_d, np.take_along_axis(d, order, axis=1))


def test_rows_that_are_not_numbers_take_doubles():
    X = np.ones((8, 3))
    X[2, 1], X[3, 0] = np.nan, np.inf
    D, _, _ = Columns("l2", X).distances(np.ones((1, 3)), np.ones(1))
    assert D.dtype == np.float64


@pytest.mark.parametrize("width", [8, 13, 64])
def test_within_finds_what_is_not_over(width):
    rng = np.random.default_rng(1)
    D = rng.normal(size=(40, width)).astype(np.float32)
    D[3, 2], D[4] = np.nan, np.inf
    limit = np.where(np.arange(40) % 3 == 0, -9.0, rng.normal(size=40))
    limit[4] = np.inf
    limit[5] = D[5, 7]
    r, c = within(D, limit)
    want = np.nonzero(~(D.astype(np.float64) > limit[:, None]))
    assert set(zip(*want)) <= set(zip(r, c)) and (np.diff(r) >= 0).all()
    assert all(D[i, j] <= np.nextafter(np.float32(limit[i]), np.float32(np.inf)) or np.isnan(D[i, j]) for i, j in zip(r, c))


def test_lists_probed_by_all_queries_are_one_run():
    # Lists 0, 1, 3 are probed by queries 0-2, list 2 by query 1, list 4 by none.
    plan = (np.arange(3), None, np.array([0, 1, 2, 3]), np.array([0, 3, 6, 7, 10]), np.array([0, 1, 2, 0, 1, 2, 1, 0, 1, 2]))
    runs = ivf.list_runs(plan, np.array([0, 0, 1, 2, 2, 3, 4]), 0, 65_536)
    assert [(s.start, s.stop, None if q is None else q.tolist()) for s, q in runs] == [(0, 3, None), (3, 5, [1]), (5, 6, None)]
    runs = ivf.list_runs(plan, np.array([0, 0, 1, 2, 2, 3, 4]), 1, 2)
    assert [(s.start, s.stop, q) for s, q in runs] == [(0, 6, None)]


def test_codes_come_from_a_product():
    rng = np.random.default_rng(2)
    CB, X = rng.normal(size=(2, 256, 8)), rng.normal(size=(6000, 2, 8))
    CB[:, 9], CB[:, 200] = np.inf, CB[:, 3]  # a code that isn't there, two that are equal
    X[:50], X[50:80] = CB[:, 3], (CB[:, 4] + CB[:, 5]) / 2
    X[80, 0, 0] = np.nan
    tracemalloc.start()
    got = list(pq.nearest_codes(X, CB))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for s in range(2):
        diff = X[:, s, None, :] - CB[s][None]
        assert np.array_equal(got[s], np.einsum("ncd,ncd->nc", diff, diff).argmin(axis=1))
    assert most < 28 << 20  # differences of all codes took over 32 MiB


def test_training_sample_is_in_a_file_a_core(spark, monkeypatch):
    rows = spark.createDataFrame([([float(i % 7), float(i)],) for i in range(400)], "embed array<float>").coalesce(1)
    seen = []
    monkeypatch.setattr(pq, "scratch_dir", lambda *a, f=pq.scratch_dir: seen.append(f(*a)) or seen[-1])
    pq.train_codebooks(rows, 1, 2, bits=2, train_percent=100.0, iters=1)
    written = spark.read.parquet(seen[0])
    assert written.count() == 400 and len(written.inputFiles()) == spark.sparkContext.defaultParallelism
