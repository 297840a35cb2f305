"""Filtered search through IVF and PQ under a selective filter: full result lists, and bounds that hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.operators import expand, ivf, pq
from quiver.operators.knn import knn
from quiver.operators.topk_kernel import exact

DIM, K = 8, 5


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, DIM)) * 4
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, DIM))
    x[7] = 0.0
    rows = [(i, v.astype(np.float32).tolist(), int(i * 37 % 100)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embed array<float>, i32v int")


def rows_of(df):
    return sorted((r.qid, r.rk, r.id, None if r.d is None else round(r.d, 5)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine", "ip"])
def test_short_queries_get_the_nearest_of_all_lists(spark, metric, monkeypatch):
    monkeypatch.setattr(expand, "GROWTH", 2)
    v = table(spark)
    q = v.where("id < 40").select(F.col("id").alias("qid"), "embed")
    index = ivf.build_ivf(v, lists=12, metric=metric, train_percent=100, n_probes=1)
    few = F.col("i32v") < 4  # 16 rows
    plain = index.search(q, K, where=few, fill=False)
    counts = {r.qid: r["count"] for r in plain.groupBy("qid").count().collect()}
    short = [i for i in range(40) if counts.get(i, 0) < K]
    assert len(short) > 10
    got, want = rows_of(index.search(q, K, where=few)), rows_of(knn(v, q, K, metric, where=few))
    assert [r for r in got if r[0] in short] == [r for r in want if r[0] in short]
    assert [r for r in got if r[0] not in short] == [r for r in rows_of(plain) if r[0] not in short]
    none = F.col("i32v") < 1  # 4 rows, under k
    got = index.search(q, K, where=none)
    assert rows_of(got) == rows_of(knn(v, q, K, metric, where=none)) and got.count() == 160
    assert index.search(q, K, where=F.col("i32v") < 0).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_codes_alone_equal_probing_every_list(spark, metric):
    v = table(spark, seed=1)
    q = v.where("id < 30").select(F.col("id").alias("qid"), "embed")
    index = pq.build_ivfpq(v, 4, DIM, lists=10, bits=4, metric=metric, train_percent=100, n_probes=1)
    few = F.col("i32v") < 3
    plain = {r.qid: r["count"] for r in index.search(q, K, where=few, fill=False).groupBy("qid").count().collect()}
    every, got = rows_of(index.search(q, K, where=few, n_probes=10)), rows_of(index.search(q, K, where=few))
    short = {i for i in range(30) if plain.get(i, 0) < K}
    assert len(short) > 10
    assert [r for r in got if r[0] in short] == [r for r in every if r[0] in short]


def test_radii_are_stored_and_follow_appended_rows(spark, tmp_path):
    v = table(spark, seed=2)
    index = ivf.build_ivf(v, lists=6, train_percent=100, path=f"{tmp_path}/idx")
    first = index.radii()
    assert ivf.exists(spark, f"{tmp_path}/idx/list_radii/_SUCCESS")
    assert np.array_equal(ivf.load_ivf(spark, f"{tmp_path}/idx").radii()[np.argsort(ivf.load_ivf(spark, f"{tmp_path}/idx").centroid_matrix()[0])],
                          first[np.argsort(index.centroid_matrix()[0])])
    far = spark.createDataFrame([(9000, [100.0] * DIM, 0)], "id long, embed array<float>, i32v int")
    more = ivf.with_appended(index, ivf.assign(far, index.centroids))
    assert more.radii().max() > 200 > first.max()
    q = spark.createDataFrame([(1, [-50.0] * DIM)], "qid long, embed array<float>")
    assert 9000 in {r.id for r in more.search(q, 3, where=F.col("id").isin(9000, 0, 1), n_probes=1).collect()}
    again = ivf.recreate_index(v.where("id < 50"), f"{tmp_path}/idx", lists=6, train_percent=100)
    assert not ivf.exists(spark, f"{tmp_path}/idx/list_radii/_SUCCESS") and again.radii().max() <= first.max() * 2


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["l2", "l2sq", "ip", "cosine"]), st.integers(0, 10**6), st.floats(0.01, 100))
def test_no_row_is_under_its_lists_bound(metric, seed, scale):
    rng = np.random.default_rng(seed)
    X, Q = rng.normal(size=(30, 5)) * scale, rng.normal(size=(6, 5)) * scale
    X[0] = 0
    C = rng.normal(size=(1, 5)) * scale
    stored = expand.unit(X) if metric == "cosine" else X
    r = np.array([np.sqrt(((stored - C) ** 2).sum(1)).max()])
    D = exact(metric, Q, np.repeat(X[None], 6, axis=0))
    low = expand.lower_bounds(metric, Q, C, r)
    assert (low <= D + 1e-9 * scale * scale).all()


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_pq_distances_are_those_of_the_coded_vectors(metric):
    rng = np.random.default_rng(4)
    cen, CB, codes = rng.normal(size=8), rng.normal(size=(4, 6, 2)), rng.integers(0, 6, (20, 4))
    Q = rng.normal(size=(3, 8))
    decoded = cen + np.concatenate([CB[s, codes[:, s]] for s in range(4)], axis=1)
    unit = expand.unit(Q) if metric == "cosine" else Q
    want = (1 if metric == "cosine" else 0) - unit @ decoded.T
    assert np.allclose(pq.table_distances(metric, Q, cen, codes, CB), want)
