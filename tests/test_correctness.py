"""Cases in which an answer was once wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import where
from quiver.operators import dml, graph, ivf, knn, pq
from quiver.operators.topk_kernel import TopK, exact
from quiver.plans.config_index import build_from_config
from quiver.schema import queries_from, vectors
from quiver.sources.text import read_csv
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine", "ip"])
@pytest.mark.parametrize("spread", [1e-8, 1e-7, 1e-6, 1.0])
def test_close_vectors_far_from_the_origin(metric, spread):
    rng = np.random.default_rng(1)
    X = (rng.normal(size=64) * 10 + rng.normal(size=(1500, 64)) * spread).astype(np.float64)
    X[700] = X[3]  # an equal pair: the smaller id wins
    ids = rng.permutation(1500).astype(np.int64)
    top = TopK(ids[:40], X[:40], 10, metric)
    for a in range(0, 1500, 400):
        top.add(ids[a:a + 400], X[a:a + 400])
    for q in range(40):
        d = np.nan_to_num(exact(metric, X[q:q + 1], X[None])[0], nan=np.inf)
        want = np.lexsort((ids, d))[:10]
        assert np.array_equal(top.best_d[q], d[want])
        assert np.array_equal(top.best_i[q], ids[want])


def test_graph_filter_returns_eligible_rows_only(spark):
    v = vectors(spark, SF_SMALL)
    index = graph.build_graph(v, 8, 16, itopk=16, n_seeds=4, max_iter=6)
    cond = where(i32v_lt=300)
    qs = queries_from(v.where("id < 20"))
    good = {r["id"] for r in v.where(cond).select("id").collect()}
    for mode in ("pre", "normal", "post"):
        rows = knn.search(v, qs, 5, "l2", where=cond, mode=mode, index=index).collect()
        assert rows and {r["id"] for r in rows} <= good
    with pytest.raises(TypeError):
        index.search(qs, 5, unknown=1)


def test_metric_of_the_index_must_match(spark):
    v = vectors(spark, SF_SMALL)
    index = ivf.build_ivf(v, metric="cosine", centroids=ivf.centroids_from_labels(v))
    with pytest.raises(ValueError, match="ranks by"):
        knn.search(v, queries_from(v), 3, "l2", index=index)


def test_load_rejects_repeated_ids(spark):
    v = vectors(spark, SF_SMALL).select("id", "embed", "i32v", "f32v", "strv")
    new = v.where("id < 3").withColumn("id", F.lit(10**6).cast("long"))
    with pytest.raises(ValueError, match="repeat"):
        dml.bulk_load(v, new)


def test_mix_never_reuses_an_id(spark):
    v = vectors(spark, SF_SMALL).where("id < 6").select("id", "embed", "i32v", "f32v", "strv")
    out, stats = dml.mix(v, 60, (5, 1, 4), 10, seed=3, report=True)
    rows = [r["id"] for r in out.select("id").collect()]
    inserted = sum(r["inserted"] for r in stats.collect())
    assert len(rows) == len(set(rows)) == 6 + inserted - sum(r["deleted"] for r in stats.collect())
    assert max(rows) <= 5 + inserted
    b = stats.where("batch = 0").first()
    assert (b["planned_insert"], b["planned_update"], b["planned_delete"]) == (5, 1, 4)


def test_malformed_vector_fails_at_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,vector,i32v,f32v,str\n1,"[1,2,x]",1,0.5,a\n')
    with pytest.raises(Exception, match="not a vector"):
        read_csv(spark, [str(tmp_path / "a.csv")]).collect()


def test_config_probes_and_width(spark):
    v = vectors(spark, SF_SMALL)
    index = build_from_config(v, {"index": {"type": "ivfflat", "lists": 4, "n_probes": 3}})
    assert index.n_probes == 3
    walk = build_from_config(v, {"index": {"type": "cagra", "graph_degree": 4, "intermediate_graph_degree": 8, "search_width": 7}})
    assert walk.search_width == 7


def test_pq_memory_is_tiled():
    rng = np.random.default_rng(0)
    CB = rng.normal(size=(4, 16, 4))
    codes, ids = rng.integers(0, 16, (2000, 4)), np.arange(2000)
    Q = rng.normal(size=(6000, 16))
    import tracemalloc

    tracemalloc.start()
    got = pq.pq_candidates(Q, np.zeros(16), codes, ids, CB, 5, 0, None, "l2sq")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and got[0].shape == (6000, 5)
    one = pq.pq_candidates(Q[5999:], np.zeros(16), codes, ids, CB, 5, 0, None, "l2sq")
    assert np.array_equal(one[1][0], got[1][5999])
