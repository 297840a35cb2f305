"""Property tests: invariants that hold for any data."""

import os

import pytest
from pyspark.sql import functions as F

from quiver.operators import dml, graph, ivf, knn, pq, recall
from quiver.schema import queries_from, vectors
from quiver.sources import generate as gen
from tests.conftest import SF_CHECK


def _ids(df):
    return [(r["qid"], r["id"], r["rk"]) for r in df.orderBy("qid", "rk").collect()]


@pytest.fixture(scope="module")
def v(spark):
    return vectors(spark, SF_CHECK).cache()


@pytest.fixture(scope="module")
def exact10(v):
    return knn.knn(v, queries_from(v), 10, "l2").cache()


def _recall(res, exact, k=10):
    gt = recall.gt_from_results(exact)
    return recall.gt_recall(res, gt, k).first()["recall_rate"]


def test_exact_self_recall_is_one(v):
    res = knn.knn(v, queries_from(v), 1, "l2")
    r = recall.self_recall(res, v.withColumnRenamed("id", "qid")).first()
    assert r["recall"] == 1.0 and r["total"] == 500


def test_metrics_agree_on_unit_vectors(v):
    outs = [_ids(knn.knn(v, queries_from(v), 5, m).select("qid", "id", "rk")) for m in ("l2", "l2sq", "cosine", "ip")]
    assert outs[0] == outs[1] == outs[2] == outs[3]


def test_plan_shapes_agree(v, exact10):
    base = _ids(exact10)
    for dist in ("single", "replicated"):
        assert _ids(knn.knn(v, queries_from(v), 10, "l2", distribution=dist)) == base
    # Grid plan, forced by tiny budgets: several query and corpus blocks.
    assert _ids(knn.knn(v, queries_from(v), 10, "l2", broadcast_bytes=1, block_bytes=20_000)) == base


def test_ivf_all_lists_equals_exact(v, exact10):
    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=10)
    assert _ids(idx.search(queries_from(v), 10)) == _ids(exact10)


def test_ivf_small_cells_equal_one_cell(v):
    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=3)
    a = _ids(idx.search(queries_from(v), 10))
    b = _ids(idx.search(queries_from(v), 10, block_bytes=4_000))  # many (list, csplit, qsplit) cells
    assert a == b


def test_ivf_recall_monotone_in_probes(v, exact10):
    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v))
    rs = [_recall(idx.search(queries_from(v), 10, n_probes=p), exact10) for p in (1, 3, 10)]
    assert rs[0] <= rs[1] <= rs[2] == 1.0


def test_ivf_kmeans_build_and_save(spark, v, exact10, tmp_dir):
    idx = ivf.build_ivf(v, lists=8, metric="l2", train_percent=100.0, n_probes=8, path=f"{tmp_dir}/idx")
    assert idx.lists.count() == 500
    assert _recall(idx.search(queries_from(v), 10), exact10) == 1.0
    again = ivf.load_ivf(spark, f"{tmp_dir}/idx")
    assert again.meta["type"] == "ivfflat" and again.centroids.count() == 8
    ivf.drop_index(spark, f"{tmp_dir}/idx")
    assert v.count() == 500  # the table is untouched


def test_lists_rule():
    assert ivf.lists_rule(5_000) == 10
    assert ivf.lists_rule(500_000) == 500
    assert ivf.lists_rule(4_000_000) == 2000


def test_pq_rerank_not_worse(v, exact10):
    cb = pq.codebook_from_labels(v, 8, 64)
    plain = pq.build_ivfpq(v, 8, 64, lists=1, codebook=cb)
    rr = pq.build_ivfpq(v, 8, 64, lists=1, codebook=cb, rerank=4)
    assert _recall(rr.search(queries_from(v), 10), exact10) >= _recall(plain.search(queries_from(v), 10), exact10)


def test_ivfpq_trained(v, exact10):
    idx = pq.build_ivfpq(v, 8, 64, lists=4, bits=4, train_percent=100.0, n_probes=4, rerank=8)
    assert _recall(idx.search(queries_from(v), 10), exact10) > 0.8


def test_graph_search_recall(v, exact10):
    g = graph.build_graph(v, 8, 16, "l2", itopk=32, search_width=4, n_seeds=9, max_iter=8)
    assert _recall(g.search(queries_from(v), 10), exact10) >= 0.9


def test_generator_independent_of_partitions(spark):
    a = gen.generate(spark, 300, 8, seed=3, partitions=1).orderBy("id").collect()
    b = gen.generate(spark, 300, 8, seed=3, partitions=7).orderBy("id").collect()
    assert a == b
    r = a[0]
    assert 5 <= len(r["strv"]) <= 9 and 0 <= r["i32v"] < 1000 and 0 <= r["f32v"] < 1
    assert abs(sum(x * x for x in r["embed"]) - 1.0) < 1e-5


def test_delete_insert_arithmetic(v):
    t = v.select("id", "embed", "i32v", "f32v", "strv")
    t2 = dml.delete(dml.insert(t, 40, 64, family="fast"), dml.sample_ids(t, 25))
    assert t2.count() == 500 + 40 - 25
    assert t2.select("id").distinct().count() == t2.count()


def test_mix_counts():
    assert dml.mix_counts(1000, (1, 8, 1)) == (100, 800, 100)
    assert dml.mix_counts(7, (1, 1, 1)) == (2, 2, 3)


def test_sample_paths_agree(v):
    a = sorted(r["id"] for r in dml.sample_ids(v, 123, 5, "md5").collect())
    b = sorted(r["id"] for r in dml.sample_ids(v, 123, 5, "md5", take_ordered_max=0).collect())
    assert a == b and len(a) == 123


def test_stream_generator(spark, tmp_dir):
    """The rate source never runs dry: run a few micro-batches, then stop."""
    import time

    from quiver.streaming import maintain

    s = maintain.generator_stream(spark, 8, rows_per_batch=50, start_id=10)
    q = s.writeStream.format("memory").queryName("gen_stream").trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.sql("SELECT count(*) AS n FROM gen_stream").first()["n"] < 100:
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM gen_stream").orderBy("id").collect()
    assert len(got) >= 100 and got[0]["id"] == 10
    assert [r["id"] for r in got] == list(range(10, 10 + len(got)))
    expected = gen.generate(spark, len(got), 8, start_id=10).orderBy("id").collect()
    assert got == expected


def test_saved_index_reads_only_probed_lists(spark, v, tmp_dir):
    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=1, path=f"{tmp_dir}/p")
    one = queries_from(v).where("qid = 3")
    res = idx.search(one, 5)
    import re

    lid = [r["list_id"] for r in idx.probes(one, 1).collect()]
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"list_id#\d+ (= {lid[0]}\b|IN \({lid[0]}\))", plan)
    assert len(lid) == 1 and res.count() == 5


def _beam_reference(vecs, adj, q, seeds, itopk, width, max_iter, k):
    """Brute-force beam search with the documented rules, for one query."""
    import numpy as np

    def dist(i):
        return float(np.sqrt(((vecs[i] - q) ** 2).sum()))

    beam = {i: dist(i) for i in seeds}
    beam = dict(sorted(beam.items(), key=lambda x: (x[1], x[0]))[:itopk])
    visited = set()
    for _ in range(max_iter):
        opened = sorted(((d, i) for i, d in beam.items() if i not in visited))[:width]
        if not opened:
            break
        visited |= {i for _, i in opened}
        new = {n for _, i in opened for n in adj.get(i, ()) if n not in beam}
        beam.update({n: dist(n) for n in new})
        beam = dict(sorted(beam.items(), key=lambda x: (x[1], x[0]))[:itopk])
    return [i for i, _ in sorted(beam.items(), key=lambda x: (x[1], x[0]))[:k]]


def test_graph_search_equals_brute_force_beam(spark):
    import numpy as np

    from quiver.operators.dml import sample_ids

    small = vectors(spark, "/root/testdata/sf0.001")
    g = graph.build_graph(small, 8, 16, "l2", itopk=16, search_width=2, n_seeds=5, max_iter=6)
    got = {}
    for r in g.search(queries_from(small), 5).collect():
        got.setdefault(r["qid"], []).append((r["rk"], r["id"]))
    vecs = {r["id"]: np.array(r["embed"], dtype=np.float64) for r in small.select("id", "embed").collect()}
    adj = {}
    for r in g.edges.orderBy("src", "rank").collect():
        adj.setdefault(r["src"], []).append(r["dst"])
    seeds = [r["id"] for r in sample_ids(g.vectors.select("id"), 5, g.seed).collect()]
    for qid, q in vecs.items():
        ref = _beam_reference(vecs, adj, q, seeds, 16, 2, 6, 5)
        assert [i for _, i in sorted(got[qid])] == ref, qid


@pytest.mark.parametrize(
    "cfg,floor",
    [
        ({"index": {"type": "bruteforce", "op_type": "vector_l2_ops"}}, 1.0),
        ({"index": {"type": "ivfflat", "lists": 8, "op_type": "vector_l2_ops"}, "env": {"probe_limit": 8,
                                                                                       "kmeans_train_percent": 100}}, 1.0),
        ({"index": {"type": "ivfpq", "lists": 4, "m": 8, "bits_per_code": 4, "op_type": "vector_l2_ops"}, "dimension": 64,
          "env": {"probe_limit": 4, "kmeans_train_percent": 100}}, 0.3),
        ({"index": {"type": "cagra", "graph_degree": 8, "intermediate_graph_degree": 16, "itopk_size": 32,
                    "quantization": "float16", "op_type": "vector_l2_ops"}}, 0.85),
        ({"index": {"type": "hnsw", "m": 8, "ef_construction": 16, "ef_search": 32, "op_type": "vector_l2_ops"}}, 0.85),
    ],
)
def test_build_from_config(v, exact10, cfg, floor):
    from quiver.plans.config_index import build_from_config

    idx = build_from_config(v.select("id", "embed", "i32v", "f32v", "strv"), cfg)
    assert _recall(idx.search(queries_from(v), 10), exact10) >= floor


def test_ivf_broadcast_plan_equals_cell_plan(v):
    from quiver.functions import filters as flt

    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=3)
    cond = flt.where(i32v_lt=500)
    a = _ids(idx.search(queries_from(v), 10, where=cond))
    b = _ids(idx.search(queries_from(v), 10, where=cond, broadcast_bytes=1, block_bytes=6_000))
    assert a == b
    fa = sorted(tuple(r) for r in idx.search(queries_from(v), 10, flag=cond).collect())
    fb = sorted(tuple(r) for r in idx.search(queries_from(v), 10, flag=cond, broadcast_bytes=1).collect())
    assert fa == fb


@pytest.mark.parametrize("rr", [0, 3])
def test_pq_broadcast_plan_equals_cell_plan(v, rr):
    idx = pq.build_ivfpq(v, 8, 64, lists=4, bits=4, train_percent=100.0, n_probes=2, rerank=rr)
    a = _ids(idx.search(queries_from(v), 10))
    b = _ids(idx.search(queries_from(v), 10, broadcast_bytes=1))
    assert a == b


def test_config_parsing_aliases():
    from quiver.schema import Config

    c = Config.from_json('{"index": {"type": "ivfflat", "n_lists": 7, "op_type": "vector_cosine_ops"}, '
                         '"dimension": 64, "env": {"probe_limit": 3, "kmeans_train_percent": 20}}')
    assert c.index.lists == 7 and c.metric == "vector_cosine_ops" and c.probe_limit == 3
    assert c.kmeans_train_percent == 20.0 and c.dimension == 64


def test_table_lifecycle(spark, tmp_dir):
    path = f"{tmp_dir}/tbl"
    t = dml.create_table(spark, path, 64)
    assert t.count() == 0 and t.columns == ["id", "embed", "i32v", "f32v", "strv"]
    assert t.schema["embed"].metadata == {"dim": 64}
    assert dml.max_id(t).first()["max_id"] == 0
    assert sorted(r["id"] for r in dml.insert(t, 3, 64).collect()) == [1, 2, 3]  # empty table: first id is 1
    rows = gen.generate(spark, 30, 64, start_id=1)
    v1 = dml.write_version(dml.bulk_load(t, rows), path + "_versions", 1)
    assert spark.read.parquet(v1).count() == 30
    with pytest.raises(ValueError):
        dml.bulk_load(spark.read.parquet(v1), rows)  # ids already present
    dml.drop_table(spark, path)
    assert not os.path.exists(path)


def test_recreate_and_chunks(spark, v, tmp_dir):
    chunks = [v.where(F.col("id") < 200), v.where((F.col("id") >= 200) & (F.col("id") < 350)), v.where(F.col("id") >= 350)]
    table = ivf.add_chunks(chunks)
    assert table.count() == 500
    p = f"{tmp_dir}/re"
    a = ivf.build_ivf(table, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=2, path=p)
    before = _ids(a.search(queries_from(v), 5))  # an index read from p is invalid once p is rebuilt
    b = ivf.recreate_index(table, p, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=2)
    assert _ids(b.search(queries_from(v), 5)) == before


def test_async_index_stream_equals_batch(spark, v, tmp_dir):
    """Index created first on an empty table, rows indexed as they stream in."""
    from quiver.streaming import maintain

    cen = ivf.centroids_from_labels(v)
    batch = ivf.build_ivf(v, metric="l2", centroids=cen, n_probes=3)
    empty = ivf.build_ivf(v.limit(0), metric="l2", centroids=cen, n_probes=3)
    src = f"{tmp_dir}/src"
    v.repartitionByRange(4, "id").write.parquet(src)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = f"{tmp_dir}/lists_stream"
    maintain.maintain_ivf(stream, empty, out, f"{tmp_dir}/ck").awaitTermination()
    streamed = ivf.with_appended(empty, maintain.read_stream_lists(spark, out))
    assert _ids(streamed.search(queries_from(v), 10)) == _ids(batch.search(queries_from(v), 10))


def test_detour_methods_agree(v):
    e = graph.knn_edges(v, 12, "l2").cache()
    a = sorted(tuple(r) for r in graph.detours(e).collect())
    b = sorted(tuple(r) for r in graph.detours_arrays(e).collect())
    assert a == b and len(a) == 500 * 12


def test_bounded_kernel_tasks_same_result(spark, v, exact10):
    spark.conf.set("quiver.knn.maxKernelTasks", "2")
    try:
        many = v.repartition(7)
        assert _ids(knn.knn(many, queries_from(v), 10, "l2")) == _ids(exact10)
    finally:
        spark.conf.unset("quiver.knn.maxKernelTasks")


def test_grid_plan_with_post_filter(v):
    from quiver.functions import filters as flt

    cond = flt.where(i32v_lt=500)
    a = sorted(tuple(r) for r in knn.search(v, queries_from(v), 10, "l2", where=cond, mode="post", oversample=2).collect())
    b = sorted(tuple(r) for r in knn.search(v, queries_from(v), 10, "l2", where=cond, mode="post", oversample=2,
                                            broadcast_bytes=1, block_bytes=30_000).collect())
    assert a == b and len(a) > 0


def test_mix_report_planned_and_affected(spark):
    small = gen.generate(spark, 50, 8, seed=3, start_id=1)
    t, stats = dml.mix(small, 300, (1, 8, 1), batch_size=100, dim=8, report=True)
    rows = stats.orderBy("batch").collect()
    assert [r["ops"] for r in rows] == [100, 100, 100]
    assert all(r["planned_update"] == 80 for r in rows)
    # the table has 60 rows when the first batch updates: a sample cannot exceed it
    assert rows[0]["updated"] == 60 and rows[0]["deleted"] == 10
    assert t.count() == 50 + sum(r["inserted"] - r["deleted"] for r in rows)


def test_smallest_n_paths_agree(v):
    a = sorted(r["id"] for r in dml.smallest_n(v, 321, ["i32v", "id"]).collect())
    b = sorted(r["id"] for r in dml.smallest_n(v, 321, ["i32v", "id"], take_ordered_max=0).collect())
    assert a == b and len(a) == 321
    from quiver.sources import text

    big = sorted(r["id"] for r in text.query_set(v, start_id=20, n=15_000).collect())
    assert big == list(range(20, 500))


def test_blocked_broadcast_scans_equal_exact(v, exact10):
    # about 248 kB of queries + state against a 100 kB budget: three or four scan blocks
    got = knn.knn(v, queries_from(v), 10, "l2", broadcast_bytes=100_000)
    assert _ids(got) == _ids(exact10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 3 and "FlatMapCoGroups" not in plan


def test_ivf_and_pq_blocked_scans_equal_single_scan(v):
    from quiver.functions import filters as flt

    idx = ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=3)
    cond = flt.where(i32v_lt=500)
    a = _ids(idx.search(queries_from(v), 10, where=cond))
    blocked = idx.search(queries_from(v), 10, where=cond, broadcast_bytes=100_000)  # about 3 blocks
    assert _ids(blocked) == a
    assert "FlatMapCoGroups" not in blocked._jdf.queryExecution().optimizedPlan().toString()
    p = pq.build_ivfpq(v, 8, 64, lists=4, bits=4, train_percent=100.0, n_probes=2, rerank=2)
    assert _ids(p.search(queries_from(v), 10, broadcast_bytes=100_000)) == _ids(p.search(queries_from(v), 10))
