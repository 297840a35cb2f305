"""Graph search in blocks: the same rows as the step-by-step join, one graph or one per shard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import graph, graph_block
from quiver.operators.knn import knn

DIM, K = 6, 5


def table(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM)).astype(np.float32)
    x[5:6] = 0.0
    x[30:40] = x[min(3, n - 1)]
    return spark.createDataFrame([(i * 3 + 1, v.tolist(), i % 10) for i, v in enumerate(x)], "id long, embed array<float>, tag int")


def rows_of(df):
    ok = "ok" in df.columns
    return sorted((r.qid, r.rk, r.id, None if r.d is None else round(r.d, 5), r.ok if ok else None) for r in df.collect())


def queries(v, most=60):
    return v.where(F.col("id") < most).select(F.col("id").alias("qid"), "embed")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_block_and_step_plans_agree(spark, metric):
    v = table(spark)
    q = queries(v)
    g = graph.build_graph(v, 6, 10, metric, itopk=12, search_width=2, n_seeds=5, max_iter=6)
    assert g.block(1000) is None and g.block(1 << 20) is not None
    for kw in ({}, {"where": F.col("tag") < 3}, {"flag": F.col("tag") < 3}):
        block = rows_of(g.search(q, K, **kw))
        step = rows_of(graph.graph_search(g, q, K, 12, 2, 6, **kw))
        assert block == step and len(block) > 60


@pytest.mark.parametrize("degree,igd", [(4, 9), (8, 8), (7, 20)])
def test_block_edges_are_the_tables_edges(spark, degree, igd):
    v = table(spark, seed=3).where("id <> 16")  # without the zero vector
    want = sorted((r.src, r.rank, r.dst) for r in graph.build_graph(v, degree, igd).edges.collect())
    t = v.orderBy("id").toPandas()
    ids, X = t["id"].to_numpy(), np.stack(t["embed"].to_numpy()).astype(float)
    edges = graph_block.pruned(graph_block.neighbours(X, igd, "l2"), degree)
    got = sorted((int(ids[s]), r + 1, int(ids[d])) for s in range(len(ids)) for r, d in enumerate(edges[s]) if d >= 0)
    assert got == want


def test_one_shard_is_the_whole_graph(spark, tmp_path):
    v = table(spark, seed=1)
    q, kw = queries(v), {"itopk": 12, "search_width": 2, "max_iter": 6}
    g = graph.build_graph(v, 6, 10, n_seeds=5, **kw)
    one = graph_block.build_shards(v, 6, 10, shards=1, n_seeds=5, path=f"{tmp_path}/g", **kw)
    assert rows_of(one.search(q, K)) == rows_of(g.search(q, K))
    few = F.col("tag") == 4
    assert rows_of(one.search(q, K, where=few)) == rows_of(g.search(q, K, where=few))
    assert rows_of(one.search(q, K, flag=few)) == rows_of(g.search(q, K, flag=few))
    assert rows_of(graph_block.load_shards(spark, f"{tmp_path}/g").search(q, K)) == rows_of(one.search(q, K))


def test_many_blocks_and_query_pieces(spark):
    v = table(spark, n=900, seed=2)
    q = queries(v, 300)
    many = graph_block.build_shards(v, 8, 16, block_bytes=6_000, itopk=32)
    sizes = [r.n for r in many.blocks.select("n").collect()]
    assert len(sizes) > 6 and sum(sizes) == 900
    got = rows_of(many.search(q, K))
    assert got == rows_of(many.search(q, K, broadcast_bytes=4_000))
    want = rows_of(knn(v, q, K))
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) > 0.95 * len(want)
    assert many.search(q.limit(0), K).count() == 0
    with pytest.raises(ValueError, match="repeat"):
        many.search(q.unionByName(q.limit(1)), K)


def test_tiny_blocks(spark):
    v = table(spark, n=3)
    one = graph_block.build_shards(v, 4, 8, shards=2, shard=F.pmod("id", F.lit(2)))
    assert one.search(queries(v), K).groupBy("qid").count().where("count = 3").count() == 3
    assert graph_block.build_shards(v.limit(0), 4, 8).search(queries(v), K).count() == 0
