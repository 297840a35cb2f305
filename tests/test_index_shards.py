"""K8 for indexes: independent sub-indexes and one merged result, from the operators and from run configurations."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import graph, graph_block, ivf, pq
from quiver.operators.knn import knn
from quiver.plans.config_index import build_from_config
from tests.test_expand import K, rows_of, table


def test_probing_every_list_of_every_shard_is_exact(spark):
    v = table(spark)
    q = v.where("id < 40").select(F.col("id").alias("qid"), "embed")
    index = ivf.build_ivf(v, lists=4, train_percent=100, n_probes=4, shards=3)
    cids = index.centroid_matrix()[0]
    assert index.shards == 3 and sorted(set((cids % 3).tolist())) == [0, 1, 2]
    own = index.lists.select((F.col("list_id") % 3).alias("s"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("h"))
    assert own.where("s <> h").count() == 0  # a row is in a list of its own shard
    assert rows_of(index.search(q, K)) == rows_of(knn(v, q, K))
    assert ivf.load_ivf(spark, index.path).shards == 3


def test_filtered_search_in_shards_fills_k(spark):
    v = table(spark)
    q = v.where("id < 40").select(F.col("id").alias("qid"), "embed")
    few = F.col("i32v") < 2  # 8 rows
    want = rows_of(knn(v, q, K, where=few))
    index = ivf.build_ivf(v, lists=8, train_percent=100, n_probes=1, shards=2)
    short = {r.qid for r in q.select("qid").collect()} - {r.qid for r in index.search(q, K, where=few, fill=False).groupBy("qid").count().where(f"count = {K}").collect()}
    assert short
    got = rows_of(index.search(q, K, where=few))
    assert [r for r in got if r[0] in short] == [r for r in want if r[0] in short] and len(got) == len(want)
    coded = pq.build_ivfpq(v, 4, 8, lists=8, bits=4, train_percent=100, n_probes=1, rerank=80, shards=2)
    assert coded.coarse.shards == 2
    got = rows_of(coded.search(q, K, where=few))
    assert len(got) == len(want)


@pytest.mark.parametrize("mode", ["single", "sharded", "replicated"])
def test_configurations(spark, tmp_path, mode):
    v = table(spark)
    q = v.where("id < 20").select(F.col("id").alias("qid"), "embed")
    cagra = build_from_config(v, {"index": {"type": "cagra", "distribution_mode": mode, "graph_degree": 8, "intermediate_graph_degree": 16, "itopk_size": 64}}, path=f"{tmp_path}/g")
    assert isinstance(cagra, graph_block.GraphShards if mode == "sharded" else graph.GraphIndex)
    coded = build_from_config(v, {"index": {"type": "ivfpq", "distribution_mode": mode, "lists": 5, "m": 4, "bits_per_code": 4},
                                  "dimension": 8, "env": {"probe_limit": 5, "kmeans_train_percent": 100}})
    assert coded.coarse.shards == (4 if mode == "sharded" else 1)
    want = {(r[0], r[2]) for r in rows_of(knn(v, q, K))}
    assert len({(r[0], r[2]) for r in rows_of(cagra.search(q, K))} & want) > 0.9 * len(want)
    assert coded.search(q, K).count() == 20 * K
    if mode == "sharded":
        assert rows_of(graph_block.load_shards(spark, f"{tmp_path}/g").search(q, K)) == rows_of(cagra.search(q, K))


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="distribution"):
        build_from_config(table(spark), {"index": {"type": "cagra", "distribution_mode": "elsewhere"}})
