"""Graph and IVF-PQ indexes that follow a stream, against fresh builds."""

import os

import pytest
from pyspark.sql import functions as F

from quiver.operators import graph, ivf, pq
from quiver.operators.knn import knn
from quiver.schema import queries_from, vectors
from quiver.streaming import maintain
from quiver.streaming.graph_stream import GraphStore
from tests.test_expand import rows_of, table


def recall(index, q, want, k):
    got = {(r[0], r[2]) for r in rows_of(index.search(q, k))}
    return len(got & want) / len(want)


def test_inserted_graph_recalls_like_a_fresh_one(spark, tmp_path):
    v = vectors(spark, "/root/testdata/sf0.01")
    kw = {"itopk": 40, "n_seeds": 24}
    store = GraphStore.create(spark, f"{tmp_path}/g", v.schema, graph_degree=12, candidates=24, **kw)
    for n in range(3):
        store.insert(v.where(F.pmod("id", F.lit(3)) == n), n)
    q, k = queries_from(v), 10
    want = {(r[0], r[2]) for r in rows_of(knn(v, q, k))}
    fresh = recall(graph.build_graph(v, 12, 24, **kw), q, want, k)
    live = store.load()
    assert recall(live, q, want, k) >= fresh - 0.02
    assert live.edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    # Deletes: left out at once, and after compaction the graph still answers.
    store.delete(v.where("id < 100").select("id"), 3)
    rest = v.where("id >= 100")
    q = queries_from(rest)
    want = {(r[0], r[2]) for r in rows_of(knn(rest, q, k))}
    assert min(r[2] for r in rows_of(store.load().search(q, k))) >= 100
    fresh = recall(graph.build_graph(rest, 12, 24, **kw), q, want, k)
    store.compact()
    assert len(store.commits()) == 1 and store.load().attributes.count() == rest.count()
    assert recall(store.load(), q, want, k) >= fresh - 0.02
    assert store.load().edges.where("dst < 100 or src < 100").count() == 0


def test_replayed_and_uncommitted_batches(spark, tmp_path):
    v = table(spark, n=60)
    store = GraphStore.create(spark, f"{tmp_path}/g", v.schema, graph_degree=6, candidates=12)
    store.insert(v.where("id < 40"), 0)
    before = rows_of(store.load().search(queries_from(v), 3))
    store._write(v.where("id >= 40"), "vectors", 1)  # a batch that failed before its commit
    assert rows_of(store.load().search(queries_from(v), 3)) == before
    store.insert(v.where("id >= 40"), 1)
    after = rows_of(store.load().search(queries_from(v), 3))
    store.insert(v.where("id >= 40"), 1)  # replayed
    assert rows_of(store.load().search(queries_from(v), 3)) == after and store.load().attributes.count() == 60
    store.insert(v.limit(0), 2)
    moved = v.where("id = 3").withColumn("embed", F.transform("embed", lambda x: (x + 50).cast("float")))
    store.insert(moved, 3)  # an id that is there gets its new vector
    assert store.load().attributes.count() == 60
    assert [r.id for r in store.load().search(queries_from(moved), 1).collect()] == [3]
    few = rows_of(store.load().search(queries_from(v), 2, where=F.col("i32v") < 30))
    assert few and {r[2] for r in few} <= {r.id for r in v.where("i32v < 30").collect()}
    flagged = store.load().search(queries_from(v), 2, flag=F.col("i32v") < 30)
    assert set(flagged.columns) == {"qid", "id", "d", "rk", "ok"} and flagged.count() == 120


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_streamed_codes_equal_batch_and_compaction_bounds_files(spark, tmp_path, metric):
    v = table(spark, n=300).where("id <> 7")
    index = pq.build_ivfpq(v, 4, 8, lists=5, bits=4, metric=metric, train_percent=100)
    want = sorted((r.id, r.list_id, r.codes) for r in index.codes.collect())
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    v.repartition(12, "id").write.parquet(src)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(src)
    maintain.maintain_ivfpq(stream, index, out, ck).awaitTermination()
    files = lambda: sum(f.endswith(".parquet") for _, _, names in os.walk(out) for f in names)
    rows = lambda: sorted((r.id, r.list_id, r.codes) for r in maintain.read_stream_lists(spark, out).collect())
    many = files()
    assert rows() == want and many > 30
    first = maintain.compact_lists(spark, out, upto=5)
    assert rows() == want and first["upto"] == 5 and files() < many
    stale = f"{out}/batch_id=3"
    maintain.read_stream_lists(spark, out).limit(2).drop("batch_id").write.partitionBy("list_id").parquet(stale)  # replayed after compaction
    assert rows() == want
    maintain.compact_lists(spark, out)
    assert rows() == want and files() <= 5 * 2 and not os.path.exists(stale)
    assert maintain.compact_lists(spark, out)["generation"] == 1  # nothing to do
    lists = ivf.with_appended(index.coarse, maintain.read_stream_lists(spark, out).withColumn("id", F.col("id") + 10_000))
    assert pq.IvfPqIndex(lists, index.codebook, 4, metric).search(queries_from(v.where("id < 9")), 600, n_probes=5).count() == 8 * 598
