"""End-to-end flows shaped like the reference's smoke scripts, through this package's API."""

import os

from pyspark.sql import functions as F

from quiver.functions import filters as flt
from quiver.operators import dml, knn, recall
from quiver.plans.config_index import build_from_config
from quiver.sources import generate as gen
from quiver.sources import text

DIM = 32


def test_ivfflat_script_flow(spark, tmp_dir):
    # Generate gzip CSV data in chunks (seed 1234) plus an extra file after the base range.
    base = gen.generate(spark, 3000, DIM, seed=1234, start_id=0, partitions=3)
    text.write_csv(base, os.path.join(tmp_dir, "data"), chunks=2, compress_level=6)
    extra = gen.generate(spark, 300, DIM, seed=4321, start_id=3001)
    text.write_csv(extra, os.path.join(tmp_dir, "extra"), compress_level=6)

    # Create the table and bulk-load the chunks found by prefix, then append the extra file.
    table = dml.create_table(spark, os.path.join(tmp_dir, "tbl"), DIM)
    table = dml.bulk_load(table, text.read_csv(spark, prefix=os.path.join(tmp_dir, "data", "part-")))
    table = dml.bulk_load(table, text.read_csv(spark, [os.path.join(tmp_dir, "extra")]))
    assert table.count() == 3300

    # Build the index a config describes and score self-recall in every mode with i32v < 50.
    cfg = {"index": {"type": "ivfflat", "lists": 8, "op_type": "vector_l2_ops"},
           "env": {"probe_limit": 8, "kmeans_train_percent": 100}}
    index = build_from_config(table, cfg)
    queries = text.query_set(text.read_csv(spark, [os.path.join(tmp_dir, "extra")]), start_id=3001, n=200)
    qs = queries.select(F.col("id").alias("qid"), "embed")
    cond = flt.where(i32v_lt=50)
    results = {m: knn.search(table, qs, 1, "l2", where=cond, mode=m, index=index) for m in ("normal", "pre", "post", "force")}
    by_mode = {r["mode"]: r for r in recall.recall_by_mode(results, queries.withColumnRenamed("id", "qid"), cond).collect()}
    assert set(by_mode) == {"normal", "pre", "post", "force"}
    for r in by_mode.values():
        assert r["total"] == 200 and r["eligible"] == by_mode["force"]["eligible"]
        assert r["recall"] == 1.0  # all lists probed: index search equals exact

    # DML workload: insert n, update n/2, delete n/4, mix n (1:8:1).
    n = 200
    t = dml.insert(table, n, DIM)
    assert t.count() == 3300 + n and dml.max_id(t).first()["max_id"] == 3300 + n
    t = dml.update(t, dml.sample_ids(t, n // 2, 7), DIM, 8, n_hint=n // 2)
    t = dml.delete(t, dml.sample_ids(t, n // 4, 9))
    assert t.count() == 3300 + n - n // 4
    t = dml.mix(t, n, (1, 8, 1), batch_size=100, dim=DIM)
    ni, nu, nd = dml.mix_counts(100, (1, 8, 1))
    assert t.count() == 3300 + n - n // 4 + 2 * (ni - nd)
    assert t.select("id").distinct().count() == t.count()


def test_fvecs_conversion_flow(spark, tmp_dir):
    """.fvecs input -> vector table with synthetic metadata -> CSV -> exact self-recall 1.0."""
    from quiver.sources import binary

    vecs = gen.generate(spark, 1500, DIM, seed=5).select("id", "embed")
    binary.write_vectors(vecs, os.path.join(tmp_dir, "base"), ".fvecs", parts=3)
    table = binary.convert_to_table(spark, os.path.join(tmp_dir, "base"), seed=5, start_id=0)
    assert table.count() == 1500 and table.agg(F.min("id"), F.max("id")).first() == (0, 1499)
    text.write_csv(table, os.path.join(tmp_dir, "csv"), compress_level=1)
    back = text.read_csv(spark, [os.path.join(tmp_dir, "csv")]).drop("_file")
    res = knn.knn(back, back.select(F.col("id").alias("qid"), "embed"), 1, "l2")
    r = recall.self_recall(res, back.withColumnRenamed("id", "qid")).first()
    assert r["recall"] == 1.0 and r["total"] == 1500


def test_ground_truth_file_flow(spark, tmp_dir):
    """Queries as .fbin, ground truth as .ibin (nearest first), recall@k of an index against it."""
    from quiver.operators import ivf
    from quiver.sources import binary

    table = gen.generate(spark, 2000, DIM, seed=11)
    queries = gen.generate(spark, 100, DIM, seed=12).select("id", "embed")
    binary.write_vectors(queries, os.path.join(tmp_dir, "q"), ".fbin", parts=2)
    exact = knn.knn(table, queries.select(F.col("id").alias("qid"), "embed"), 10, "l2")
    gt_rows = exact.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))),
                                                   lambda s: s["id"]).alias("nb"))
    binary.write_vectors(gt_rows, os.path.join(tmp_dir, "gt"), ".ibin", parts=2, vec_col="nb", order_col="qid")

    q = binary.read_vectors(spark, os.path.join(tmp_dir, "q")).select(F.col("pos").alias("qid"), "embed")
    gt = recall.gt_relation(binary.read_ground_truth(spark, os.path.join(tmp_dir, "gt")))
    index = ivf.build_ivf(table, lists=8, metric="l2", train_percent=100.0, n_probes=8)
    full = recall.gt_recall(index.search(q, 10), gt, 10).first()
    assert full["total_queries"] == 100 and full["recall_rate"] == 1.0
    one = recall.gt_recall(index.search(q, 10, n_probes=1), gt, 10).first()
    assert 0 < one["recall_rate"] <= 1.0
