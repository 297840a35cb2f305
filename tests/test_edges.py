"""Edge cases on small hand-made fixtures written by the tests."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import filters as flt
from quiver.functions import vector as vf
from quiver.operators import knn, pq, recall
from quiver.sources import binary, text

SCHEMA = "id long, embed array<float>, i32v int, f32v float, strv string"


@pytest.fixture()
def tiny(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], 10, 0.1, "a"),
        (2, [1.0, 0.0, 0.0], 20, 0.2, "b"),  # duplicate of 1
        (3, [0.0, 1.0, 0.0], 30, 0.3, "a"),
        (4, [0.0, 0.0, 0.0], 40, 0.4, "c"),  # zero vector
        (5, [0.0, 0.0, 2.0], 50, 0.5, "a"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _q(df, ids):
    return df.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), "embed")


def test_duplicate_tie_goes_to_smaller_id(tiny):
    r = knn.knn(tiny, _q(tiny, [2]), 2, "l2").orderBy("rk").collect()
    assert [x["id"] for x in r] == [1, 2] and r[0]["d"] == 0.0


def test_zero_vector_cosine_null_last(tiny):
    r = knn.knn(tiny, _q(tiny, [3]), 5, "cosine").orderBy("rk").collect()
    assert r[-1]["id"] == 4 and r[-1]["d"] is None
    jvm = tiny.select(vf.cosine_distance("embed", F.array(*[F.lit(0.0)] * 3)).alias("c")).collect()
    assert all(x["c"] is None for x in jvm)


def test_k_larger_than_corpus(tiny):
    assert knn.knn(tiny, _q(tiny, [1, 3]), 50, "l2").count() == 10


def test_dim_mismatch_raises(spark, tiny):
    q = spark.createDataFrame([(9, [1.0, 2.0])], "qid long, embed array<float>")
    with pytest.raises(Exception, match="dimension"):
        knn.knn(tiny, q, 2, "l2").collect()
    with pytest.raises(Exception, match="dimension"):
        tiny.select(vf.check_dim("embed", 4)).collect()


def test_unknown_metric_raises():
    with pytest.raises(ValueError):
        vf.resolve_metric("hamming")


def test_filters(tiny):
    assert flt.where() is None
    assert tiny.where(flt.where(i32v_lt=30, strv_eq="a")).count() == 1
    assert tiny.where(flt.where(f32v_lt=0.3)).count() == 2


def test_no_eligible_rows_recall_zero(tiny):
    cond = flt.where(i32v_lt=0)
    res = knn.search(tiny, _q(tiny, [1, 3]), 1, "l2", where=cond, mode="pre")
    r = recall.self_recall(res, tiny.withColumnRenamed("id", "qid").where(F.col("qid").isin(1, 3)), cond).first()
    assert r["eligible"] == 0 and r["recall"] == 0.0


def test_post_mode_may_return_fewer(tiny):
    res = knn.search(tiny, _q(tiny, [1]), 2, "l2", where=flt.where(strv_eq="c"), mode="post")
    assert res.count() == 0


def test_gt_width_smaller_than_k(spark):
    res = spark.createDataFrame([(0, 5, 0.0, 1), (0, 6, 0.1, 2), (0, 7, 0.2, 3)], "qid long, id long, d double, rk int")
    gt = recall.gt_relation(spark.createDataFrame([(0, [5, 7])], "qid long, neighbors array<long>"))
    r = recall.gt_recall(res, gt, 3).first()
    assert r["correct_hits"] == 2 and abs(r["recall_rate"] - 2 / 3) < 1e-12


def test_normalize_zero_unchanged(tiny):
    r = tiny.where("id = 4").select(vf.normalize("embed").alias("u")).first()
    assert list(r["u"]) == [0.0, 0.0, 0.0]


def test_text_parse_forms(spark):
    df = spark.createDataFrame([("[1.5,2,3]",), ("1.5, 2, 3",)], "s string")
    got = [list(r["v"]) for r in df.select(vf.parse_vector("s").alias("v")).collect()]
    assert got == [[1.5, 2.0, 3.0], [1.5, 2.0, 3.0]]


def test_fp16_rounding_matches_numpy(spark):
    vals = [0.1, -3.14159, 1e-6, 65504.0, 70000.0, 0.0, 1234.567]
    df = spark.createDataFrame([(vals,)], "v array<float>")
    got = df.select(vf.quantize("v", F.lit(0.0), F.lit(0.0), "fp16").alias("h")).first()["h"]
    exp = np.array(vals, dtype=np.float32).astype(np.float16).astype(np.float32)
    assert np.array_equal(np.array(got, dtype=np.float32), exp)


def test_int8_codes_cover_range(tiny):
    got = pq.quantize_table(tiny.where("id = 5"), "int8").first()["embed"]
    assert list(got) == [-128, -128, 127]


def _write_fbin(path, arr):
    with open(path, "wb") as f:
        f.write(np.array(arr.shape, dtype=np.uint32).tobytes())
        f.write(arr.tobytes())


def test_fbin_family_and_upper_case_suffix(spark, tmp_dir):
    a = np.arange(12, dtype=np.float32).reshape(4, 3)
    _write_fbin(os.path.join(tmp_dir, "A.FBIN"), a)
    u = np.arange(6, dtype=np.uint8).reshape(2, 3)
    _write_fbin(os.path.join(tmp_dir, "b.u8bin"), u)
    got = binary.read_vectors(spark, os.path.join(tmp_dir, "A.FBIN"), rows_per_partition=3).orderBy("pos").collect()
    assert [list(r["embed"]) for r in got] == a.tolist()
    got_u = binary.read_vectors(spark, os.path.join(tmp_dir, "b.u8bin")).orderBy("pos").collect()
    assert [list(r["embed"]) for r in got_u] == u.astype(np.float32).tolist()


def test_ibin_ground_truth(spark, tmp_dir):
    gt = np.array([[3, 1], [0, 2]], dtype=np.int32)
    _write_fbin(os.path.join(tmp_dir, "gt.ibin"), gt)
    got = binary.read_ground_truth(spark, os.path.join(tmp_dir, "gt.ibin")).orderBy("qid").collect()
    assert [list(r["neighbors"]) for r in got] == [[3, 1], [0, 2]]


def test_fbin_size_mismatch_raises(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.fbin")
    with open(p, "wb") as f:
        f.write(np.array([5, 3], dtype=np.uint32).tobytes() + b"\0" * 8)
    with pytest.raises(Exception, match="expected"):
        binary.read_vectors(spark, p).collect()


def test_fvecs_and_empty(spark, tmp_dir):
    a = np.arange(8, dtype=np.float32).reshape(2, 4)
    rec = np.hstack([np.full((2, 1), 4, dtype=np.int32), a.view(np.int32)])
    p = os.path.join(tmp_dir, "x.fvecs")
    rec.tofile(p)
    got = binary.read_vectors(spark, p).orderBy("pos").collect()
    assert [list(r["embed"]) for r in got] == a.tolist()
    e = os.path.join(tmp_dir, "empty.fvecs")
    open(e, "wb").close()
    assert binary.read_vectors(spark, e).count() == 0


def test_unknown_suffix_raises():
    with pytest.raises(ValueError):
        binary.file_kind("x.npy")


def test_csv_crlf_quoted_gzip(spark, tmp_dir):
    body = 'id,vector,i32v,f32v,str\r\n1,"[0.5,1.5]",7,0.25,abc\r\n2,"[2,3]",8,0.5,NA\r\n'
    with open(os.path.join(tmp_dir, "d0.csv"), "w", newline="") as f:
        f.write(body)
    with gzip.open(os.path.join(tmp_dir, "d1.csv.gz"), "wt", newline="") as f:
        f.write(body.replace("1,", "3,", 1).replace("2,\"", "4,\"", 1))
    df = text.read_csv(spark, prefix=os.path.join(tmp_dir, "d"))
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    assert list(rows[0]["embed"]) == [0.5, 1.5] and rows[1]["strv"] == "NA"
    first_two = text.query_set(df, start_id=2, n=2).collect()
    assert [r["id"] for r in first_two] == [2, 3]


def test_many_duplicates_keep_smallest_ids(spark):
    rows = [(i, [1.0, 2.0], 0, 0.0, "a") for i in range(40, 0, -1)] + [(100, [5.0, 5.0], 0, 0.0, "a")]
    t = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, embed array<float>")
    got = [r["id"] for r in knn.knn(t, q, 5, "l2").orderBy("rk").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_topk_indices_ties():
    from quiver.operators.topk_kernel import topk_indices

    D = np.array([[3.0, 1.0, 1.0, 1.0, 0.5]])
    ids = np.array([10, 9, 3, 7, 20])
    sel = topk_indices(D, 3, ids)[0]
    assert sorted(ids[sel].tolist()) == [3, 7, 20]


def test_gzip_level_changes_size(spark, tmp_dir):
    from quiver.sources.generate import generate

    df = generate(spark, 2000, 16, partitions=1)
    sizes = {}
    for lvl in (1, 9):
        out = os.path.join(tmp_dir, f"l{lvl}")
        text.write_csv(df, out, compress_level=lvl)
        sizes[lvl] = sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".gz"))
        assert text.read_csv(spark, [out]).count() == 2000
    assert sizes[9] < sizes[1]


def test_sql_functions(spark, tiny):
    from quiver.functions.sql import register_sql_functions

    register_sql_functions(spark)
    tiny.createOrReplaceTempView("tiny_v")
    got = spark.sql("SELECT id, l2_distance(embed, vec('[1, 0, 0]')) AS d, cosine_distance(embed, vec('0,1,0')) AS c, "
                    "inner_product(embed, vec('[0,0,1]')) AS ip, vector_norm(embed) AS n FROM tiny_v ORDER BY id").collect()
    assert got[0]["d"] == 0.0 and got[2]["c"] == 0.0 and got[3]["c"] is None
    assert got[4]["ip"] == 2.0 and got[4]["n"] == 2.0


def test_empty_inputs(spark, tiny):
    from quiver.operators import ivf

    none_q = _q(tiny, [999])
    assert knn.knn(tiny, none_q, 3, "l2").count() == 0
    assert knn.knn(tiny.limit(0), _q(tiny, [1]), 3, "l2").count() == 0
    cen = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "list_id int, centroid array<float>")
    idx = ivf.build_ivf(tiny, metric="l2", centroids=cen, n_probes=1)
    assert idx.search(none_q, 3).count() == 0
    assert idx.search(_q(tiny, [1]), 3).count() > 0
