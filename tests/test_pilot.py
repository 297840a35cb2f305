"""K2: bounds from some scan tasks leave the others' rows out, never a result."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import knn
from quiver.schema import queries_from, vectors
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pilot") / "v")
    v = vectors(spark, SF_SMALL)
    zero = v.limit(3).withColumn("id", F.col("id") + 10_000).withColumn("embed", F.transform("embed", lambda x: x * 0))
    twice = v.limit(40).withColumn("id", F.col("id") + 20_000)  # ties
    v.unionByName(zero).unionByName(twice).repartition(40, F.xxhash64("id")).write.parquet(path)
    return path


@pytest.fixture()
def read(spark, many):
    keys = {"spark.sql.files.openCostInBytes": "64m", "spark.sql.files.maxPartitionBytes": "64m"}  # a task per file
    before = {k: spark.conf.get(k) for k in keys}
    for k, x in keys.items():
        spark.conf.set(k, x)
    yield spark.read.parquet(many)
    for k, x in before.items():
        spark.conf.set(k, x)
    spark.conf.unset("quiver.knn.pilotStride")


def _rows(df):
    return sorted((r["qid"], r["rk"], r["id"], r["d"]) for r in df.select("qid", "rk", "id", "d").collect())


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine", "ip"])
def test_same_rows_with_and_without(spark, read, metric):
    q = queries_from(vectors(spark, SF_SMALL))
    for where in (None, F.col("i32v") < 30, F.col("i32v") < 0):
        spark.conf.set("quiver.knn.pilotStride", "0")
        plain = _rows(knn.knn(read, q, 7, metric, where=where))
        spark.conf.set("quiver.knn.pilotStride", "8")
        assert knn.pilot_stride(read) == 8
        assert _rows(knn.knn(read, q, 7, metric, where=where)) == plain


def test_flags_and_blocks(spark, read):
    q = queries_from(vectors(spark, SF_SMALL))
    spark.conf.set("quiver.knn.pilotStride", "0")
    plain = _rows(knn.search(read, q, 5, where=F.col("i32v") < 500, mode="post", oversample=3))
    spark.conf.set("quiver.knn.pilotStride", "8")
    assert _rows(knn.search(read, q, 5, where=F.col("i32v") < 500, mode="post", oversample=3)) == plain
    n, dim = knn._vector_stats(q, "embed")
    assert _rows(knn.knn(read, q, 5, broadcast_bytes=n * (dim * 4 + 5 * 24) // 2)) == _rows(knn.knn(read, q, 5))


def test_rows_sent_follow_the_stride_not_the_tasks(spark, read):
    q = queries_from(vectors(spark, SF_SMALL)).select("qid", F.col("embed").alias("v"))
    c = read.select("id", F.col("embed").alias("v"))
    assert c.rdd.getNumPartitions() == 40
    k, n = 3, q.count()
    plain = knn._sharded_partials(c, q, k, "l2", False).count()
    bounded = knn._sharded_partials(c, q, k, "l2", False, stride=2).count()
    assert plain > 30 * k * n  # a top-k per task
    assert n * k <= bounded <= 4 * k * n  # about 2 x k a query


def test_few_files_go_without(spark):
    assert knn.pilot_stride(vectors(spark, SF_SMALL)) == 0
