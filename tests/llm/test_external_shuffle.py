"""The external shuffle against a plain one: the same hashes and draws, done on lists."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quiver.llm import external_shuffle as E


def saved(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_equals_a_plain_shuffle_of_hashed_buckets(spark, odd_dir, tmp_path):
    docs = saved(spark, spark.read.parquet(f"{odd_dir}/documents.parquet"), tmp_path)
    got = {r.row.doc_id: (r.shard, r.slot) for r in E.write_shards(spark, docs, f"{tmp_path}/out", shards=5, seed=3, bucket_bytes=40_000).collect()}
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("h")).collect()
    total = sum(len((r.text or "").encode()) + 1 for r in rows)
    buckets = -(-total // 40_000)
    size = Counter()
    for r in rows:
        size[r.h % buckets] += len((r.text or "").encode()) + 1
    assert buckets > 3 and max(size.values()) > 80_000  # the text of 20,000 words is in one that is scattered again
    order = []
    place = docs.select("doc_id", F.xxhash64(F.xxhash64(F.lit(3), "doc_id", "text"), F.monotonically_increasing_id()).alias("x")).collect()
    place = {r.doc_id: r.x % buckets for r in place}
    dealt = {r.doc_id: r.h % buckets if size[r.h % buckets] <= 80_000 else place[r.doc_id] for r in rows}
    for b in range(buckets):
        ids = [r.doc_id for r in sorted((r for r in rows if dealt[r.doc_id] == b), key=lambda r: r.h)]
        np.random.Generator(np.random.Philox(np.random.SeedSequence([3, b]))).shuffle(ids)
        order += ids
    n = len(order)
    shards = [i * 5 // n for i in range(n)]
    assert got == {d: (shards[i], i - shards.index(shards[i])) for i, d in enumerate(order)}


def test_rows_law_files_and_resume_on_odd_rows(spark, odd_docs, tmp_path):
    docs = saved(spark, odd_docs.withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("row", F.lit(1)), tmp_path)
    path = f"{tmp_path}/out"
    got = E.write_shards(spark, docs, path, bucket_bytes=20_000).collect()
    assert Counter(str(r.row) for r in got) == Counter(str(r) for r in docs.collect())
    slots = {k: sorted(r.slot for r in got if r.shard == k) for k in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = E.write_shards(spark, docs, f"{path}-again", bucket_bytes=20_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = E.write_shards(spark, docs, f"{path}-other", seed=12, bucket_bytes=20_000).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    rest = E.read_shard(spark, path, 4, 2).collect()
    assert [r.slot for r in rest] == slots[4][2:]
    assert [str(r.row) for r in rest] == [str(r.row) for r in sorted(got, key=lambda r: r.slot) if r.shard == 4 and r.slot >= 2]


def test_a_hot_row_is_split_over_buckets(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.md5(F.col("id").cast("string"))).otherwise(F.lit("a" * 32)).alias("text"))
    docs = saved(spark, docs, tmp_path)
    rows, starts, n = E.scattered(spark, docs, 1, 3000)
    largest = rows.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert n == 3000 and largest < 250  # about 91 rows a bucket; the hot row alone has 1,000
    got = E.write_shards(spark, docs, f"{tmp_path}/out", bucket_bytes=3000)
    copies = [r.c for r in got.where("row.doc_id = 7").groupBy("shard").agg(F.count("*").alias("c")).collect()]
    assert len(copies) == 16 and max(copies) < 130  # 62 a shard on average
    assert sorted(r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [187] * 8 + [188] * 8


def test_few_rows_null_texts_and_the_query(spark, tmp_path):
    docs = saved(spark, spark.createDataFrame([(None, None), (1, ""), (2, "é")], "doc_id long, text string"), tmp_path)
    (tmp_path / "docs").rename(tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in E.op11_external_shuffle(spark, str(tmp_path)).collect()}
    assert {k: (r["size"], r.text_crc32, r.law, r.slot, r.grown_shard) for k, r in got.items()} == {
        None: (1, 0, "rows", 0, None), 1: (1, 0, "rows", 0, None), 2: (3, zlib.crc32("é".encode()), "rows", 0, None)}
    assert len({r.shard for r in got.values()}) == 3
    assert E.write_shards(spark, docs.limit(0), f"{tmp_path}/none").count() == 0
