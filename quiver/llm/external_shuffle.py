"""Operator 11: sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash of (doc_id, text);
pass two shuffles each bucket by Fisher-Yates in one task and writes it. The buckets in order are one global
random order, which is cut into ``shards`` of equal counts (law ``rows``: at most one apart): position p of n
is in shard ``floor(p * shards / n)``, and its slot counts from that shard's first position.

A bucket has ``bucket_bytes`` on average, and there are ``MAX_BUCKETS`` at most, so the table of their counts
(the only thing that is broadcast, 24 bytes a bucket) has a fixed bound; beyond it the buckets grow. Equal rows
have one hash: the rows of a bucket above twice its share (a third of all rows may be copies of one row) are scattered
again over all buckets, by a hash that includes the row's place in the scan. Texts are read twice (hash and count, then scatter) and
shuffled once. A lost executor costs its own tasks: hash, place and permutation come out the same again.
Both passes must see the same rows in the same partitions, as scans of files do; what was written is counted, and a
difference raises.

Files: ``path/shard=K/``, each sorted by ``slot``, with the columns ``slot`` and ``row`` (a struct of all
columns of the input, so no name can clash). ``read_shard`` reads on from any slot.

Defined results: a null text has size 1 and the checksum of an empty one; a null doc_id is an id
like any other; a long text is in one bucket, which is then larger; repeated rows all stay, each in a slot of its own,
and which copy is where cannot be seen; rows with equal doc_id and text but other extra columns keep their scan order
before the shuffle; an empty table writes nothing and gives no rows; with fewer rows than shards some shards stay empty.
The same input and seed give the same order; where no bucket was too large, whatever the file layout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiver.llm.batches import bound_batches
from quiver.session import scratch_dir

SHARDS = 16
BUCKET_BYTES = 32 << 20  # of text; the task of a bucket holds a few times that
MAX_BUCKETS = 1_000_000
LAW = "rows"


def _size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scattered(spark: SparkSession, docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """``(row, h, bucket)`` of every row, ``(b, start)`` of every bucket, and the number of rows."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place"),
                       F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("h"), _size("text").alias("size"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return rows, rows, 0
    share = max(bucket_bytes, -(-size // MAX_BUCKETS))
    buckets = -(-size // share)
    rows = rows.withColumn("bucket", F.expr(f"pmod(h, {buckets}L)"))
    path = scratch_dir(spark, "buckets")
    rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).write.parquet(path)
    counts = spark.read.parquet(path)
    large = counts.where(F.col("size") > 2 * share).select(F.col("bucket").alias("b"))
    if not large.isEmpty():
        rows = rows.join(F.broadcast(large), F.col("bucket") == F.col("b"), "left")
        rows = rows.withColumn("bucket", F.when(F.col("b").isNull(), F.col("bucket")).otherwise(F.expr(f"pmod(xxhash64(h, place), {buckets}L)")))
        rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}-again")
        counts = spark.read.parquet(f"{path}-again")
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # over one row a bucket
    starts = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return rows.select("row", "h", "bucket"), starts, n


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows of ``docs`` in a seeded random order below ``path``; returns the files as ``(slot, row, shard)``."""
    bound_batches(spark)
    rows, starts, n = scattered(spark, docs, seed, bucket_bytes)
    kind = docs.select(F.struct(*docs.columns)).schema[0].dataType.simpleString()
    schema = f"slot long, row {kind}"
    if not n:
        return spark.createDataFrame([], f"{schema}, shard int")

    def shuffled(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy(), kind="stable")  # the same start however the rows came in
        draws = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed % 2**32, table.column("bucket")[0].as_py()])))
        draws.shuffle(order)  # Fisher-Yates
        out = table.select(["row", "bucket"]).take(order)
        return out.append_column("at", pa.array(np.arange(len(order))))

    laid = rows.groupBy("bucket").applyInArrow(shuffled, f"row {kind}, bucket long, at long")
    laid = laid.join(F.broadcast(starts), F.col("bucket") == F.col("b"))
    laid = laid.withColumn("p", F.col("start") + F.col("at")).withColumn("shard", F.expr(f"cast(p * {shards} div {n} as int)"))
    laid = laid.withColumn("slot", F.expr(f"p - (shard * {n}L + {shards - 1}) div {shards}"))
    laid.select("slot", "row", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    out = spark.read.schema(f"{schema}, shard int").parquet(path)
    found = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), (F.max("slot") + 1).alias("top"), F.sum("slot").alias("sum"))
    whole = (F.col("n") == F.col("top")) & (F.col("sum") == F.expr("n * (n - 1) div 2"))
    if tuple(found.agg(F.sum("n"), F.min(whole)).first()) != (n, True):
        raise RuntimeError("the input changed between the passes: write it to files first")
    return out


def read_shard(spark: SparkSession, path: str, shard: int, start: int = 0) -> DataFrame:
    """The rows of one shard in order from slot ``start`` on: ``slot`` and the input's columns as ``row``."""
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("slot") >= start)).select("slot", "row").orderBy("slot")


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 16 shards, read back from the files written."""
    out = write_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark, "shuffled"))
    text = F.coalesce("row.text", F.lit(""))
    return out.select("row.doc_id", _size("row.text").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                      F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
