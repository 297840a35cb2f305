"""Dropping rows by id without moving the texts where the ids are few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_dir

BROADCAST_ROWS = 1_000_000  # ids (a long each) that may be broadcast; more are joined by a shuffle


def without(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``ids(doc_id)``; rows with a null id stay."""
    path = scratch_dir(spark, "dropped")
    ids.select("doc_id").distinct().write.parquet(path)
    ids = spark.read.parquet(path)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row (the least by its columns in order) of every repeated ``doc_id``; rows with a null id stay."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    path = scratch_dir(spark, "repeated")
    repeated.write.parquet(path)
    repeated = spark.read.parquet(path)
    if repeated.isEmpty():
        return docs
    rest = [c for c in docs.columns if c != "doc_id"]
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return without(spark, docs, repeated).unionByName(least.select("doc_id", "row.*"))
