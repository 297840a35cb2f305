"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial aggregation keeps hubs small) and a
join that adaptive execution may split on a hub; the edge table is written to
the shared checkpoint folder after each round, which also cuts the lineage.
Only a count and a checksum reach the driver. At the end every node hangs on
the smallest id of its component.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_dir


def _saved(spark: SparkSession, edges: DataFrame, base: str) -> tuple[DataFrame, tuple]:
    path = f"{base}/{uuid.uuid4().hex[:8]}"
    edges.write.parquet(path)
    out = spark.read.schema("a long, b long").parquet(path)
    mark = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return out, tuple(mark)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; ``component`` is the smallest id reachable.

    Self links, repeated links and rows with a null end are ignored.
    """
    base = scratch_dir(spark, "components")
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.where(edges["a"].isNotNull() & edges["b"].isNotNull()).where("a <> b").distinct()
    links, mark = _saved(spark, links, base)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, then = _saved(spark, small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), base)
        if then == mark:
            break
        links, mark = after, then
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
