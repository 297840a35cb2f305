"""Recall scoring as joins and one aggregate each.

Search results are the long table ``(qid, id, d, rk)``. Every score is a
partial/final hash aggregate (R5) over per-query rows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.filters import eligible as eligible_col


def self_recall(results: DataFrame, queries: DataFrame, cond: Column | None = None, *, by: list[str] | None = None,
                check_eligible: bool = True) -> DataFrame:
    """R1 (R4 when ``check_eligible=False``): top-1 is the query's own id.

    ``queries``: the query rows with their metadata (``qid`` plus filter
    columns). recall = correct / eligible (0 when none is eligible); R4 counts
    over all queries.
    """
    by = by or []
    q = queries.select("qid", *by, eligible_col(cond if check_eligible else None).alias("eligible"))
    top1 = results.where(F.col("rk") == 1).select("qid", *by, F.col("id").alias("top_id"))
    j = q.join(top1, ["qid", *by], "left")
    hit = F.coalesce((F.col("top_id") == F.col("qid")) & F.col("eligible"), F.lit(False))
    agg = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("eligible")).alias("eligible"),
        F.count_if(hit).alias("correct"),
    )
    denom = F.col("eligible") if check_eligible else F.col("total")
    return agg.withColumn("recall", F.when(denom > 0, F.col("correct") / denom).otherwise(F.lit(0.0)))


def gt_relation(gt: DataFrame, neighbors_col: str = "neighbors") -> DataFrame:
    """Ground-truth matrix rows ``(qid, neighbors array)`` -> ``(qid, rank, id)`` (rank from 1)."""
    return gt.select("qid", F.posexplode(neighbors_col).alias("pos", "id")).select(
        "qid", (F.col("pos") + 1).cast("int").alias("rank"), F.col("id").cast("long").alias("id")
    )


def gt_from_results(results: DataFrame) -> DataFrame:
    """Ground truth in relation form from an exact search result."""
    return results.select("qid", F.col("rk").alias("rank"), "id")


def gt_recall(results: DataFrame, gt: DataFrame, k: int, queries: DataFrame | None = None, *,
              by: list[str] | None = None) -> DataFrame:
    """recall@k against ground truth ``(qid, rank, id)``.

    k = 1: hit when the first retrieved id equals the first GT id. k > 1:
    |retrieved[:k] intersect gt[:min(k, width)]| summed over queries, divided by
    queries * k (the denominator stays queries * k even when GT is narrower).
    ``queries`` (qid) defines the query set; default: the GT's queries.
    """
    by = by or []
    gtk = gt.where(F.col("rank") <= k)  # R7: slice to min(k, width)
    qset = (queries if queries is not None else gt.select("qid").distinct()).select("qid", *by).distinct()
    res = results.where(F.col("rk") <= k).select("qid", *by, "id", "rk")
    if k == 1:
        hits = res.where(F.col("rk") == 1).join(gtk.where(F.col("rank") == 1).select("qid", "id"), ["qid", "id"], "left_semi")
    else:
        hits = res.join(gtk.select("qid", "id"), ["qid", "id"], "left_semi")  # R6 as semi join
    per_q = hits.groupBy("qid", *by).agg(F.count(F.lit(1)).alias("c"))
    j = qset.join(per_q, ["qid", *by], "left")
    agg = j.groupBy(*by).agg(F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("correct_hits"))
    return agg.withColumn(
        "recall_rate",
        F.when(F.col("total_queries") > 0, F.col("correct_hits") / (F.col("total_queries") * F.lit(k))).otherwise(F.lit(0.0)),
    ).withColumn("k", F.lit(k))


def tag(results: DataFrame, mode: str) -> DataFrame:
    """R9 helper: tag a result table with its search mode."""
    return results.withColumn("mode", F.lit(mode))


def recall_by_mode(results: dict[str, DataFrame], queries: DataFrame, cond: Column | None) -> DataFrame:
    """Self-recall@1 of several search modes over the same queries and filters, one job.

    ``results`` maps a mode name to its result table; both sides are tagged
    with the mode and scored by one grouped aggregate.
    """
    tagged_r = [tag(r.select("qid", "id", "d", "rk"), m) for m, r in results.items()]
    tagged_q = [tag(queries, m) for m in results]
    allr, allq = tagged_r[0], tagged_q[0]
    for r, q in zip(tagged_r[1:], tagged_q[1:]):
        allr, allq = allr.unionByName(r), allq.unionByName(q)
    return self_recall(allr, allq, cond, by=["mode"])
