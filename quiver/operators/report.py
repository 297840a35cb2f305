"""M1-M4: throughput, latency and DML rates computed from a run-log table.

Run log: ``(run_id, test_name, qid, started_at timestamp, seconds double, rows long)``,
one row per executed query or DML batch. All figures are grouped aggregates
with partial (map-side) aggregation; no window is partitioned by a run or a
test, so a hot run does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_log_from_events(events: DataFrame) -> DataFrame:
    """Run-log view over the driver's ``events`` table."""
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("test_name"),
        F.col("event_id").alias("qid"),
        F.col("ts").alias("started_at"),
        F.col("value").cast("double").alias("seconds"),
        F.lit(1).cast("long").alias("rows"),
    )


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def throughput(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M1: queries / wall span (first start to last end) and mean latency in ms; 0 when empty."""
    by = by or ["test_name"]
    end = _micros("started_at") + (F.col("seconds") * 1e6)
    agg = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("seconds").alias("busy_s"),
        ((F.max(end) - F.min(_micros("started_at"))) / 1e6).alias("wall_s"),
    )
    return agg.select(
        *by,
        "queries",
        F.when(F.col("wall_s") > 0, F.col("queries") / F.col("wall_s")).otherwise(F.lit(0.0)).alias("qps"),
        F.when(F.col("queries") > 0, F.col("busy_s") / F.col("queries") * 1000.0).otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        "wall_s",
    )


def rows_per_second(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M2: rows (or operations) per second of busy time."""
    by = by or ["test_name"]
    agg = log.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("time_s"))
    return agg.select(
        *by, "rows", "time_s",
        F.when(F.col("time_s") > 0, F.col("rows") / F.col("time_s")).otherwise(F.lit(0.0)).alias("rows_per_sec"),
    )


def cold_start(log: DataFrame) -> DataFrame:
    """M3: per run, the first query's seconds apart from the mean of the rest."""
    agg = log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("seconds").alias("total_s"),
        F.min_by("seconds", F.struct(F.col("started_at"), F.col("qid"))).alias("cold_s"),
    )
    return agg.select(
        "run_id",
        "n",
        "cold_s",
        F.when(F.col("n") > 1, (F.col("total_s") - F.col("cold_s")) / (F.col("n") - 1)).alias("warm_avg_s"),
    )


def merge_stats(tables: list[DataFrame], label: str | None = None) -> DataFrame:
    """M4: union ragged stats tables by name (missing columns NULL), columns sorted."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    cols = sorted(out.columns)
    if label is not None and "test_name" not in cols:
        out = out.withColumn("test_name", F.lit(label))
        cols = sorted(out.columns)
    return out.select(*cols)


def write_report(df: DataFrame, path: str) -> None:
    """M4: CSV report with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
