"""Vector table lifecycle and DML as DataFrame rewrites.

Parquet tables have no row-level DELETE/UPDATE, so each operation is a pure
``DataFrame -> DataFrame`` rewrite (union, join + coalesce, anti join) and
writing is separate: :func:`write_version` writes a new version directory and
never overwrites the path being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import ensure_checkpoint_dir
from quiver.schema import VECTOR_COLUMNS, vector_table_schema
from quiver.sources.generate import DEFAULT_SEED, rows_for_ids, uniform

# Above this many ids a sample is selected by range partitioning instead of a
# single-task top-n merge.
TAKE_ORDERED_MAX = 10_000
# Updates/inserted rows up to this many bytes are broadcast into the join.
BROADCAST_ROWS_BYTES = 64 << 20


def create_table(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """An empty vector table at ``path``."""
    empty = spark.createDataFrame([], vector_table_schema(dim))
    empty.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Drop the table directory if it exists."""
    from quiver.operators.ivf import drop_index

    drop_index(spark, path)


def setup_database(spark: SparkSession, name: str) -> None:
    """Create the database if absent and make it current."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.catalog.setCurrentDatabase(name)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a table version as ``base/v=<version>``; readers of older versions are unaffected."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def bulk_load(table: DataFrame, rows: DataFrame, check_unique: bool = True) -> DataFrame:
    """Append rows (from CSV or the generator) to the table.

    With ``check_unique`` new ids that are already present, or repeated among
    the new rows, raise: the table has a primary key.
    """
    new = rows.select(*VECTOR_COLUMNS)
    if check_unique:
        clash = new.join(table.select("id"), "id", "left_semi").limit(1).count()
        if clash:
            raise ValueError("appended rows reuse existing ids")
        if new.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("appended rows repeat an id")
    return table.select(*VECTOR_COLUMNS).unionByName(new)


def max_id(table: DataFrame) -> DataFrame:
    """T5: one row ``max_id`` (0 when the table is empty)."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("max_id"))


def _hash_key(seed: int, family: str) -> F.Column:
    return uniform(seed, F.col("id"), 0, family)


def sample_ids(table: DataFrame, n: int, seed: int = DEFAULT_SEED, family: str = "fast",
               take_ordered_max: int = TAKE_ORDERED_MAX) -> DataFrame:
    """Exactly ``min(n, rows)`` ids in random order (hash of seed and id, then id).

    Small n: sort + limit (per-partition top-n, then one merge). Large n: rows
    are range partitioned by the hash key and written to the shared checkpoint
    folder; only per-partition counts reach the driver, whole partitions below
    the n-th key are taken and only the boundary partition is ranked.
    """
    keyed = table.select("id", _hash_key(seed, family).alias("h"))
    return smallest_n(keyed, n, ["h", "id"], take_ordered_max).select("id")


def smallest_n(df: DataFrame, n: int, keys: list[str], take_ordered_max: int = TAKE_ORDERED_MAX) -> DataFrame:
    """The ``n`` rows of ``df`` that come first in ``keys`` order (keys unique), without one task holding them.

    Small n: sort + limit. Large n: one range partitioning by the keys,
    checkpointed to the shared folder; only per-partition counts reach the
    driver; partitions wholly below the n-th row are kept as they are and only
    the boundary partition is ranked.
    """
    if n <= take_ordered_max:
        return df.orderBy(*keys).limit(int(n))
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = sorted((r["_pid"], r["c"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect())
    taken, full = 0, []
    boundary, rest = None, 0
    for pid, c in counts:
        if taken + c <= n:
            full.append(pid)
            taken += c
        else:
            boundary, rest = pid, n - taken
            break
    out = ranged.where(F.col("_pid").isin(full))
    if boundary is not None and rest > 0:
        out = out.unionByName(ranged.where(F.col("_pid") == boundary).orderBy(*keys).limit(rest))
    return out.drop("_pid")


def insert(table: DataFrame, n: int, dim: int, seed: int = DEFAULT_SEED, family: str = "fast") -> DataFrame:
    """N generated rows at ``max_id + 1 ..`` (first id 1 on an empty table), appended."""
    spark = table.sparkSession
    start = int(max_id(table).first()["max_id"]) + 1  # one number through the driver
    ids = spark.range(start, start + n)
    return table.select(*VECTOR_COLUMNS).unionByName(rows_for_ids(ids, dim, seed, family))


def update(table: DataFrame, ids: DataFrame, dim: int, seed: int = DEFAULT_SEED, family: str = "fast",
           n_hint: int | None = None) -> DataFrame:
    """New ``embed`` and ``i32v`` for the given ids; ``f32v`` and ``strv`` kept.

    New values are generated from (seed, id), so they do not depend on the
    order the ids were drawn in. The update side is broadcast only when its
    size is known to be small.
    """
    new = rows_for_ids(ids.select("id").distinct(), dim, seed, family).select(
        "id", F.col("embed").alias("new_embed"), F.col("i32v").alias("new_i32v")
    )
    if n_hint is not None and n_hint * (dim * 4 + 16) <= BROADCAST_ROWS_BYTES:
        new = F.broadcast(new)
    j = table.select(*VECTOR_COLUMNS).join(new, "id", "left")
    return j.select(
        "id",
        F.coalesce("new_embed", "embed").alias("embed"),
        F.coalesce("new_i32v", "i32v").alias("i32v"),
        "f32v",
        "strv",
    )


def delete(table: DataFrame, ids: DataFrame, n_hint: int | None = None) -> DataFrame:
    """Remove rows whose id is in ``ids`` (anti join; the ids are broadcast only when known to be few)."""
    gone = ids.select("id")
    if n_hint is not None and n_hint * 16 <= BROADCAST_ROWS_BYTES:
        gone = F.broadcast(gone)
    return table.join(gone, "id", "left_anti").select(*VECTOR_COLUMNS)


def mix_counts(batch: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Per batch ``int(b*ri)`` inserts, ``int(b*ru)`` updates, the rest deletes."""
    tot = float(sum(ratios))
    if tot <= 0 or len(ratios) != 3:
        raise ValueError("ratios must be three non-negative numbers with a positive sum")
    ni = int(batch * (ratios[0] / tot))
    nu = int(batch * (ratios[1] / tot))
    return ni, nu, batch - ni - nu


OVERLAY = "id long, embed array<float>, i32v int, f32v float, strv string, is_new boolean, gone boolean"


def mix(table: DataFrame, total_ops: int, ratios=(1, 8, 1), batch_size: int = 1000, dim: int | None = None,
        seed: int = DEFAULT_SEED, family: str = "fast", report: bool = False):
    """Mixed workload; per batch insert, then update, then delete, in that order.

    The batches work on an overlay of the rows they touch (at most one per
    operation), written to the shared checkpoint folder after each batch; of
    the table itself a batch reads the ids alone, and the overlay is merged into it
    once at the end. New ids go on from the last inserted one, so the id of
    a deleted row is never used again.
    With ``report=True`` returns ``(table, stats)`` where ``stats`` has one row
    per batch with the planned operations and the rows actually affected
    (a sample cannot exceed the table), for the M2/M4 reports.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    if dim is None:
        dim = int(table.select(F.size("embed")).first()[0])
    base = table.select(*VECTOR_COLUMNS)
    overlay = spark.createDataFrame([], OVERLAY)
    next_id = int(max_id(table).first()["max_id"]) + 1 if total_ops > 0 else 0
    done, b, stats = 0, 0, []
    while done < total_ops:
        cb = min(batch_size, total_ops - done)
        ni, nu, nd = mix_counts(cb, ratios)
        s = seed + 1000 * b
        affected = [ni, 0, 0]
        if ni:
            new = rows_for_ids(spark.range(next_id, next_id + ni), dim, s, family)
            overlay = overlay.unionByName(new.withColumn("is_new", F.lit(True)).withColumn("gone", F.lit(False)))
            next_id += ni
        for op, n in (("update", nu), ("delete", nd)):
            if not n:
                continue
            ids = sample_ids(_live_ids(base, overlay), n, s + (1 if op == "update" else 3), family).checkpoint(eager=True)
            if report:
                affected[1 if op == "update" else 2] = ids.count()
            overlay = _updated(overlay, ids, dim, s + 2, family) if op == "update" else _gone(overlay, ids)
        overlay = overlay.checkpoint(eager=True)
        stats.append((b, cb, ni, nu, nd, *affected))
        done += cb
        b += 1
    out = merge_overlay(base, overlay)
    if not report:
        return out
    stats_df = spark.createDataFrame(
        stats, "batch int, ops int, planned_insert int, planned_update int, planned_delete int, "
               "inserted long, updated long, deleted long")
    return out, stats_df


def _live_ids(base: DataFrame, overlay: DataFrame) -> DataFrame:
    dead = overlay.where("gone and not is_new").select("id")
    return base.select("id").join(dead, "id", "left_anti").unionByName(overlay.where("is_new and not gone").select("id"))


def _updated(overlay: DataFrame, ids: DataFrame, dim: int, seed: int, family: str) -> DataFrame:
    """The overlay with new ``embed`` and ``i32v`` for ``ids``; rows of the table get an overlay row without the rest."""
    new = rows_for_ids(ids, dim, seed, family).select("id", F.col("embed").alias("e"), F.col("i32v").alias("i"))
    j = overlay.join(new, "id", "full")
    return j.select("id", F.coalesce("e", "embed").alias("embed"), F.coalesce("i", "i32v").alias("i32v"), "f32v", "strv",
                    F.coalesce("is_new", F.lit(False)).alias("is_new"), F.coalesce("gone", F.lit(False)).alias("gone"))


def _gone(overlay: DataFrame, ids: DataFrame) -> DataFrame:
    j = overlay.join(ids.withColumn("del", F.lit(True)), "id", "full")
    return j.select("id", "embed", "i32v", "f32v", "strv", F.coalesce("is_new", F.lit(False)).alias("is_new"),
                    (F.coalesce("gone", F.lit(False)) | F.coalesce("del", F.lit(False))).alias("gone"))


def merge_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The table after the overlay's inserts, updates and deletes: one join."""
    new = overlay.where("is_new and not gone").select(*VECTOR_COLUMNS)
    touched = overlay.where("not is_new").select("id", F.col("embed").alias("e"), F.col("i32v").alias("i"), "gone")
    kept = base.join(touched, "id", "left").where("gone is null or not gone")
    kept = kept.select("id", F.coalesce("e", "embed").alias("embed"), F.coalesce("i", "i32v").alias("i32v"), "f32v", "strv")
    return kept.unionByName(new)
