"""Structured Streaming generator and streaming index maintenance.

* :func:`generator_stream` — an unbounded, id-ordered stream of synthetic rows
  from the ``rate-micro-batch`` source (back-pressure is the trigger).
* :func:`generate_for_stream` — the same generator over any stream of ids.
* :func:`maintain_ivf` — rows arriving on a stream are assigned to the frozen
  centroids of an existing index and appended to its lists; each micro-batch
  is written to ``lists_stream/batch_id=N`` with overwrite, so a replayed batch
  after a failure rewrites the same files (idempotent, exactly-once output).
  Retraining centroids is a batch job.
* :func:`maintain_ivfpq` — the same for IVF-PQ: rows are assigned and encoded with the frozen centroids and codebook.
* :func:`compact_lists` — the many small files of such batches become one set of files per list, under a manifest that
  is written when the new files are complete: readers see the batches or their compacted form, never both.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import ivf, pq
from quiver.sources.generate import DEFAULT_SEED, rows_for_ids


def generator_stream(spark: SparkSession, dim: int, rows_per_batch: int = 1000, start_id: int = 0,
                     seed: int = DEFAULT_SEED, partitions: int | None = None, family: str = "fast") -> DataFrame:
    """Streaming synthetic rows with ids ``start_id, start_id+1, ...``."""
    r = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", int(rows_per_batch))
    if partitions:
        r = r.option("numPartitions", int(partitions))
    ids = r.load().select((F.col("value") + F.lit(int(start_id))).alias("id"))
    return rows_for_ids(ids, dim, seed, family)


def generate_for_stream(ids: DataFrame, dim: int, seed: int = DEFAULT_SEED, family: str = "fast") -> DataFrame:
    """S7 applied to a stream of ids."""
    return rows_for_ids(ids, dim, seed, family)


def write_batches(stream: DataFrame, out_path: str, checkpoint: str, partition_by: list[str] | None = None,
                  transform=None, available_now: bool = True):
    """foreachBatch sink writing ``out_path/batch_id=N`` with overwrite (idempotent on replay)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        df = transform(batch) if transform else batch
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    ws = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    ws = ws.trigger(availableNow=True) if available_now else ws
    return ws.start()


def maintain_ivf(stream: DataFrame, index: ivf.IvfIndex, out_path: str, checkpoint: str, available_now: bool = True):
    """Assign streamed rows to the index's frozen centroids and append them to its lists."""
    # Frozen for the life of the stream: materialised once (size-checked)
    # instead of being recomputed per batch.
    centroids = ivf.freeze_centroids(index.centroids)

    def assign(batch: DataFrame) -> DataFrame:
        return ivf.assign(batch, centroids, index.metric, index.vec_col)

    return write_batches(stream, out_path, checkpoint, ["list_id"], assign, available_now)


def maintain_ivfpq(stream: DataFrame, index: pq.IvfPqIndex, out_path: str, checkpoint: str, available_now: bool = True):
    """Streamed rows get their list and codes from the index's frozen centroids and codebook."""
    centroids, codebook = ivf.freeze_centroids(index.coarse.centroids), index.codebook_array()
    arrays, unit = ivf.centroid_arrays(centroids), index.metric == "cosine"
    columns = [c for c in index.codes.columns if c != "list_id"]

    def encode(batch: DataFrame) -> DataFrame:
        rows = ivf.assign(batch, centroids, index.metric, index.coarse.vec_col, arrays=arrays)
        coded = pq.encode(rows, None, centroids, index.coarse.vec_col, cb_array=codebook, cen_arrays=arrays, unit=unit)
        return coded.select(*columns, "list_id")

    return write_batches(stream, out_path, checkpoint, ["list_id"], encode, available_now)


def read_stream_lists(spark: SparkSession, out_path: str) -> DataFrame:
    """The rows appended by :func:`maintain_ivf` or :func:`maintain_ivfpq`: the compacted ones and the batches since."""
    base = out_path.rstrip("/")
    manifest = _manifest(spark, base)
    if manifest is None:
        return spark.read.parquet(base)
    rows = spark.read.parquet(f"{base}/{manifest['base']}")
    later = [n for n in _batches(spark, base) if n > manifest["upto"]]
    if not later:
        return rows
    return rows.unionByName(spark.read.option("basePath", base).parquet(*(f"{base}/batch_id={n}" for n in later)).select(rows.columns))


def compact_lists(spark: SparkSession, out_path: str, upto: int | None = None) -> dict | None:
    """Rewrites the batches up to ``upto`` (default: all that are complete) as files per list; returns the manifest.

    A reader of the old files must be done before they go; a batch that a stream replays after it was
    compacted stays out of sight, as the manifest covers it.
    """
    base = out_path.rstrip("/")
    old, batches = _manifest(spark, base), _batches(spark, base)
    fresh = [n for n in batches if (old is None or n > old["upto"]) and (upto is None or n <= upto)]
    if not fresh:
        return old
    rows = spark.read.option("basePath", base).parquet(*(f"{base}/batch_id={n}" for n in fresh)).drop("batch_id")
    if old is not None:
        rows = spark.read.parquet(f"{base}/{old['base']}").unionByName(rows)
    generation = 0 if old is None else old["generation"] + 1
    manifest = {"generation": generation, "base": f"_compacted/{generation}", "upto": max(fresh)}
    rows.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{base}/{manifest['base']}")
    ivf._write_text(spark, f"{base}/_manifests/{generation:09d}.part", json.dumps(manifest))
    fs, path = _fs(spark, base)
    fs.rename(path(f"{base}/_manifests/{generation:09d}.part"), path(f"{base}/_manifests/{generation:09d}.json"))  # the commit
    for n in batches:
        if n <= manifest["upto"]:
            ivf.drop_index(spark, f"{base}/batch_id={n}")
    if old is not None:
        ivf.drop_index(spark, f"{base}/{old['base']}")
    return manifest


def _fs(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def _manifest(spark: SparkSession, base: str) -> dict | None:
    done = sorted(n for n in _names(spark, f"{base}/_manifests") if n.endswith(".json"))
    return json.loads(ivf._read_text(spark, f"{base}/_manifests/{done[-1]}")) if done else None


def _batches(spark: SparkSession, base: str) -> list[int]:
    """Batches whose files are complete and not empty."""
    found = [n for n in _names(spark, base) if n.startswith("batch_id=")]
    done = [n for n in found if {"_SUCCESS"} < set(_names(spark, f"{base}/{n}"))]
    return sorted(int(n.partition("=")[2]) for n in done)
