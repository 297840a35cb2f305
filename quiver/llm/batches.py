"""A byte limit for the Arrow batches in which texts reach Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20  # Spark's own limit is 64 MiB and 10,000 rows; a single row may exceed either


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limit, so that a worker's memory follows the texts' bytes and not their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
