"""Running sums over a global order, without a single-task window.

Rows are range partitioned and sorted; each partition numbers its rows and sums
what comes before them, and writes that with its partition number to the shared
checkpoint folder. Only one total per partition is then summed up to give every
partition its offset. The result does not depend on where ranges are cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiver.session import scratch_dir


def running_sum(spark: SparkSession, df: DataFrame, order: list, value: str, partitions: int) -> DataFrame:
    """``df`` plus ``before``: the sum of ``value`` (long) over all rows that come earlier in ``order``."""
    at = df.columns.index(value)

    def local(batches):
        total = 0
        for batch in batches:
            v = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - v)], [*batch.schema.names, "before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    path = scratch_dir(spark, "ordered")
    laid = df.repartitionByRange(max(1, partitions), *order).sortWithinPartitions(*order)
    laid.mapInArrow(local, f"{fields}, before long").withColumn("part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.parquet(path)
    totals = laid.groupBy("part").agg(F.sum(value).alias("total"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    return laid.join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset")
