"""An IVF index that takes its rows chunk by chunk.

A chunk is added under a name of its own and written below that name, so adding it
again (a retry) replaces it and no earlier chunk is read. Chunks added before the
centroids exist wait in ``staged/`` with a sample: the ``sample_rows`` rows of
least hash. The least of the samples' rows are the sample of all rows, whatever
the chunks were (a reservoir that can be merged), and ``build`` trains on it, then
assigns each waiting chunk once. Chunks added later are only assigned.

::

    <path>/staged/chunk=<name>, sample/chunk=<name>      before the build
    <path>/centroids, meta.json                          the build; meta.json commits it
    <path>/rows/chunk=<name>/list_id=<l>                 rows by list
    <path>/stats/chunk=<name>                            (list_id, n, radius) of the chunk's lists

Defined results: an empty chunk adds nothing; null vectors are as in ``build_ivf``; an id that two
chunks hold is held twice, as ids are the table's matter (``dml.bulk_load`` checks them). Columns
must be the same in every chunk.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vector import resolve_metric
from quiver.operators import dml, expand, ivf

SAMPLE_ROWS = 100_000  # rows kept for training (documented bound); every row is assigned


class ChunkedIvf:
    """The index at ``path``, made by the first ``add``; a later object of the same path goes on with it."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2", *, vec_col: str = "embed", seed: int = 42,
                 sample_rows: int = SAMPLE_ROWS):
        self.spark, self.path = spark, path.rstrip("/")
        self.metric, self.vec_col, self.seed, self.sample_rows = resolve_metric(metric), vec_col, seed, sample_rows
        if self.built:
            meta = json.loads(ivf._read_text(spark, f"{self.path}/meta.json"))
            self.metric, self.vec_col, self.seed = meta["metric"], meta["vec_col"], meta["seed"]

    @property
    def built(self) -> bool:
        return ivf.exists(self.spark, f"{self.path}/meta.json")

    def chunks(self, folder: str) -> list[str]:
        """Names of the chunks below ``folder`` that were written to the end."""
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        return sorted(n.partition("=")[2] for n in found if n.startswith("chunk=") and ivf.exists(self.spark, f"{self.path}/{folder}/{n}/_SUCCESS"))

    def _table(self, folder: str) -> DataFrame:
        base = f"{self.path}/{folder}"
        return self.spark.read.option("basePath", base).parquet(*(f"{base}/chunk={n}" for n in self.chunks(folder)))

    def add(self, name: str, rows: DataFrame) -> None:
        """Adds the chunk ``name`` (letters, digits, ``_``, ``-``), or replaces it."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"not a chunk name: {name!r}")
        if self.built:
            self._assign(name, rows)
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/chunk={name}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/staged/chunk={name}")
        self._least(own.select("id", self.vec_col).withColumn("draw", F.xxhash64("id", F.lit(self.seed)))).write.mode("overwrite").parquet(
            f"{self.path}/sample/chunk={name}")

    def _least(self, rows: DataFrame) -> DataFrame:
        return dml.smallest_n(rows, self.sample_rows, ["draw", "id"])

    def sample(self) -> DataFrame:
        """The training sample ``(id, <vec_col>)`` of all waiting chunks, read from the chunks' samples alone."""
        return self._least(self._table("sample").select("id", self.vec_col, "draw")).drop("draw")

    def build(self, lists: int | None = None, n_probes: int = 1, centroids: DataFrame | None = None) -> ivf.IvfIndex:
        """Trains on the sample (or takes ``centroids``) and assigns every waiting chunk; after a failure it may be called again."""
        if self.built:
            raise ValueError(f"{self.path} is built already")
        waiting = self.chunks("staged")
        if not waiting:
            raise ValueError("no chunk was added")
        staged = self._table("staged")
        if centroids is None:
            centroids = ivf.train_centroids(self.sample(), lists or ivf.lists_rule(staged.count()), 100.0, self.metric, self.seed, self.vec_col)
        centroids.select("list_id", "centroid").write.mode("overwrite").parquet(f"{self.path}/centroids")
        for name in waiting:  # each chunk is read once
            self._assign(name, staged.where(F.col("chunk") == name).drop("chunk"))
        fields = [f for f in staged.schema.fields if f.name != "chunk"]
        schema = T.StructType([*fields, T.StructField("list_id", T.IntegerType())]).jsonValue()
        meta = {"type": "ivfflat", "metric": self.metric, "vec_col": self.vec_col, "seed": self.seed, "n_probes": n_probes, "schema": schema}
        ivf._write_text(self.spark, f"{self.path}/meta.json", json.dumps(meta))
        for folder in ("staged", "sample"):
            ivf.drop_index(self.spark, f"{self.path}/{folder}")
        return self.index()

    def _assign(self, name: str, rows: DataFrame) -> None:
        centroids = self.spark.read.parquet(f"{self.path}/centroids")
        arrays = ivf.centroid_arrays(centroids)
        out = f"{self.path}/rows/chunk={name}"
        ivf.drop_index(self.spark, f"{self.path}/stats/chunk={name}")  # a chunk counts once its figures are there
        assigned = ivf.assign(rows, centroids, self.metric, self.vec_col, arrays=arrays)
        assigned.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(out)
        own = self.spark.read.schema(assigned.schema).parquet(out)
        radii = expand.radii(own, arrays, expand.vector_offsets(self.metric), [self.vec_col])
        sizes = own.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
        sizes.join(radii, "list_id").write.mode("overwrite").parquet(f"{self.path}/stats/chunk={name}")

    def index(self, n_probes: int | None = None) -> ivf.IvfIndex:
        """The index over all chunks added so far; sizes and radii come from the chunks' figures."""
        meta = json.loads(ivf._read_text(self.spark, f"{self.path}/meta.json"))
        centroids = self.spark.read.parquet(f"{self.path}/centroids")
        names, base = self.chunks("stats"), f"{self.path}/rows"
        lists = self.spark.read.schema(T.StructType.fromJson(meta["schema"])).option("basePath", base).parquet(*(f"{base}/chunk={n}" for n in names)).drop("chunk")
        stats = self._table("stats").groupBy("list_id").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        index = ivf.IvfIndex(centroids, lists, stats.select("list_id", "n"), meta["metric"], n_probes or meta["n_probes"], meta["vec_col"],
                             None, {**meta, "appended": True})
        far = {r["list_id"]: r["radius"] for r in stats.collect()}  # a row per list
        index._radii = np.array([far.get(int(c), -1.0) for c in index.centroid_matrix()[0]])
        return index
