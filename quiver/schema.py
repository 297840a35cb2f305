"""Vector table schema, run configuration and the fixture views over the driver tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_table_schema(dim: int | None = None) -> T.StructType:
    """``(id, embed, i32v, f32v, strv)``; the dimension is kept as column metadata."""
    meta = {"dim": dim} if dim else {}
    return T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("embed", T.ArrayType(T.FloatType(), containsNull=False), False, metadata=meta),
            T.StructField("i32v", T.IntegerType(), True),
            T.StructField("f32v", T.FloatType(), True),
            T.StructField("strv", T.StringType(), True),
        ]
    )


VECTOR_COLUMNS = ["id", "embed", "i32v", "f32v", "strv"]

# CSV column names and their table names: vector -> embed, str -> strv.
CSV_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.StringType()),
        T.StructField("i32v", T.IntegerType()),
        T.StructField("f32v", T.FloatType()),
        T.StructField("str", T.StringType()),
    ]
)


@dataclass(frozen=True)
class IndexConfig:
    type: str = "ivfflat"
    op_type: str = "vector_l2_ops"
    lists: int | None = None
    m: int | None = None
    bits_per_code: int = 8
    quantization: str = "float32"
    graph_degree: int = 64
    intermediate_graph_degree: int = 128
    itopk_size: int = 64
    ef_construction: int | None = None
    ef_search: int | None = None
    distribution_mode: str = "sharded"
    n_probes: int | None = None
    search_width: int | None = None


@dataclass(frozen=True)
class Config:
    table: str = "vectors"
    dimension: int = 0
    dataset_size: int = 0
    batch_size: int = 1000
    index: IndexConfig = field(default_factory=IndexConfig)
    probe_limit: int = 1
    kmeans_train_percent: float = 10.0
    distance: str = "vector_l2_ops"

    @property
    def probes(self) -> int:
        """Lists to probe: the index's own ``n_probes``, else the run's ``probe_limit``."""
        return self.index.n_probes or self.probe_limit

    @property
    def metric(self) -> str:
        return self.index.op_type or self.distance

    @staticmethod
    def from_json(text: str) -> Config:
        raw = json.loads(text)
        idx = raw.get("index", {})
        env = raw.get("env", {})
        if isinstance(idx, str):
            idx = {"type": idx, "op_type": raw.get("distance", "vector_l2_ops")}
        known = IndexConfig.__dataclass_fields__
        # `lists` and `n_lists` are both accepted.
        if "n_lists" in idx and "lists" not in idx:
            idx = {**idx, "lists": idx["n_lists"]}
        ic = IndexConfig(**{k: v for k, v in idx.items() if k in known})
        return Config(
            table=raw.get("table", "vectors"),
            dimension=int(raw.get("dimension", 0)),
            dataset_size=int(raw.get("dataset_size", 0)),
            batch_size=int(raw.get("batch_size", 1000)),
            index=ic,
            probe_limit=int(env.get("probe_limit", raw.get("probe_limit", 1))),
            kmeans_train_percent=float(env.get("kmeans_train_percent", 10.0)),
            distance=raw.get("distance", "vector_l2_ops"),
        )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture vector table over ``embeddings`` (integer arithmetic until the last step)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("embed"),
        ((F.col("vec_id") * 7919) % 1000).cast("int").alias("i32v"),
        (((F.col("vec_id") * 104729) % 1000).cast("double") / 1000.0).cast("float").alias("f32v"),
        F.concat(F.lit("s"), (F.col("vec_id") % 17).cast("string")).alias("strv"),
        F.col("label"),
    )


def queries_from(table: DataFrame) -> DataFrame:
    """Self-query set: every stored row is a query (``qid`` = its id)."""
    return table.select(F.col("id").alias("qid"), F.col("embed"))


# DuckDB twin of `vectors`, used by oracle SQL.
VECTORS_SQL = (
    "SELECT vec_id AS id, embedding AS embed, CAST((vec_id * 7919) % 1000 AS INTEGER) AS i32v, "
    "CAST(CAST((vec_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS FLOAT) AS f32v, "
    "concat('s', CAST(vec_id % 17 AS VARCHAR)) AS strv, label FROM embeddings"
)
