"""Vector CSV datasets.

CSV layout: header ``id,vector,i32v,f32v,str``; the vector is quoted text
``[x,y,...]``; CRLF line ends are accepted. Always read with an explicit schema.
Gzip files are not splittable: write chunked output (W3) for parallel loads.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions.vector import parse_vector, strict_vector, to_text
from quiver.schema import CSV_SCHEMA


# Hadoop zlib compression level names for gzip levels 0-9.
ZLIB_LEVELS = {
    0: "NO_COMPRESSION",
    1: "BEST_SPEED",
    2: "TWO",
    3: "THREE",
    4: "FOUR",
    5: "FIVE",
    6: "SIX",
    7: "SEVEN",
    8: "EIGHT",
    9: "BEST_COMPRESSION",
}


def expand_paths(spark: SparkSession, files: Iterable[str] = (), prefix: str | None = None) -> list[str]:
    """Explicit files plus every file whose basename starts with ``prefix``, sorted by name."""
    out = list(files)
    if prefix:
        jvm = spark.sparkContext._jvm
        d, base = os.path.split(prefix)
        jdir = jvm.org.apache.hadoop.fs.Path(d or ".")
        fs = jdir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(
            st.getPath().toString()
            for st in fs.listStatus(jdir)
            if st.isFile() and st.getPath().getName().startswith(base)
        )
        out.extend(found)
    if not out:
        raise FileNotFoundError(f"no input files (files={list(files)}, prefix={prefix!r})")
    return out


def read_csv(spark: SparkSession, files: Iterable[str] = (), prefix: str | None = None) -> DataFrame:
    """Vector CSV (plain or .gz) to the table schema ``(id, embed, i32v, f32v, strv)``.

    ``_file`` (the file name) is kept for file-ordered query sets (S3).
    """
    return _read_paths(spark, expand_paths(spark, files, prefix))


def _read_paths(spark: SparkSession, paths: list[str], *more) -> DataFrame:
    """The rows of CSV files, with their file and the columns ``more``."""
    raw = (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(paths)
    )
    return raw.select(
        F.col("id"),
        strict_vector("vector").alias("embed"),
        "i32v",
        "f32v",
        F.col("str").alias("strv"),
        F.col("_metadata.file_path").alias("_file"),
        *more,
    )


def query_files(spark: SparkSession, files: Iterable[str] = (), prefix: str | None = None, start_id: int = 0, n: int | None = None) -> DataFrame:
    """S3 in the order given: rows with ``id >= start_id`` of the files as listed, each in its own row order, then the first ``n``.

    A table of the files' ordinals (a row per file) is broadcast and joined on the path; within a file a row's place is
    its split's offset and its place in the split. ``ordinal, offset, place`` are kept: they are the order. A file listed twice is read twice.
    """
    from quiver.operators.dml import smallest_n

    paths = expand_paths(spark, files, prefix)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full = [(p := path(f)).getFileSystem(conf).makeQualified(p).toUri().toString() for f in paths]
    norm = lambda f: f.replace("file:///", "file:/")  # noqa: E731  both spellings of a local path
    ordinals = spark.createDataFrame([(norm(f), i) for i, f in enumerate(full)], "_path string, ordinal int")
    rows = _read_paths(spark, list(dict.fromkeys(paths)), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("place"))
    rows = rows.where(F.col("id") >= F.lit(int(start_id)))
    rows = rows.join(F.broadcast(ordinals), F.replace("_file", F.lit("file:///"), F.lit("file:/")) == F.col("_path")).drop("_path")
    order = ["ordinal", "offset", "place"]
    return rows.orderBy(*order) if n is None else smallest_n(rows, int(n), order)


def query_set(df: DataFrame, start_id: int = 0, n: int | None = None) -> DataFrame:
    """S3: rows with ``id >= start_id``, then the first ``n`` in file order (file name, id).

    Large n (e.g. a million self-queries) is selected by range partitioning
    rather than gathered into one task (see ``dml.smallest_n``).
    """
    from quiver.operators.dml import smallest_n

    q = df.where(F.col("id") >= F.lit(int(start_id)))
    order = ["_file", "id"] if "_file" in df.columns else ["id"]
    if n is None:
        return q.orderBy(*order)
    return smallest_n(q, int(n), order)


def write_csv(df: DataFrame, path: str, *, chunks: int | None = None, compress_level: int | None = None,
              mode: str = "overwrite") -> None:
    """Vector CSV with header; gzip when ``compress_level`` is given.

    ``chunks``: one file per contiguous id range (range partitioning), each
    with its own header, like per-worker output. Without it, Spark writes one
    file per partition.
    """
    out = df.select("id", to_text("embed").alias("vector"), "i32v", "f32v", F.col("strv").alias("str"))
    if chunks:
        out = out.repartitionByRange(int(chunks), "id").sortWithinPartitions("id")
    w = out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n")
    if compress_level is not None:
        # Writer options reach the Hadoop configuration of the write job; the
        # zlib codec reads its level from there.
        w = w.option("compression", "gzip").option("zlib.compress.level", ZLIB_LEVELS[int(compress_level)])
    w.csv(path)
