"""Binary vector files as a Spark data source (``vecbin``).

Formats (suffix, case-insensitive):

* ``.fbin`` float32, ``.f16bin`` float16, ``.ibin`` int32, ``.u8bin`` uint8,
  ``.i8bin`` int8: 8-byte header (n uint32, d uint32), then n*d values row-major.
* ``.fvecs``: per record an int32 dimension, then d float32 values.

Only the headers (and file sizes) are read on the driver. Each partition is a
byte range of whole records, read a few MiB at a time, decoded with numpy and
returned as Arrow batches; ``pos`` is the row's position across the files in
name order. Files are opened through Arrow's file systems, so a path is a plain
one, ``file:``, or any scheme that Arrow serves (``hdfs://``, ``s3://``, ``gs://``).

Writing goes through the same data source: tasks write files of at most
``FILE_BYTES`` under temporary names, and the commit of the whole write gives them
their own, so a failed or speculative attempt leaves no part behind.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quiver.operators.topk_kernel import vectors_from_arrow

# Suffix -> element type of the binary formats.
SUFFIX_DTYPES = {
    ".fbin": "float32",
    ".f16bin": "float16",
    ".ibin": "int32",
    ".u8bin": "uint8",
    ".i8bin": "int8",
}
FVECS = ".fvecs"
DEFAULT_ROWS_PER_PARTITION = 100_000


BATCH_BYTES = 4 << 20  # of a file decoded at once
FILE_BYTES = 64 << 20  # of a written file, which a task holds until it is full


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def file_kind(path: str) -> str:
    low = path.lower()
    if low.endswith(FVECS):
        return FVECS
    for suf in SUFFIX_DTYPES:
        if low.endswith(suf):
            return suf
    raise ValueError(f"unrecognized vector file suffix for {path!r}; expected one of {[*SUFFIX_DTYPES, FVECS]}")


def header(path: str, fs: pafs.FileSystem | None = None) -> tuple[int, int, int, int]:
    """(rows, dim, record_bytes, data_offset) of a file (within ``fs``, if given); raises on size mismatch."""
    if fs is None:
        fs, path = file_system(path)
    kind, size = file_kind(path), fs.get_file_info(path).size
    if size is None:
        raise FileNotFoundError(path)
    if kind == FVECS and size == 0:
        return 0, 0, 0, 0
    with fs.open_input_file(path) as f:
        head = f.read_at(8, 0)
    if kind == FVECS:
        dim = int(np.frombuffer(head[:4], dtype=np.int32)[0]) if len(head) >= 4 else 0
        if dim <= 0:
            raise ValueError(f"{path}: dimension must be > 0, got {dim}")
        rec = 4 + 4 * dim
        if size % rec:
            raise ValueError(f"{path}: size {size} is not a multiple of the record size {rec}")
        return size // rec, dim, rec, 0
    if len(head) < 8:
        raise ValueError(f"{path}: missing 8-byte header")
    n, d = (int(x) for x in np.frombuffer(head, dtype=np.uint32))
    item = np.dtype(SUFFIX_DTYPES[kind]).itemsize
    if size - 8 != n * d * item:
        raise ValueError(f"{path}: expected {n * d} elements, got {(size - 8) // item}")
    return n, d, d * item, 8


def matrices(fs: pafs.FileSystem, path: str, start: int, count: int):
    """The records ``start`` to ``start + count`` of a file as matrices of at most ``BATCH_BYTES``, by ranged reads."""
    _, d, rec, off = header(path, fs)
    kind, step = file_kind(path), max(1, BATCH_BYTES // max(rec, 1))
    with fs.open_input_file(path) as f:
        for at in range(start, start + count, step):
            n = min(step, start + count - at)
            buf = f.read_at(n * rec, off + at * rec)
            if kind != FVECS:
                yield at, np.frombuffer(buf, dtype=SUFFIX_DTYPES[kind]).reshape(n, d)
                continue
            raw = np.frombuffer(buf, dtype=np.int32).reshape(n, 1 + d)
            if (raw[:, 0] != d).any():
                raise ValueError(f"{path}: record with a dimension other than {d}")
            yield at, raw[:, 1:].view(np.float32)


def encoded(X: np.ndarray, kind: str) -> bytes:
    """A file's bytes."""
    n, d = X.shape
    if kind == FVECS:
        rec = np.empty((n, 1 + d), dtype=np.int32)
        rec[:, 0] = d
        rec[:, 1:] = X.astype(np.float32).view(np.int32)
        return rec.tobytes()
    return np.array([n, d], dtype=np.uint32).tobytes() + X.astype(SUFFIX_DTYPES[kind]).tobytes()


@dataclass
class _Range(InputPartition):
    path: str
    start: int  # first row in file
    count: int
    base: int  # global position of row 0 of this file
    dim: int


class VecBinDataSource(DataSource):
    """``spark.read.format("vecbin").option("path", p).load()`` -> ``(pos long, embed array<float>)``.

    Options: ``path`` (file, directory or a pattern in its last part), ``rowsPerPartition``,
    ``as`` = ``float`` (default) or ``long`` for id matrices (ground truth).

    ``df.write.format("vecbin").option("path", p).option("suffix", ".fbin")`` writes a one-column
    table of vectors, each task's rows in order; mode ``overwrite`` replaces the suffix's files of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        el = "long" if self.options.get("as", "float") == "long" else "float"
        return f"pos long, embed array<{el}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def _expand(fs: pafs.FileSystem, path: str) -> list[str]:
    folder, last = posixpath.split(path.rstrip("/"))
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder or ".")) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        found = [fs.get_file_info(path)]
        if found[0].type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(path))
    files = sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
    if not files:
        raise FileNotFoundError(path)
    return files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rpp = int(options.get("rowsPerPartition", DEFAULT_ROWS_PER_PARTITION))
        self.as_long = options.get("as", "float") == "long"

    def partitions(self):
        parts, base, dims = [], 0, set()
        fs, path = file_system(self.path)
        for f in _expand(fs, path):
            n, d, _, _ = header(f, fs)
            if n:
                dims.add(d)
            for s in range(0, n, self.rpp):
                parts.append(_Range(f, s, min(self.rpp, n - s), base, d))
            base += n
        if len(dims) > 1:
            raise ValueError(f"files of different dimensions: {sorted(dims)}")
        return parts or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range):
        import pyarrow as pa

        p = partition
        if p.count == 0:
            return
        for at, X in matrices(file_system(self.path)[0], p.path, p.start, p.count):
            n, d = X.shape
            X = X.astype(np.int64 if self.as_long else np.float32)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
            pos = pa.array(np.arange(p.base + at, p.base + at + n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pos, pa.ListArray.from_arrays(offsets, pa.array(X.ravel()))], names=["pos", "embed"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]  # temporary names; a file's own is what follows the last "~"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ".fbin"), overwrite
        self.kind, self.run = file_kind("x" + self.suffix), uuid.uuid4().hex[:8]

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        task, names, held, room = TaskContext.get().partitionId(), [], [], 0

        def put(mats: list[np.ndarray]) -> None:
            # part names sort by task, then by file, as the rows do
            names.append(f".{self.run}-{uuid.uuid4().hex}~part-{task:05d}-{len(names):05d}{self.suffix}")
            with fs.open_output_stream(f"{base}/{names[-1]}") as out:
                out.write(encoded(np.concatenate(mats) if mats else np.zeros((0, 0)), self.kind))

        for batch in iterator:
            if not batch.num_rows:
                continue
            X = vectors_from_arrow(batch.column(0))
            rec = (X.shape[1] + 1) * 4
            step = max(1, BATCH_BYTES // rec)
            for at in range(0, len(X), step):
                part = X[at:at + step]
                part = part.astype(np.float32 if self.kind == FVECS else SUFFIX_DTYPES[self.kind])
                if held and (room + len(part) * rec > FILE_BYTES or part.shape[1] != held[0].shape[1]):
                    put(held)
                    held, room = [], 0
                held.append(part)
                room += len(part) * rec
        if held:
            put(held)
        return _Written(names)

    def commit(self, messages) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        kept = set()
        for name in (n for m in messages if m is not None for n in m.names):
            own = name.rpartition("~")[2]
            fs.move(f"{base}/{name}", f"{base}/{own}")
            kept.add(own)
        if not kept:  # a table of no rows is one file of no rows
            kept.add(f"part-00000-00000{self.suffix}")
            with fs.open_output_stream(f"{base}/part-00000-00000{self.suffix}") as out:
                out.write(encoded(np.zeros((0, 0)), self.kind))
        for f in fs.get_file_info(pafs.FileSelector(base)) if self.overwrite else []:
            if f.base_name.startswith("part-") and f.base_name.endswith(self.suffix) and f.base_name not in kept:
                fs.delete_file(f.path)

    def abort(self, messages) -> None:
        fs, base = file_system(self.path)
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                fs.delete_file(f.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecBinDataSource)


def read_vectors(spark: SparkSession, path: str, rows_per_partition: int | None = None) -> DataFrame:
    """``(pos, embed array<float>)`` from .fbin/.f16bin/.ibin/.u8bin/.i8bin/.fvecs files."""
    register(spark)
    r = spark.read.format("vecbin").option("path", path)
    if rows_per_partition:
        r = r.option("rowsPerPartition", str(rows_per_partition))
    return r.load()


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth ``.ibin`` as ``(qid, neighbors array<long>)`` (row i = query i, nearest first)."""
    register(spark)
    df = spark.read.format("vecbin").option("path", path).option("as", "long").load()
    return df.withColumnRenamed("pos", "qid").withColumnRenamed("embed", "neighbors")


def convert_to_table(spark: SparkSession, path: str, seed: int | None = None, start_id: int = 0,
                     family: str = "fast") -> DataFrame:
    """Binary vectors to a vector table (id = start_id + position, synthetic metadata)."""
    from quiver.sources.generate import DEFAULT_SEED, metadata_for

    return metadata_for(read_vectors(spark, path), DEFAULT_SEED if seed is None else seed, start_id, family)


def write_vectors(df: DataFrame, out_dir: str, suffix: str = ".fbin", parts: int | None = None,
                  vec_col: str = "embed", order_col: str = "id") -> None:
    """Write ``vec_col`` as binary part files ``part-NNNNN-MMMMM<suffix>`` (by range of ``order_col``, then by size).

    Each file has its own header (fbin family), so that :func:`read_vectors`
    over the folder returns the rows in ``order_col`` order. The folder's earlier part files of the suffix are replaced.
    """
    register(df.sparkSession)
    n_parts = parts or df.sparkSession.sparkContext.defaultParallelism
    ordered = df.select(order_col, vec_col).repartitionByRange(n_parts, order_col).sortWithinPartitions(order_col)
    ordered.select(F.col(vec_col).alias("embed")).write.format("vecbin").mode("overwrite").option("path", out_dir).option("suffix", suffix).save()
