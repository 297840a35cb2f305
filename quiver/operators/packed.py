"""Sorted tables that every task of a search holds whole and that never pass through the driver.

Tasks sort the rows by key and write them to the shared checkpoint folder as pieces of packed arrays, a row per Arrow batch;
the tasks of the search read the pieces in order, through Arrow's file systems. Sizes are checked by the callers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from quiver.session import scratch_dir
from quiver.sources.binary import file_system

FILE_BYTES = 16 << 20


def write_packed(rows: DataFrame, by: list[str], name: str, pack, fields: list[str], size: int) -> str:
    """Writes ``rows`` (about ``size`` bytes) sorted by ``by`` and returns the folder; ``pack(batch)`` gives an array per field."""
    path = scratch_dir(rows.sparkSession, name)

    def kernel(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows:
                arrays = pack(rb)
                yield pa.RecordBatch.from_arrays([pa.array([rb.num_rows], pa.int32()), *(pa.array([arrays[f].tobytes()], pa.binary()) for f in fields)], ["n", *fields])

    ranges = rows.repartitionByRange(max(1, math.ceil(size / FILE_BYTES)), *by).sortWithinPartitions(*by)
    ranges.mapInArrow(kernel, ", ".join(["n int", *(f"{f} binary" for f in fields)])).write.parquet(path, compression="uncompressed")
    return path


def read_packed(path: str, fields: list[str]):
    """The pieces in the order of their keys, each its number of rows and the buffers of ``fields``; other fields aren't read."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as parquet

    fs, at = file_system(path)
    for name in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-")):
        with fs.open_input_file(name) as file:
            for rb in parquet.ParquetFile(file).iter_batches(batch_size=1, columns=["n", *fields]):
                yield rb.column("n")[0].as_py(), [rb.column(f)[0].as_buffer() for f in fields]


def column(path: str, field: str, kind: str) -> np.ndarray:
    """A field of all rows, (rows, numbers a row), filled piece by piece."""
    total, at, out = sum(n for n, _ in read_packed(path, [])), 0, np.zeros((0, 0), kind)
    for n, (piece,) in read_packed(path, [field]):
        part = np.frombuffer(piece, kind).reshape(n, -1)
        out = np.empty((total, part.shape[1]), kind) if at == 0 else out
        if part.shape[1] != out.shape[1]:
            raise ValueError(f"vector dimension mismatch: expected {out.shape[1]}, got {part.shape[1]}")
        out[at:at + n] = part
        at += n
    return out
