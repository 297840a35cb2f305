"""Binary files through Arrow's file systems, in bounded pieces, committed as a whole."""

import os

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from quiver.sources import binary


def _table(spark, n, d=3):
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: (F.col("id") * 10 + i).cast("float")).alias("embed"))


@pytest.mark.parametrize("suffix", [".fbin", ".fvecs", ".ibin", ".f16bin"])
def test_file_uris_and_many_files(spark, tmp_dir, monkeypatch, suffix):
    monkeypatch.setattr(binary, "FILE_BYTES", 320)  # the writers and readers are pickled with these
    monkeypatch.setattr(binary, "BATCH_BYTES", 64)
    out = f"file://{tmp_dir}/out"
    binary.write_vectors(_table(spark, 150), out, suffix, parts=3)
    names = sorted(os.listdir(f"{tmp_dir}/out"))
    assert len(names) > 6 and all(n.startswith("part-") and n.endswith(suffix) for n in names)
    for path in (out, f"{tmp_dir}/out", f"{out}/part-*{suffix}"):
        got = binary.read_vectors(spark, path, rows_per_partition=7).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(150))
        assert [list(r["embed"]) for r in got] == [[i * 10 + 1, i * 10 + 2, i * 10 + 3] for i in range(150)]
    assert binary.convert_to_table(spark, out, start_id=5).agg(F.min("id"), F.max("id")).first() == (5, 154)


def test_another_file_system(tmp_dir):
    fs = pafs.SubTreeFileSystem(tmp_dir, pafs.LocalFileSystem())
    X = np.arange(60, dtype=np.float32).reshape(20, 3)
    fs.create_dir("d")
    for name, part in (("d/b.fbin", X[12:]), ("d/a.fbin", X[:12]), ("d/.c.fbin", X), ("d/_d.fbin", X)):
        with fs.open_output_stream(name) as f:
            f.write(binary.encoded(part, ".fbin"))
    assert binary._expand(fs, "d") == ["d/a.fbin", "d/b.fbin"] and binary._expand(fs, "d/b*.fbin") == ["d/b.fbin"]
    assert binary.header("d/a.fbin", fs) == (12, 3, 12, 8)
    got = [m for _, m in binary.matrices(fs, "d/a.fbin", 2, 5)]
    assert np.array_equal(np.concatenate(got), X[2:7])
    with pytest.raises(FileNotFoundError):
        binary._expand(fs, "none")
    with pytest.raises(FileNotFoundError):
        binary.header("none.fbin", fs)


def test_overwrite_empty_and_failed_writes(spark, tmp_dir):
    out = f"{tmp_dir}/w"
    binary.write_vectors(_table(spark, 40), out, ".fbin", parts=8)
    binary.write_vectors(_table(spark, 9), out, ".fbin", parts=2)  # the earlier, more numerous parts are replaced
    assert binary.read_vectors(spark, out).count() == 9
    bad = _table(spark, 20).withColumn("embed", F.when(F.col("id") == 13, F.raise_error(F.lit("planted")).cast("array<float>")).otherwise(F.col("embed")))
    with pytest.raises(Exception, match="planted"):
        binary.write_vectors(bad, out, ".fbin", parts=4)
    assert not [n for n in os.listdir(out) if n.startswith(".")]
    assert binary.read_vectors(spark, out).count() == 9
    binary.write_vectors(_table(spark, 0), out, ".fbin", parts=2)
    assert binary.read_vectors(spark, out).count() == 0
