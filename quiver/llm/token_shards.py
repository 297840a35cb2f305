"""Operator 8: training-order token shards.

Documents are tokenised with a public vocabulary and joined, each followed by the
end-of-text id, in the order of (doc_id, text hash); the stream is cut into sequences of
``length`` ids. A keyed Feistel network with cycle-walking permutes ``[0, n)``: it gives every
sequence its slot in training order without a table or a shuffle of slots. Ranges
of ``per_shard`` slots are files of fixed stride (``length`` ids of 2 or 4 bytes, little-endian), so slot s
stands at byte ``s % per_shard * stride`` of shard ``s // per_shard``, and a reader resumes anywhere.

Two passes over the texts: the first counts ids, and running sums over the
narrow counts place each document in the stream; the second tokenises again and sends
each sequence's pieces (compressed) to the task of its shard. That writes less than
storing the ids between the passes, and a lost executor costs only its own tasks. A shard is
written under a temporary name and moved; its content depends on
the input and the key alone, so a repeated task changes nothing. Files are written
through Arrow's file systems (``file:``, ``hdfs:``, ``s3:``); a shard is all that a task holds.
The passes must see the same rows in the same partitions, as scans of files do; the ids
written are counted against the first pass and a difference raises.

Defined results: null and empty texts are an end-of-text id alone; a null ``doc_id`` comes first and is
carried as null; repeated rows all stay; the last sequence is padded with the end-of-text id; an empty
table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.batches import bound_batches
from quiver.llm.ordered import running_sum
from quiver.llm.textkernel import mix
from quiver.session import scratch_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_ID = 50256  # free in that vocabulary
LENGTH = 2048
PER_SHARD = 1024
KEY = 0x5EED
ROUNDS = 6
BROADCAST_ROWS = 1_000_000
COUNT_ROWS = 500_000

# Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# The same without its look-ahead, which only matters in runs of white space; a third faster.
PATTERN_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUN = re.compile(r"\s\s")


def encodings(path: str) -> tuple:
    """The vocabulary with each pattern; a worker process loads it once (kept on the library's module, as this one may be shipped by value)."""
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_loaded_for_shards", {})
    if path not in loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        loaded[path] = tuple(tiktoken.Encoding("shards", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, PATTERN_SINGLE))
    return loaded[path]


def encode(both: tuple, text: str | None) -> list[int]:
    """The vocabulary's ids of a text."""
    return both[0 if _RUN.search(text) else 1].encode_ordinary(text) if text else []


class Feistel:
    """A keyed permutation of ``[0, n)``: a balanced Feistel network on the next even power of two, walked until it lands inside."""

    def __init__(self, n: int, key: int = KEY):
        self.n, self.half = n, max(1, math.ceil(math.log2(max(n, 2)) / 2))
        self.keys = [(key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1 for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ np.uint64(k)) & low)
        return (right << h) | left  # the halves swapped back, so that the reversed keys invert

    def _walk(self, x, keys) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        y = self._once(x, keys)
        while (out := y >= np.uint64(self.n)).any():
            y[out] = self._once(y[out], keys)
        return y.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(path: str, name: str, data) -> None:
    fs, base = file_system(path)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{base}/{name}")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))


def write_shards(
    spark: SparkSession, docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str = TOKENIZER
) -> DataFrame:
    """Write the shards of ``docs(doc_id, text)`` and ``manifest.json`` to ``path``; one row per sequence:

    ``(slot, sequence, shard, offset, n_tokens, doc_ids, sha256)``, ``offset`` in bytes, ``n_tokens`` without padding, the digest of the whole stride.
    """
    bound_batches(spark)
    size = 2 if END_ID < 1 << 16 else 4
    dtype, kind = np.dtype(f"<u{size}"), "H" if size == 2 else "I"

    def count(batches):
        both = encodings(tokenizer)
        for batch in batches:
            n = [len(encode(both, t)) + 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "digest", "row", "n"])

    counts = scratch_dir(spark, "counts")
    rows = _rows(docs).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    rows.mapInArrow(count, "doc_id long, digest string, row long, n long").write.parquet(counts)
    counted = spark.read.parquet(counts)
    n_docs, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = -(-total // length)
    _put(path, "manifest.json", json.dumps({"length": length, "id_bytes": size, "per_shard": per_shard, "sequences": n, "ids": total, "pad": END_ID, "key": key}).encode())
    places = running_sum(spark, counted, ["doc_id", "digest", "row"], "n", -(-n_docs // COUNT_ROWS)).select("row", "n", "before")

    def cut(batches):
        both, order, codec = encodings(tokenizer), Feistel(n, key), pa.Codec("zstd")
        for batch in batches:
            doc, at, seq, ids, left = [], [], [], [], []
            for d, text, expected, pos in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = encode(both, text)
                own.append(END_ID)
                if len(own) != expected:
                    raise RuntimeError("the second pass saw other rows than the first; write docs to files first")
                raw = memoryview(array(kind, own).tobytes())
                start = 0
                while start < len(own):
                    take = min(length - (pos + start) % length, len(own) - start)
                    doc.append(d)
                    at.append((pos + start) % length)
                    seq.append((pos + start) // length)
                    left.append(take)
                    ids.append(codec.compress(raw[start * size : (start + take) * size], asbytes=True))
                    start += take
            slots = order.slot(np.array(seq, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // per_shard), pa.array(slots), pa.array(at, pa.int64()), pa.array(left, pa.int64()), pa.array(doc, pa.int64()), pa.array(ids, pa.binary())],
                ["shard", "slot", "at", "n", "doc_id", "ids"])

    def store(table: pa.Table) -> pa.Table:
        table = table.sort_by([("slot", "ascending"), ("at", "ascending")])
        shard, codec = table.column("shard")[0].as_py(), pa.Codec("zstd")
        first = shard * per_shard
        held = np.full((min(per_shard, n - first), length), END_ID, dtype)
        slot, at, left = (table.column(c).to_numpy() for c in ("slot", "at", "n"))
        docs_of: dict[int, list] = {}
        tokens = np.zeros(len(held), np.int64)
        pieces = zip(slot.tolist(), at.tolist(), left.tolist(), table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True)
        for s, a, count, d, packed in pieces:
            held[s - first, a : a + count] = np.frombuffer(codec.decompress(packed, count * size, asbytes=True), dtype)
            tokens[s - first] += count
            docs_of.setdefault(s - first, []).append(d)
        _put(path, f"shard-{shard:08d}.bin", held.tobytes())
        slots = np.arange(first, first + len(held))
        return pa.table({
            "slot": pa.array(slots), "sequence": pa.array(Feistel(n, key).sequence(slots)), "shard": pa.array(np.full(len(held), shard)),
            "offset": pa.array((slots - first) * length * size), "n_tokens": pa.array(tokens),
            "doc_ids": pa.array([docs_of.get(k, []) for k in range(len(held))], pa.list_(pa.int64())),
            "sha256": pa.array([hashlib.sha256(row.tobytes()).hexdigest() for row in held], pa.string()),
        })

    placed = _rows(docs).join(F.broadcast(places) if n_docs <= BROADCAST_ROWS else places, "row")
    pieces = placed.select("doc_id", "text", "n", "before").mapInArrow(cut, "shard long, slot long, at long, n long, doc_id long, ids binary")
    schema = "slot long, sequence long, shard long, offset long, n_tokens long, doc_ids array<long>, sha256 string"
    report = scratch_dir(spark, "sequences")
    pieces.groupBy("shard").applyInArrow(store, schema).write.parquet(report)
    out = spark.read.schema(schema).parquet(report)
    written = out.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if written != total:
        raise RuntimeError(f"{written} ids written, {total} counted: the passes saw other rows; write docs to files first")
    return out


def manifest(path: str) -> dict:
    fs, base = file_system(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_slots(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """``(slot, ids)`` in training order from any slot on; one sequence in memory."""
    m = manifest(path)
    fs, base = file_system(path)
    stride, at, stop = m["length"] * m["id_bytes"], start, m["sequences"] if stop is None else min(stop, m["sequences"])
    while at < stop:
        shard = at // m["per_shard"]
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(at % m["per_shard"] * stride)
            while at < stop and at // m["per_shard"] == shard:
                yield at, np.frombuffer(f.read(stride), f"<u{m['id_bytes']}")
                at += 1


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, sharded into the checkpoint folder."""
    return write_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark, "shards"))
