"""Operator 2: quality scores from random Fourier features, ridge regression and isotonic calibration.

1. *Statistics.* One pass over the whole texts turns each document into the
   ``FEATURES`` below, computed for an Arrow batch at a time from its bytes.
2. *Features.* Standardised statistics x become ``sqrt(2 / D) cos(W x + b)`` with W normal
   of width ``GAMMA`` and a fixed seed, whose inner products approximate a
   Gaussian kernel.
3. *Ridge.* Each partition of labelled rows sums its normal equations (D + 1 squared numbers);
   the sums are added in groups and the at most ``MERGE`` group sums reach the
   driver, which solves them. All labelled rows take part, none is sampled.
4. *Calibration.* On a fold that the ridge did not see, raw scores are counted in
   ``BINS`` fixed bins; pooled adjacent violators make the bin means monotone, and a
   score is read off by interpolation.

Only labels with crc32(doc_id) mod 5 <> 0 are learnt from: 1 calibrates, 2 to 4 fit.
Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have all-zero statistics and get that point's
score; without any labelled row of both classes every score is ``0.5``; rows with a null ``doc_id`` are scored (not held out); repeated
rows are scored alike; a null quality is no label; a label row counts once per document row that has its id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import textkernel as K
from quiver.llm.batches import bound_batches
from quiver.session import scratch_dir

D = 256
GAMMA = 0.35
RIDGE = 1.0
SEED = 20
FIT_ROWS = 200_000  # labelled rows per partition of the normal equations, on average
MERGE = 32
BINS = 2_000
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "newline": (10,),
    "stop": b".,;:", "shout": b"!?", "pipe": b"|", "mark": b"#*$%&<>", "other": b"\"'()-/+=@[]\\^_`{}~", "beyond": range(0xC0, 0x100),
}
FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "distinct_triples", "distinct_lines", "longest_word", *_CLASSES)
_CLASS = np.full(256, len(_CLASSES), np.int64)  # the last: control and continuation bytes
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each row (rows are consecutive; first has n_rows + 1 entries)."""
    out = np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(values[a:b])
            out[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    return out


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of FEATURES for a text buffer."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(row * (len(_CLASSES) + 1) + _CLASS[raw], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    chars = np.bincount(row[(raw & 0xC0) != 0x80], minlength=n)
    starts, ends, first = K.word_spans(raw, offsets)
    words = K.word_hashes(raw, starts, ends)
    n_words = np.diff(first)
    triples = K.window_hashes(words, 3)
    last = np.maximum(first[1:] - 2, first[:-1])  # a window must end in its own document
    each = np.zeros(n)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), last.tolist(), strict=True)):
        each[i] = len(np.unique(triples[a:b])) / (b - a) if b > a else 1.0
    breaks = np.flatnonzero(raw == 10)
    line_first = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_first = line_first[line_first < len(raw)]
    line_hash = K.word_hashes(raw, line_first, np.append(line_first[1:], len(raw))) if len(line_first) else np.zeros(0, np.uint64)
    line_at = np.searchsorted(line_first, offsets)
    lengths = np.zeros(n)
    filled = np.flatnonzero(n_words)
    if len(filled):
        lengths[filled] = np.maximum.reduceat(ends - starts, first[filled])
    safe = lambda x: np.maximum(x, 1)
    out = np.column_stack([
        np.log1p(chars), np.log1p(n_words), (chars - count[:, 3] - count[:, 4]) / safe(n_words), _distinct(words, first) / safe(n_words), each,
        _distinct(line_hash, line_at) / safe(np.diff(line_at)), np.log1p(lengths), np.sqrt(count[:, : len(_CLASSES)] / safe(chars)[:, None])])
    out[chars == 0] = 0.0
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row."""

    def run(batches):
        for batch in batches:
            raw, offsets = K.text_buffer(batch.column(1))
            for lo, hi in K.pieces(offsets):
                part = offsets[lo : hi + 1]
                x = statistics(raw[part[0] : part[-1]], part - part[0])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Model:
    """Standardisation, random features, ridge weights and the calibration curve; a few hundred numbers."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, GAMMA, (len(mean), D)), rng.uniform(0, 2 * math.pi, D)
        self.beta = np.zeros(D + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * math.sqrt(2 / D), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def pooled(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y / n on sorted x: block centres and their means (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for xi, ni, yi in zip(x, n, y, strict=True):
        blocks.append([xi * ni, ni, yi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled rows of ``stats(doc_id, x)`` outside fold 0; None without both classes."""
    width = len(FEATURES)
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    path = scratch_dir(spark, "labelled")
    stats.join(known, "doc_id").withColumn("fold", fold()).where("fold <> 0").write.parquet(path)
    rows = spark.read.parquet(path)
    fits = rows.where("fold > 1")
    sums = [f(F.get("x", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop)]
    n, low, high, *moments = fits.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *sums).first()
    if not n or low == high:
        return None
    moments = np.array(moments, float).reshape(-1, 2)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6))

    def normal(batches):
        total = np.zeros((D + 1, D + 2))
        for batch in batches:
            x, y = _matrix(batch.column("x"), width), batch.column("y").to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                phi = model.features(x[at : at + 4096])
                total += phi.T @ np.column_stack([phi, y[at : at + 4096]])
        if total[D, D]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("s"))
        return pa.table({"s": pa.array([total.tobytes()], pa.binary())})

    parts = -(-n // FIT_ROWS)
    dealt = fits.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "y")
    sums = dealt.mapInArrow(normal, "s binary").withColumn("g", F.spark_partition_id() % MERGE)
    total = sum(np.frombuffer(r["s"]) for r in sums.groupBy("g").applyInArrow(lambda t: add(t.select(["s"])), "s binary").collect())
    total = total.reshape(D + 1, D + 2)
    penalty = np.diag([RIDGE] * D + [0.0])
    model.beta = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def raw(batches):
        for batch in batches:
            r = np.clip(model.raw(_matrix(batch.column("x"), width)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((r + 1) / 3 * BINS).astype(np.int64)), batch.column("y")], ["bin", "y"])

    held = rows.where("fold = 1")
    held = held if not held.isEmpty() else fits
    bins = held.select("x", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("y"))
    bins = sorted(tuple(r) for r in bins.collect())  # BINS + 1 rows at most
    at, n, y = np.array(bins, float).T
    model.curve = pooled(at / BINS * 3 - 1, n, y)
    return model


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``."""
    bound_batches(spark)
    path = scratch_dir(spark, "statistics")
    document_statistics(docs).write.parquet(path)
    stats = spark.read.parquet(path)
    model = fit(spark, stats, labels)

    def score(batches):
        for batch in batches:
            x = _matrix(batch.column(1), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; a pass over the texts fits, another one filters."""
    bound_batches(spark)
    path = scratch_dir(spark, "statistics")
    document_statistics(docs).write.parquet(path)
    model = fit(spark, spark.read.parquet(path), labels)
    if model is None:
        return docs

    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            raw, offsets = K.text_buffer(batch.column(at))
            for lo, hi in K.pieces(offsets):
                part = offsets[lo : hi + 1]
                good = model.score(statistics(raw[part[0] : part[-1]], part - part[0])) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learnt from ``labels``."""
    return quality_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
