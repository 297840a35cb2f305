"""Operator 12: embedding whitening by incremental eigendecomposition.

1. Each partition keeps the mean and the eigendecomposition of the scatter of the rows it has seen and adds a row
   as a centred rank-one update: z is the row's difference from the mean in the eigenbasis, entries of z that
   don't matter and equal eigenvalues are deflated, the other eigenvalues are the roots of the secular equation
   ``1 + rho * sum(z_i^2 / (d_i - t)) = 0``, and the eigenvectors follow from z recomputed from those roots,
   which keeps them orthogonal.
2. Spectra are combined ``MERGE`` at a time, level by level: each eigenpair of the one is a rank-one update of the other,
   and so is the difference of the means.
3. Rayleigh-Ritz: a second pass sums the covariance in the basis found, which is a small matrix per partition
   summed up in levels as well; its eigenvectors turn the basis into eigenvectors to double precision.
4. A third pass projects every row; a fourth one measures the covariance of what was written.

What moves is a (d x d) matrix per partition and level, ``MERGE`` of them in a task at most; the basis
(d x d) is sent to the tasks with the code. No row is shuffled. A row costs a step of O(d^2) numbers and a product of (d x d) matrices.
Numbers of rows and sums of integers are kept apart from the spectra, as exact integers.

Defined results: a row whose vector is null, is empty or holds a null or non-finite entry is left out, and so is one whose
length is not the most frequent one (the greater of equally frequent ones); a null or repeated ``vec_id`` and repeated
rows stay, each a row of its own; other columns are ignored; an empty table gives no rows. Components whose eigenvalue is
at most ``NULL_SPACE`` of the trace can't be whitened and give no rows, so copies of one vector alone give none. Equal eigenvalues have
some orthonormal basis of their space. ``deviation`` is null where it would exceed a long. Entries are scaled as doubles;
one beyond 2^52 / 1024 can't be told from its neighbours and makes the integers inexact.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_dir

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MERGE = 16  # spectra that meet in a task
NULL_SPACE = 1e-12  # of the trace
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + rho * sum(z2 / (d - t))`` for rising ``d``, as (index of the nearest pole, distance from it)."""
    k = len(d)
    top = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = top - d
    mid = gap / 2
    at_mid = 1 + rho * (z2 / ((d - d[:, None]) - mid[:, None])).sum(1)
    near = np.where((at_mid >= 0) | (np.arange(k) == k - 1), np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[near][:, None]  # row i: the poles as seen from root i's origin
    low = np.where(near == np.arange(k), np.where(at_mid >= 0, 0.0, mid), -mid)
    high = np.where(near == np.arange(k), np.where(at_mid >= 0, mid, gap), 0.0)
    left, right = d - d[near], top - d[near]
    below = np.arange(k) <= np.arange(k)[:, None]
    t = (low + high) / 2
    live = np.ones(k, bool)
    for _ in range(80):
        diff = delta - t[:, None]
        part = rho * z2 / diff
        f = 1 + part.sum(1)
        slope = part / diff
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        error = EPS * k * (1 + np.abs(part).sum(1))
        live &= (np.abs(f) > error) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not live.any():
            break
        a, b = left - t, right - t
        whole = slope.sum(1)
        under = np.where(below, slope, 0).sum(1)
        c = f - a * under - b * (whole - under)  # the two nearest poles interpolate f, each with its own side's slope
        p, q = (a + b) * f - a * b * whole, a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        after = t + step
        inside = np.isfinite(after) & (after > low) & (after < high)
        t = np.where(live, np.where(inside, after, (low + high) / 2), t)
    return near, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigendecomposition of ``vectors @ diag(values) @ vectors.T + rho * outer(v, v)`` for rho > 0; values rise."""
    size = np.linalg.norm(v)
    if not size or not rho:
        return values, vectors
    z = vectors.T @ (v / size)
    rho = rho * size * size
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    used = rho * np.abs(z) > small
    d = values.copy()
    vectors = vectors.copy()
    last = -1
    for i in np.flatnonzero(used):  # equal eigenvalues: a rotation leaves one of them without a part in z
        if last >= 0 and d[i] - d[last] <= small:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            z[last], z[i] = 0.0, r
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            used[last] = False
        last = i
    keep = np.flatnonzero(used)
    if len(keep) == 1:
        d[keep] += rho * z[keep] ** 2
    elif len(keep):
        dk, zk = d[keep], z[keep]
        near, t = secular_roots(dk, zk * zk, rho)
        diff = (dk - dk[near][:, None]) - t[:, None]  # row i: d_j - root i
        spread = dk[:, None] - dk
        np.fill_diagonal(spread, 1.0)
        # |z| as it would have to be for these roots to be exact.
        exact = np.exp((np.log(np.abs(diff)).sum(0) - np.log(np.abs(spread)).sum(0)) / 2) * np.sign(zk)
        w = (exact / diff).T
        w /= np.linalg.norm(w, axis=0)
        vectors[:, keep] = vectors[:, keep] @ w
        d[keep] = dk[near] + t
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


class Spectrum:
    """Mean, number of rows and eigendecomposition of their scatter, with exact integer sums beside them."""

    def __init__(self, dim: int):
        self.n, self.mean, self.sums = 0, np.zeros(dim), np.zeros(dim, object)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        for row in x:
            off = row - self.mean
            if self.n:
                self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n or not other.n:
            if other.n:
                self.__dict__.update(other.__dict__)
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def packed(self) -> dict:
        floats = np.concatenate([self.mean, self.values, self.vectors.ravel()])
        return {"n": self.n, "sums": ",".join(map(str, self.sums)), "state": floats.tobytes()}

    @classmethod
    def unpacked(cls, n: int, sums: str, state: bytes) -> Spectrum:
        sums = np.array([int(s) for s in sums.split(",")], object)
        out, k = cls(len(sums)), len(sums)
        floats = np.frombuffer(state)
        out.n, out.sums, out.mean, out.values, out.vectors = n, sums, floats[:k], floats[k : 2 * k], floats[2 * k :].reshape(k, k)
        return out


SPECTRUM = "n long, sums string, state binary"
TOTAL = "state binary"


def _table(rows: list[dict], names: list[str]) -> pa.Table:
    kinds = {"n": pa.int64(), "sums": pa.string(), "state": pa.binary()}
    return pa.table({c: pa.array([r[c] for r in rows], kinds[c]) for c in names})


def merged_spectra(table: pa.Table) -> pa.Table:
    spectra = [Spectrum.unpacked(*(r[c] for c in ("n", "sums", "state"))) for r in table.to_pylist()]
    first = spectra[0]
    for other in spectra[1:]:
        first.merge(other)
    return _table([first.packed()], ["n", "sums", "state"])


def added(table: pa.Table) -> pa.Table:
    return _table([{"state": functools.reduce(np.add, (np.frombuffer(s.as_py()) for s in table.column("state"))).tobytes()}], ["state"])


def in_levels(spark: SparkSession, partials: DataFrame, schema: str, combine) -> dict | None:
    """The one row that ``combine`` leaves of ``partials`` (one a partition at most), ``MERGE`` rows at a time; each level is written."""
    path, names = scratch_dir(spark, "levels"), schema.replace(",", " ").split()[::2]
    level, partials = 0, partials.withColumn("part", F.spark_partition_id())
    while True:
        partials.write.parquet(f"{path}/{level}")
        laid = spark.read.schema(f"{schema}, part int").parquet(f"{path}/{level}")
        if laid.count() <= 1:
            return laid.first()

        def one(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py() // MERGE
            return combine(table.sort_by("part").select(names)).append_column("part", pa.array([part], pa.int32()))

        partials = laid.groupBy(F.expr(f"part div {MERGE}")).applyInArrow(one, f"{schema}, part int")
        level += 1


def lattice(spark: SparkSession, rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, x)`` of the rows that are fit for use, written: ``x = floor(1024 * c) + 100000`` as longs."""
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < 2.0**52))  # NaN is above every number
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    path = scratch_dir(spark, "lattice")
    kept = rows.select(rows[key].alias("key"), rows[vector].cast("array<double>").alias("v")).where((F.size("v") > 0) & good)
    kept.select("key", x.alias("x")).write.parquet(path)
    laid = spark.read.parquet(path)
    dim = laid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return laid if dim is None else laid.where(F.size("x") == dim["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Whitening:
    """What ``fit`` finds: number of rows, exact sums, and the first eigenvalues and eigenvectors (columns) of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The whitened rows and their deviations."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(abs(s) for s in self.sums)
        far = x * self.n - self.sums.astype(np.int64) if most < 2**62 else x.astype(object) * self.n - self.sums
        wide = far if most * most * x.shape[1] < 2**63 else far.astype(object)
        deviation = [int(v) if v < 2**63 else None for v in (wide * wide).sum(1)]
        return (far.astype(float) / self.n) @ self.vectors / np.sqrt(self.values), deviation


def fit(spark: SparkSession, laid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``laid(key, x)``; None for no rows."""

    def spectra(batches):
        spectrum = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                spectrum = spectrum or Spectrum(x.shape[1])
                spectrum.add(x.astype(float))
                spectrum.sums = spectrum.sums + (x.sum(0).astype(object) if np.abs(x).max() < 2**40 else x.astype(object).sum(0))
        if spectrum:
            yield pa.RecordBatch.from_pylist([spectrum.packed()], pa.schema([("n", pa.int64()), ("sums", pa.string()), ("state", pa.binary())]))

    packed = in_levels(spark, laid.select("x").mapInArrow(spectra, SPECTRUM), SPECTRUM, merged_spectra)
    if packed is None:
        return None
    found = Spectrum.unpacked(*packed[:3])
    basis, n, sums = found.vectors[:, ::-1], found.n, found.sums
    mean = np.array([s / n for s in sums], float)
    dim = len(mean)

    def projected(batches):
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            y = (_matrix(batch.column("x")) - mean) @ basis if batch.num_rows else np.zeros((0, dim))
            total[:dim] += y.T @ y
            total[dim] += y.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    total = np.frombuffer(in_levels(spark, laid.select("x").mapInArrow(projected, TOTAL), TOTAL, added)["state"]).reshape(dim + 1, dim)
    ritz = total[:dim] / n - np.outer(total[dim] / n, total[dim] / n)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn, trace = values[::-1], turn[:, ::-1], float(np.trace(ritz))
    good = values[:components] > NULL_SPACE * trace
    return Whitening(n, sums, values[:components][good], (basis @ turn)[:, :components][:, good], trace)


def whiten(spark: SparkSession, rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for every row fit for use and component."""
    laid = lattice(spark, rows, vector, key)
    model = fit(spark, laid, components)
    kind = laid.schema["key"].dataType.simpleString()
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                w, deviation = model.whitened(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["key", "deviation", "w"])

    path, k = scratch_dir(spark, "whitened"), len(model.values)
    laid.mapInArrow(project, f"key {kind}, deviation long, w array<double>").write.parquet(path)
    out = spark.read.parquet(path)

    def spread(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column("w"))
                total[:k] += w.T @ w
                total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    total = np.frombuffer(in_levels(spark, out.select("w").mapInArrow(spread, TOTAL), TOTAL, added)["state"]).reshape(k + 1, k) / model.n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = out.select(F.col("key").alias(key), "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(F.col(key), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, eight components."""
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
