"""V8: vectors stored as fp16 or int8 codes, searched without losing a neighbour.

A code is a binary column: 2 bytes an element (``fp16``) or 1 (``int8``, ``uint8``: an affine code between the
table's least and greatest element, 255 steps). :class:`CodedIndex` is an exact index over such a table:

1. the kernel decodes a batch, takes distances to the decoded vectors, and knows for every row how far the
   stored vector may be from its code (``err``, its exact distance, one float a row): a row's true distance lies within a bound of
   the distance to its code. It keeps, per query and task, the rows whose lower bound is not over the k-th upper bound;
2. the tasks' candidates meet per query, and only those still inside the k-th upper bound are joined with the vectors and
   ranked by their true distance.

So the result is that of exact search, while the scan reads a half or a quarter of the bytes. Without the
vectors the ranking is by decoded vectors (as an index of that precision gives it).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.vector import INT8_RANGE, distance, resolve_metric
from quiver.operators.knn import DEFAULT_BROADCAST_BYTES, _collect_matrix, _conf_int, _vector_stats, rank_partials, spread
from quiver.operators.topk_kernel import COLUMNS, QUERIES, TILE_DOUBLES, Columns, exact, row_chunks, vectors_from_arrow, within
from quiver.session import scratch_dir

STEPS = 255
NAMES = {"fp16": "fp16", "float16": "fp16", "half": "fp16", "int8": "int8", "uint8": "uint8"}


@dataclass(frozen=True)
class Codec:
    """How elements are coded; ``low`` and ``step`` are of the affine kinds."""

    kind: str
    low: float = 0.0
    step: float = 0.0

    @classmethod
    def of(cls, df: DataFrame, qtype: str, vec_col: str = "embed") -> Codec:
        kind = NAMES.get(qtype.lower())
        if kind is None:
            raise ValueError(f"unknown code {qtype!r}")
        if kind == "fp16":
            return cls(kind)
        low, high = df.agg(F.min(F.array_min(vec_col)), F.max(F.array_max(vec_col))).first()  # two numbers
        low, high = float(low or 0.0), float(high or 0.0)
        return cls(kind, low, (high - low) / STEPS)

    def encode(self, X: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return X.astype("<f2")
        q = np.rint((X - self.low) / self.step) if self.step else np.zeros(X.shape)
        least = INT8_RANGE[0] if self.kind == "int8" else 0
        return (np.clip(q, 0, STEPS) + least).astype("i1" if self.kind == "int8" else "u1")

    def decode(self, raw: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return raw.view("<f2").astype(np.float64)
        least = INT8_RANGE[0] if self.kind == "int8" else 0
        return ((raw.view("i1" if self.kind == "int8" else "u1").astype(np.float64) - least) * self.step + self.low).astype(np.float32).astype(np.float64)

    def vectors(self, column) -> np.ndarray:
        """Decoded rows of a binary Arrow column."""
        n = len(column)
        if not n:
            return np.zeros((0, 0))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        if len(set(np.diff(ends).tolist())) > 1:
            raise ValueError("codes of different dimensions")
        return self.decode(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]).reshape(n, -1)


def encoded(df: DataFrame, codec: Codec, vec_col: str = "embed") -> DataFrame:
    """``df`` with ``code`` and ``err`` (the vector's distance from its decoded form) in place of ``vec_col``."""
    names = [c for c in df.columns if c != vec_col]
    at, others = df.columns.index(vec_col), [df.columns.index(c) for c in names]

    def kernel(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows:
                X = vectors_from_arrow(rb.column(at))
                C = codec.encode(X)
                back = codec.decode(C.view(np.uint8).ravel()).reshape(X.shape)
                err = np.sqrt(np.einsum("nd,nd->n", X - back, X - back))
                width = C.itemsize * X.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(X), [None, pa.py_buffer(np.arange(0, (len(X) + 1) * width, width, dtype=np.int32)), pa.py_buffer(C.tobytes())])
                yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in others), code, pa.array(err.astype(np.float32))], [*names, "code", "err"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return df.mapInArrow(kernel, fields + "code binary, err float")


def error_bound(metric: str, Q: np.ndarray, D: np.ndarray, X: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the true distances, from distances ``D`` to decoded rows ``X`` that are ``err`` off."""
    slack = err * (1 + 1e-5) + 1e-12
    if metric in ("l2", "l2sq"):
        root = D if metric == "l2" else np.sqrt(D)
        low, high = np.maximum(root * (1 - 1e-9) - slack, 0), root * (1 + 1e-9) + slack
        return (low, high) if metric == "l2" else (low * low, high * high)
    norm = np.sqrt(np.einsum("qd,qd->q", Q, Q))[:, None]
    if metric == "ip":
        off = norm * slack + 1e-9 * np.abs(D)
    else:  # the angle's cosine moves by at most 2 err / |x|
        size = np.sqrt(np.einsum("nd,nd->n", X, X))
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.broadcast_to(np.where(size > slack, 2 * slack / size, 2.0) + 1e-9, D.shape)
    D = np.where(np.isfinite(D), D, 0 if metric == "cosine" else D)
    return D - off, np.where(off >= 2, np.inf, D + off) if metric == "cosine" else D + off


def _reach(metric: str, qn: np.ndarray, kth: np.ndarray, block: Columns, slack: float) -> np.ndarray:
    """Per query, what the distance (squared for l2) to a decoded row of the block is not over if its lower bound is within ``kth``."""
    if metric in ("l2", "l2sq"):
        root = (np.sqrt(kth) if metric == "l2sq" else kth) + slack
        return root * root * (1 + 1e-8)
    if metric == "ip":
        return kth + qn * slack + 2e-9 * qn * block.far
    return kth + slack


def _slack(metric: str, X: np.ndarray, err: np.ndarray) -> float:
    """The most that :func:`error_bound` allows a row of the block (for ip: per unit of the query's length)."""
    slack = err * (1 + 1e-5) + 1e-12
    if metric != "cosine":
        return float(slack.max())
    size = np.sqrt(np.einsum("nd,nd->n", X, X))
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.max(np.where(size > slack, 2 * slack / size, 2.0))) + 1e-8


def _inside(metric: str, Q: np.ndarray, blocks: list[tuple[int, Columns]], err: np.ndarray, k: int, exactly: bool) -> tuple[np.ndarray, ...]:
    """(query row, row position, distance, lower, upper bound) of the rows whose lower bound is not over the k-th upper bound.

    A matrix product leaves out the rows that are surely over it; distances are taken of the others only.
    """
    qn = np.sqrt(np.einsum("qd,qd->q", Q, Q))
    kth, found = np.full((len(Q), k), np.inf), []
    for a, block in blocks:
        own = err[a : a + len(block.X)]
        slack = _slack(metric, block.X, own) if exactly else 0.0
        D, base, bound = block.distances(Q, qn)
        if metric == "cosine" and exactly:
            D[np.isinf(D)] = -1.0  # no angle: bounded as distance 0
        limit = _reach(metric, qn, kth[:, -1], block, slack) + 2 * bound - base
        free = np.isinf(kth[:, -1])
        if free.any() and D.shape[1] >= k:
            near = np.partition(D[free], k - 1, axis=1)[:, k - 1] + base[free] + bound[free]
            if metric in ("l2", "l2sq"):
                high = np.sqrt(np.maximum(near, 0)) * (1 + 1e-8) + slack
            elif metric == "ip":
                high = near + qn[free] * slack + 2e-9 * qn[free] * block.far
            else:
                high = near + slack if slack < 2 else np.full(len(near), np.inf)
            limit[free] = _reach(metric, qn[free], high * high if metric == "l2sq" else high, block, slack) + 2 * bound[free] - base[free]
        r, c = within(D, limit)
        step, parts = max(1, TILE_DOUBLES // max(1, 4 * Q.shape[1])), []
        for p in range(0, len(r), step):
            i, j = r[p : p + step], c[p : p + step]
            d = exact(metric, Q[i], block.X[j][:, None, :])
            low, high = _pair_bounds(metric, Q[i], d, block.X[j], own[j]) if exactly else (d, d)
            parts.append((d[:, 0], low[:, 0], high[:, 0]))
        if not parts:
            continue
        d, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        high = np.where(np.isnan(high), np.inf, high)
        order = np.lexsort((high, r))
        place = np.arange(len(r)) - np.searchsorted(r, r)  # of the sorted pairs: r ascends
        best = place < k
        new = np.full((len(Q), k), np.inf)
        new[r[order][best], place[best]] = high[order][best]
        kth = np.sort(np.concatenate([kth, new], axis=1), axis=1)[:, :k]
        keep = low <= kth[r, -1]
        found.append((r[keep], c[keep] + a, d[keep], low[keep], high[keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3
    r, c, d, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = low <= kth[r, -1]
    return r[keep], c[keep], d[keep], low[keep], high[keep]


def _pair_bounds(metric: str, Q: np.ndarray, d: np.ndarray, X: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`error_bound` of pairs: row i of ``Q`` with row i of ``X``, ``d`` as a column."""
    if metric == "cosine":  # the bound hangs on the row
        low, high = error_bound(metric, Q[:1], d.T, X, err)
        return low.T, np.broadcast_to(high, d.T.shape).T
    return error_bound(metric, Q, d, X, err[:, None])


@dataclass
class CodedIndex:
    """Exact search over codes; ``codes(id, code, err, attributes)`` and, where kept, ``vectors(id, embed)``."""

    codes: DataFrame
    vectors: DataFrame | None
    codec: Codec
    metric: str = "l2"

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None, qvec_col: str = "embed",
               broadcast_bytes: int | None = None) -> DataFrame:
        """``(qid, id, d, rk)``, with ``flag`` also ``ok``; queries must fit the broadcast budget."""
        m, spark, codec = resolve_metric(self.metric), queries.sparkSession, self.codec
        q = queries.select(F.col("qid").cast("long"), F.col(qvec_col).alias("v"))
        nq, dim = _vector_stats(q, "v")
        budget = broadcast_bytes or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
        if nq * (dim * 4 + k * 24) > budget:
            half = [q.where(F.pmod(F.xxhash64("qid"), F.lit(2)) == b).withColumnRenamed("v", "embed") for b in (0, 1)]
            if nq < 2:
                raise ValueError("a query vector over the broadcast budget")
            parts = [self.search(h.select("qid", F.col("embed")), k, where, flag, "embed", max(budget, nq * (dim * 4 + k * 24) * 2 // 3)) for h in half]
            return parts[0].unionByName(parts[1])
        qids, Q, _ = _collect_matrix(q, "qid", "v")
        if len(np.unique(qids)) < len(qids):
            raise ValueError("query ids repeat")
        bc, exactly = spark.sparkContext.broadcast((qids, Q)), self.vectors is not None

        def kernel(batches):
            import pyarrow as pa

            qids_, Q_ = bc.value
            for t in row_chunks(batches, Q_.shape[1]):
                ids, err = t.column(0).to_numpy(), t.column(2).to_numpy().astype(np.float64)
                blocks = [(a, Columns(m, codec.vectors(t.column(1).slice(a, COLUMNS).combine_chunks()))) for a in range(0, len(ids), COLUMNS)]
                held = []
                for q0 in range(0, len(Q_), QUERIES):
                    held.append(_inside(m, Q_[q0 : q0 + QUERIES].astype(np.float64), blocks, err, k, exactly))
                    held[-1][0][:] += q0
                    if len(held) == 64 or q0 + QUERIES >= len(Q_):
                        row, col, d, low, up = (np.concatenate(x) for x in zip(*held, strict=True))
                        held = []
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qids_[row], pa.int64()), pa.array(ids[col], pa.int64()), pa.array(d, pa.float64(), mask=~np.isfinite(d)),
                             pa.array(low, pa.float64()), pa.array(up, pa.float64())], ["qid", "id", "d", "low", "high"])

        rows = self.codes if where is None else self.codes.where(where)
        found = spread(rows.select(F.col("id").cast("long"), "code", "err")).mapInArrow(kernel, "qid long, id long, d double, low double, high double")
        if exactly:
            path = scratch_dir(spark, "candidates")
            found.write.parquet(path)
            found = spark.read.parquet(path)
            w = Window.partitionBy("qid").orderBy("high")
            kth = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("qid").agg(
                F.when(F.count(F.lit(1)) >= k, F.max("high")).otherwise(F.lit(float("inf"))).alias("kth"))
            inside = found.join(kth, "qid").where(F.col("low") <= F.col("kth")).select("qid", "id")
            near = inside.join(self.vectors.select("id", F.col("embed").alias("x")), "id").join(q, "qid")
            found = near.select("qid", "id", distance(m, "v", "x").alias("d"))
        out = rank_partials(found.select("qid", "id", "d"), k).select("qid", "id", "d", "rk")
        if flag is None or where is not None:
            return out
        return out.join(self.codes.select("id", F.coalesce(flag, F.lit(False)).alias("ok")), "id").select("qid", "id", "d", "rk", "ok")


def build_coded(table: DataFrame, qtype: str, metric: str = "l2", *, keep_vectors: bool = True, path: str | None = None, vec_col: str = "embed") -> CodedIndex:
    """Codes of ``table(id, <vec_col>, attributes)``, written, and its vectors unless ``keep_vectors`` is off."""
    from quiver.operators.ivf import _write_text

    spark, m = table.sparkSession, resolve_metric(metric)
    base = (path or scratch_dir(spark, "codes")).rstrip("/")
    codec = Codec.of(table, qtype, vec_col)
    encoded(table, codec, vec_col).write.mode("overwrite").parquet(f"{base}/codes")
    if keep_vectors:
        table.select("id", F.col(vec_col).alias("embed")).write.mode("overwrite").parquet(f"{base}/vectors")
    _write_text(spark, f"{base}/meta.json", json.dumps({"type": "codes", "metric": m, "kind": codec.kind, "low": codec.low, "step": codec.step, "vectors": keep_vectors}))
    return load_coded(spark, base)


def load_coded(spark, path: str) -> CodedIndex:
    from quiver.operators.ivf import _read_text

    p = path.rstrip("/")
    meta = json.loads(_read_text(spark, f"{p}/meta.json"))
    vectors = spark.read.parquet(f"{p}/vectors") if meta["vectors"] else None
    return CodedIndex(spark.read.parquet(f"{p}/codes"), vectors, Codec(meta["kind"], meta["low"], meta["step"]), meta["metric"])
