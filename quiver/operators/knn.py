"""K1-K8: exact nearest-neighbour search for whole query sets.

Plans (``distribution``):

* ``sharded`` (default; ``single`` is served by the same plan): the query set is
  broadcast after a size check, each corpus partition is a shard, an Arrow
  kernel keeps a partial top-k per query per partition, and a
  ``row_number() <= k`` window over ``qid`` merges the partials (Spark adds a
  partial WindowGroupLimit before the shuffle), so the shuffle is tasks x
  queries x k rows, whatever the vectors' width. Splits of the corpus
  (``spark.sql.files.maxPartitionBytes``) set the number of tasks. A corpus of many
  files is searched in two levels: one task in every ``quiver.knn.pilotStride`` gives each
  query a bound on its k-th distance, and the scan's tasks send only rows within it, about
  stride x queries x k rows however many tasks there are.
* ``sharded`` over query blocks: a query set up to ``maxScanBlocks`` times
  the budget is split by hash into blocks, each broadcast (size-checked) to
  its own kernel scan of the corpus; the corpus is read once per block and
  never shuffled.
* ``grid``: used automatically when the query set is larger still. Queries
  and corpus rows are hash-blocked; each (query block, corpus block) cell is a
  bounded cogroup handled by the same kernel. Nothing passes through the
  driver.
* ``replicated``: the corpus is broadcast (size-checked) and the query set is
  partitioned; each task returns final ranks, no shuffle at all.

Result: ``(qid long, id long, d double, rk int)``; ``d`` is the metric's
ranking key (``-dot`` for ip), ties broken by smaller id, NULL distances
(cosine with a zero vector) last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.vector import distance, resolve_metric
from quiver.operators.topk_kernel import QUERY_GROUP, TopK, empty_result, flags_from, row_chunks, vectors_from_arrow

KNN_SCHEMA = "qid long, id long, d double"
KNN_RANKED_SCHEMA = "qid long, id long, d double, rk int"

# Bytes of query vectors we are willing to broadcast to every executor.
DEFAULT_BROADCAST_BYTES = 256 << 20
# Bytes of vectors per grid cell side (one cogroup side held in a task).
DEFAULT_BLOCK_BYTES = 64 << 20
# Query sets needing up to this many broadcast blocks scan the corpus once per
# block (no corpus shuffle); larger ones use the grid plan.
DEFAULT_MAX_SCAN_BLOCKS = 8
# One scan task in so many is searched first for the bounds; a corpus of fewer than 4 x as many files goes without.
DEFAULT_PILOT_STRIDE = 64


def _conf_int(spark, key: str, default: int) -> int:
    v = spark.conf.get(key, None)
    return int(v) if v else default


def _vector_stats(df: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, max dimension) in one aggregate job."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
    return int(r["n"]), int(r["dim"] or 0)


def _collect_matrix(df: DataFrame, id_col: str, vec_col: str, extra: list[str] | None = None):
    """Collect a size-checked vector table to the driver as numpy (for broadcast)."""
    t = df.select(id_col, vec_col, *(extra or [])).toArrow()
    ids = t.column(id_col).to_numpy().astype(np.int64)
    X = vectors_from_arrow(t.column(vec_col), stored=True).astype(np.float32)
    ex = {c: t.column(c).to_numpy(zero_copy_only=False) for c in (extra or [])}
    return ids, X, ex


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where their files are few: a row's work grows with the query set, and each row moves once."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < 4 * cores else rows


def rank_partials(partials: DataFrame, k: int, order_null_last: bool = True) -> DataFrame:
    """Merge partial top-k rows into final ranks per query."""
    w = Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), F.col("id").asc())
    return partials.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    where: Column | None = None,
    id_col: str = "id",
    vec_col: str = "embed",
    qid_col: str = "qid",
    qvec_col: str = "embed",
    distribution: str = "sharded",
    flag: Column | None = None,
    broadcast_bytes: int | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """K2: exact top-k of every query against ``corpus`` (optionally filtered by ``where``).

    ``flag``: optional boolean Column over corpus rows carried to the output as
    ``ok`` (used by post-filtering).
    """
    m = resolve_metric(metric)
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = corpus.sparkSession
    bbytes = broadcast_bytes or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
    blk = block_bytes or _conf_int(spark, "quiver.knn.blockBytes", DEFAULT_BLOCK_BYTES)
    c = corpus if where is None else corpus.where(where)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")]
    if flag is not None:
        cols.append(F.coalesce(flag, F.lit(False)).alias("ok"))
    c = c.select(*cols)
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).alias("v"))
    with_flag = flag is not None

    dist = distribution.lower()
    if dist not in ("sharded", "single", "replicated", "grid"):
        raise ValueError(f"unknown distribution {distribution!r}")
    if dist == "replicated":
        n, dim = _vector_stats(c, "v")
        if n * max(dim, 1) * 4 > bbytes:
            raise ValueError(f"corpus of {n} x {dim} is over the broadcast budget {bbytes} bytes; use 'sharded'")
        return _replicated(c, q, k, m, with_flag)
    nq, dim = _vector_stats(q, "v")
    if nq and q.select("qid").distinct().count() < nq:
        raise ValueError("query ids repeat")
    # Broadcast bytes plus the per-task top-k state (ids, distances) of every query.
    q_bytes = nq * (max(dim, 1) * 4 + k * 24)
    blocks = max(1, math.ceil(q_bytes / bbytes))
    max_scans = _conf_int(spark, "quiver.knn.maxScanBlocks", DEFAULT_MAX_SCAN_BLOCKS)
    if dist != "grid" and 1 < blocks <= max_scans:
        blocks = _fit_blocks(q, blocks, max_scans, q_bytes / max(nq, 1), bbytes)
    stride = pilot_stride(c) if dist != "grid" and blocks <= max_scans else 0
    if dist != "grid" and blocks == 1:
        partials = _sharded_partials(c, q, k, m, with_flag, stride)
    elif dist != "grid" and blocks <= max_scans:
        # A few size-checked query blocks, each broadcast to its own scan of
        # the corpus: the corpus is read `blocks` times but never shuffled.
        parts = [_sharded_partials(c, q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k, m, with_flag, stride)
                 for b in range(blocks)]
        partials = parts[0]
        for p_ in parts[1:]:
            partials = partials.unionByName(p_)
    else:
        nc, cdim = _vector_stats(c, "v")
        partials = _grid_partials(c, q, k, m, with_flag, nq, nc, max(dim, cdim, 1), blk)
    out = rank_partials(partials, k)
    return out.select("qid", "id", "d", "rk", *(["ok"] if with_flag else []))


def _fit_blocks(q: DataFrame, blocks: int, max_blocks: int, row_bytes: float, budget: int) -> int:
    """Smallest hash-block count whose largest block fits the budget (only ``blocks`` counts reach the driver)."""
    while blocks <= max_blocks:
        key = F.pmod(F.xxhash64("qid"), F.lit(blocks))
        largest = max(r["c"] for r in q.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
        if largest * row_bytes <= budget:
            return blocks
        blocks += 1
    return max_blocks + 1  # does not fit: grid plan


def pilot_stride(c: DataFrame) -> int:
    """One in how many scan tasks is searched first; 0 (none) for a corpus of few files or one not read from files."""
    stride = _conf_int(c.sparkSession, "quiver.knn.pilotStride", DEFAULT_PILOT_STRIDE)
    return stride if stride > 0 and len(c.inputFiles()) >= 4 * stride else 0


def _sharded_partials(c: DataFrame, q: DataFrame, k: int, m: str, with_flag: bool, stride: int = 0) -> DataFrame:
    """Each scan task's top-k; with ``stride``, only what lies within the k-th distance found by one task in ``stride``.

    Any k rows of the corpus bound the k-th distance from above, so the bounds cut nothing that ranks. A query for
    which those tasks hold fewer than k rows (a selective filter) has no bound.
    """
    spark = c.sparkSession
    qids, Q, _ = _collect_matrix(q, "qid", "v")
    bq = spark.sparkContext.broadcast((qids, Q))
    schema = KNN_SCHEMA + (", ok boolean" if with_flag else "")

    def scan(limits=None, every: int = 1) -> DataFrame:
        def kernel(batches):
            from pyspark import TaskContext

            if every > 1 and TaskContext.get().partitionId() % every:
                return  # reads no input
            qids_, Q_ = bq.value
            for t in row_chunks(batches, Q_.shape[1]):
                ids, X = t.column(0).to_numpy(), vectors_from_arrow(t.column(1), stored=True)
                flags = flags_from(t) if with_flag else None
                for a in range(0, len(qids_), QUERY_GROUP):  # the state held is a group's, whatever the query set
                    own = slice(a, a + QUERY_GROUP)
                    top = TopK(qids_[own], Q_[own], k, m)
                    top.add(ids, X, flags)
                    yield top.result(with_flag=with_flag, limit=None if limits is None else limits.value[own])

        return rows.mapInArrow(kernel, schema)

    rows = c if stride else spread(c)
    if not stride:
        return scan()
    found = rank_partials(scan(every=stride), k).where((F.col("rk") == k) & F.col("d").isNotNull()).select("qid", "d").toArrow()  # a row per query
    limit, order = np.full(len(qids), np.inf), np.argsort(qids)
    limit[order[np.searchsorted(qids[order], found["qid"].to_numpy())]] = found["d"].to_numpy()
    return scan(spark.sparkContext.broadcast(limit))


def _grid_partials(c, q, k, m, with_flag, nq, nc, dim, blk) -> DataFrame:
    row_bytes = dim * 4 + 16
    qb = max(1, math.ceil(nq * row_bytes / blk))
    cb = max(1, math.ceil(nc * row_bytes / blk))
    qrep = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    crep = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(cb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    schema = KNN_SCHEMA + (", ok boolean" if with_flag else "")

    def cell(ct, qt):
        if ct.num_rows == 0 or qt.num_rows == 0:
            return empty_result(with_flag)
        top = TopK(qt.column("qid").to_numpy(), vectors_from_arrow(qt.column("v"), stored=True), k, m)
        top.add(ct.column("id").to_numpy(), vectors_from_arrow(ct.column("v"), stored=True), flags_from(ct) if with_flag else None)
        return pa.Table.from_batches([top.result(with_flag=with_flag)])

    return crep.groupBy("qb", "cb").cogroup(qrep.groupBy("qb", "cb")).applyInArrow(cell, schema)


def _replicated(c: DataFrame, q: DataFrame, k: int, m: str, with_flag: bool) -> DataFrame:
    ids, X, ex = _collect_matrix(c, "id", "v", ["ok"] if with_flag else None)
    flags = ex["ok"].astype(bool) if with_flag else None
    return replicated_arrays(q, ids, X, k, m, flags)


def replicated_arrays(q: DataFrame, ids: np.ndarray, X: np.ndarray, k: int, m: str,
                      flags: np.ndarray | None = None) -> DataFrame:
    """Top-k of every query ``(qid, v)`` against a driver-side, size-checked matrix (no shuffle)."""
    spark = q.sparkSession
    with_flag = flags is not None
    bc = spark.sparkContext.broadcast((ids, X, flags))
    schema = KNN_RANKED_SCHEMA + (", ok boolean" if with_flag else "")

    def kernel(batches):
        ids_, X_, f_ = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            top = TopK(rb.column(0).to_numpy(), vectors_from_arrow(rb.column(1), stored=True), k, m)
            top.add(ids_, X_, f_)
            out = top.result(with_rank=True, with_flag=with_flag)
            if with_flag:
                out = out.select(["qid", "id", "d", "rk", "ok"])
            yield out

    return q.mapInArrow(kernel, schema)


def knn_one(corpus: DataFrame, vector: list[float], k: int, metric: str = "l2", where: Column | None = None,
            vec_col: str = "embed") -> DataFrame:
    """K1: top-k for one literal query vector, JVM-side (sort + limit -> TakeOrderedAndProject)."""
    c = corpus if where is None else corpus.where(where)
    lit_vec = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
    return (
        c.select("id", distance(metric, vec_col, lit_vec).alias("d"))
        .orderBy(F.col("d").asc_nulls_last(), F.col("id"))
        .limit(k)
    )


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    where: Column | None = None,
    mode: str = "normal",
    oversample: int = 1,
    index=None,
    distribution: str = "sharded",
    **kw,
) -> DataFrame:
    """K3-K6: filtered top-k under a search mode.

    * ``normal``/``pre``: filter first, then rank (through ``index`` when given).
    * ``post``: rank the top ``k * oversample`` unfiltered, then filter; may
      return fewer than k rows per query.
    * ``force``: exact filtered scan, the index is not used.
    """
    md = mode.lower()
    if index is not None and md != "force" and resolve_metric(metric) != resolve_metric(index.metric):
        raise ValueError(f"the index ranks by {index.metric}, not by {metric}")
    if md in ("normal", "pre"):
        if index is not None:
            return index.search(queries, k, where=where, **kw)
        return knn(corpus, queries, k, metric, where=where, distribution=distribution, **kw)
    if md == "force":
        return knn(corpus, queries, k, metric, where=where, distribution=distribution, **kw)
    if md == "post":
        kk = k * max(1, oversample)
        if where is None:
            if index is not None:
                return index.search(queries, k, **kw)
            return knn(corpus, queries, k, metric, distribution=distribution, **kw)
        if index is not None:
            raw = index.search(queries, kk, flag=where, **kw)
        else:
            raw = knn(corpus, queries, kk, metric, flag=where, distribution=distribution, **kw)
        kept = raw.where(F.col("ok")).drop("rk", "ok")
        return rank_partials(kept, k).select("qid", "id", "d", "rk")
    raise ValueError(f"unknown mode {mode!r}")


def query_prefix(queries: DataFrame, n: int, qid_col: str = "qid") -> DataFrame:
    """K7: the first n queries by id (a deliberate row limit: the feature itself)."""
    return queries.orderBy(qid_col).limit(n)
