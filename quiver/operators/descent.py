"""Neighbour lists below all pairs, by NN-descent (Dong, Charikar, Li, WWW 2011).

A neighbour of a neighbour is likely a neighbour. Start: every vector goes to its ``START_LISTS`` nearest centroids, and cells of at
most ``CELL_ROWS`` rows of a list (a hot list is cut by a hash) give their members exact neighbours within
the cell. Then rounds: each node's sampled neighbours, forward and reverse, new and old, meet as one bounded group and
are compared pair by pair (one of a pair at least new); a pair nearer than a member's farthest neighbour so far is an
update, and the nearest of list and updates are the next list. It ends when under ``delta`` of all places change.
The lists kept meanwhile are ``WIDEN`` times as long as those wanted, which is what recall hangs on: measured on 2,000 vectors of 64
dimensions (``igd`` 16, cells of 200 rows) 0.40 at the start, 0.81 without widening, 0.98 with it.

Work per round is n x (4 x ``sample``)^2 distances, and what moves is the groups' members and the updates. Vectors within the broadcast
budget are sent to the tasks once, and members are then ids; beyond it each member brings its vector; a hub's reverse neighbours are cut by a partial ``row_number`` before the shuffle, and joins on a hub are split by
adaptive execution. The lists are written to the shared checkpoint folder after each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.vector import resolve_metric
from quiver.operators import ivf
from quiver.operators.knn import DEFAULT_BROADCAST_BYTES, _collect_matrix, _conf_int, _vector_stats, replicated_arrays
from quiver.operators.topk_kernel import TopK, exact, vectors_from_arrow
from quiver.session import scratch_dir

CELL_ROWS = 1_000
START_LISTS = 2
SAMPLE = 16  # of each kind: forward and reverse, new and old
WIDEN = 2
DELTA = 0.001
MAX_ROUNDS = 15
EDGES = "src long, dst long, d double, new boolean"


def _cell_neighbours(igd: int, metric: str):
    def run(t):
        import pyarrow as pa

        ids, X = t.column("id").to_numpy(), vectors_from_arrow(t.column("embed"))
        top = TopK(ids, X, igd + 1, metric)
        top.add(ids, X)
        out = pa.Table.from_batches([top.result()])
        keep = pa.array(out.column("qid").to_numpy() != out.column("id").to_numpy())
        return out.filter(keep).rename_columns(["src", "dst", "d"]).append_column("new", pa.array(np.ones(int(keep.true_count), bool)))

    return run


def start_lists(table: DataFrame, igd: int, metric: str, seed: int) -> DataFrame:
    """``EDGES`` from exact search in cells of a coarse clustering."""
    n = table.count()
    lists = max(1, -(-n * START_LISTS // (CELL_ROWS // 2)))
    rows = table.select("id", "embed")
    if lists > 1:
        percent = min(100.0, 100.0 * lists * 64 / n)  # 64 training rows a list
        cids, C = ivf.centroid_arrays(ivf.freeze_centroids(ivf.train_centroids(rows, lists, percent, metric, seed, max_iter=5)))
        near = replicated_arrays(rows.select(F.col("id").alias("qid"), F.col("embed").alias("v")), cids, C, min(START_LISTS, lists), metric)
        rows = rows.join(near.select(F.col("qid").alias("id"), F.col("id").alias("list")), "id")
    else:
        rows = rows.withColumn("list", F.lit(0).cast("long"))
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).alias("cells"))  # a row per list
    rows = rows.join(F.broadcast(sizes), "list").withColumn("cell", F.pmod(F.xxhash64("id", "list"), F.col("cells")))
    found = rows.groupBy("list", "cell").applyInArrow(_cell_neighbours(igd, metric), EDGES)
    return nearest_edges(found, igd)


def nearest_edges(edges: DataFrame, igd: int) -> DataFrame:
    """The ``igd`` nearest distinct ``dst`` of every ``src``; an edge that was there before stays old."""
    one = edges.groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    w = Window.partitionBy("src").orderBy(F.col("d").asc_nulls_last(), "dst")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= igd).drop("r")


def best_updates(src: np.ndarray, dst: np.ndarray, d: np.ndarray, igd: int) -> np.ndarray:
    """Positions of the ``igd`` nearest distinct ``dst`` of every ``src``: no other of them can be in the next list."""
    order = np.lexsort((d, dst, src))
    s, t = src[order], dst[order]
    order = order[np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))] if len(s) else order
    order = order[np.lexsort((dst[order], d[order], src[order]))]
    s = src[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < igd]


def _compare(metric: str, igd: int, table=None):
    """``table``: the broadcast (sorted ids, vectors), where the groups' members come without their vectors."""

    def kernel(batches):
        import pyarrow as pa

        for rb in batches:
            out = [[], [], []]
            for row in rb.column(0):
                m = row.values
                ids, kth, new = (m.field(c).to_numpy(zero_copy_only=False) for c in ("id", "kth", "new"))
                ids, first = np.unique(ids, return_index=True)  # a neighbour both ways is one member
                fresh = np.zeros(len(ids), bool)
                np.logical_or.at(fresh, np.searchsorted(ids, m.field("id").to_numpy()), new.astype(bool))
                if table is None:
                    X = vectors_from_arrow(m.field("embed"))[first]
                else:
                    held, vectors = table.value
                    X = vectors[np.searchsorted(held, ids)].astype(np.float64)
                D = exact(metric, X, np.broadcast_to(X, (len(X), *X.shape)))
                D = np.where(np.isnan(D), np.inf, D)
                near = (D < kth[first][:, None]) & (fresh[:, None] | fresh[None, :]) & ~np.eye(len(ids), dtype=bool)
                a, b = np.nonzero(near)
                for x, y in zip(out, (ids[a], ids[b], D[a, b]), strict=True):
                    x.append(y)
            src, dst, d = (np.concatenate(x) if x else np.zeros(0) for x in out)
            own = best_updates(src, dst, d, igd)
            src, dst, d = src[own], dst[own], d[own]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(d, pa.float64()), pa.array(np.ones(len(d), bool))], ["src", "dst", "d", "new"])

    return kernel


def nn_descent(table: DataFrame, igd: int, metric: str = "l2", *, sample: int = SAMPLE, delta: float = DELTA, max_rounds: int = MAX_ROUNDS, seed: int = 42) -> DataFrame:
    """``(src, dst, rank)``: about the ``igd`` nearest other vectors of each of ``table(id, embed)``."""
    m, spark, wanted, igd = resolve_metric(metric), table.sparkSession, igd, igd * WIDEN
    base = scratch_dir(spark, "descent")
    table.select("id", "embed").write.parquet(f"{base}/vectors")
    vectors = spark.read.parquet(f"{base}/vectors")
    places = vectors.count() * igd
    n, dim = _vector_stats(vectors, "embed")
    held = None
    if n * (dim * 4 + 8) <= _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES):
        ids, X, _ = _collect_matrix(vectors, "id", "embed")
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) == len(ids):  # of a repeated id, a member's vector is its own
            held = spark.sparkContext.broadcast((ids[order], X[order]))
        del ids, X
    carried = ["embed"] if held is None else []
    start_lists(vectors, igd, m, seed).write.parquet(f"{base}/0")
    for step in range(max_rounds):
        edges = spark.read.schema(EDGES).parquet(f"{base}/{step}")
        draw = F.xxhash64("src", "dst", F.lit(seed * 1000 + step))
        forward = edges.withColumn("r", F.row_number().over(Window.partitionBy("src", "new").orderBy(draw))).where(F.col("r") <= sample).drop("r")
        forward.write.parquet(f"{base}/forward-{step}")
        forward = spark.read.schema(EDGES).parquet(f"{base}/forward-{step}")
        back = forward.withColumn("r", F.row_number().over(Window.partitionBy("dst", "new").orderBy(draw))).where(F.col("r") <= sample)
        met = forward.select("src", F.col("dst").alias("id"), "new").unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("id"), "new"))
        full = edges.groupBy("src").agg(F.when(F.count("d") >= igd, F.max("d")).alias("kth"))
        nodes = vectors.join(full.withColumnRenamed("src", "id"), "id", "left").select("id", *carried, F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
        groups = met.join(nodes, "id").groupBy("src").agg(F.collect_list(F.struct("id", *carried, "kth", "new")).alias("members"))  # at most 4 x sample
        updates = groups.select("members").mapInArrow(_compare(m, igd, held), EDGES)
        tried = forward.where("new").select("src", "dst", F.lit(True).alias("tried"))
        aged = edges.join(tried, ["src", "dst"], "left").select("src", "dst", "d", (F.col("new") & F.col("tried").isNull()).alias("new"))
        nearest_edges(aged.unionByName(updates), igd).write.parquet(f"{base}/{step + 1}")
        after = spark.read.schema(EDGES).parquet(f"{base}/{step + 1}")
        changed = after.where("new").join(edges.select("src", "dst"), ["src", "dst"], "left_anti").count()
        if changed <= delta * places:
            break
    w = Window.partitionBy("src").orderBy(F.col("d").asc_nulls_last(), "dst")
    return after.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted).select("src", "dst", "rank")


def edge_recall(edges: DataFrame, truth: DataFrame) -> float:
    """Share of the edges ``truth(src, dst)`` that ``edges`` has."""
    hit = truth.select("src", "dst").join(edges.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return float(hit.agg(F.count("hit") / F.count(F.lit(1))).first()[0] or 0.0)
