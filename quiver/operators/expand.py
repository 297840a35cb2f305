"""K3, K4 through IVF and PQ: probing further lists where a filter leaves a query under k rows.

A selective filter can leave fewer than k eligible rows in the lists that a query
probes first. Such a query goes on through the other lists in rounds, in the order of a lower bound of the distance that
any row of a list can have, from the list's stored radius: by the triangle inequality

    l2      max(0, |q - c| - r)          (l2sq: its square)
    ip      -q.c - |q| r
    cosine  1 - q'.c - r                 with unit vectors q', v' and r over |v' - c|

Each round probes ``GROWTH`` times as many lists as the one before, leaves out lists whose bound is over
the query's k-th distance so far, and a query ends when its next list is. So a query that was short
gets the k nearest of all eligible rows (or all of them), and no other query reads a list more.

Lists are the centroids' (bounded by the list count, size-checked by the index), the radii one number a list. Only the
queries that are short are probed again, and the pairs (query, list) of a round are rows of a checkpointed table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators.topk_kernel import vectors_from_arrow

GROWTH = 4
SAFETY = 1e-5  # radii are enlarged by this share, which covers rounding in distances and bounds


def unit(X: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("nd,nd->n", X, X))
    return X / np.where(n > 0, n, 1.0)[:, None]


def radii(rows: DataFrame, arrays: tuple[np.ndarray, np.ndarray], offsets: Callable, columns: list[str]) -> DataFrame:
    """``(list_id, radius)`` of ``rows(list_id, <columns>)``; ``offsets(columns' arrays, centroids)`` gives each row's distance from its centroid."""
    bc = rows.sparkSession.sparkContext.broadcast(arrays)

    def kernel(batches):
        import pyarrow as pa

        cids, C = bc.value
        order = np.argsort(cids)
        for rb in batches:
            if rb.num_rows:
                lids = rb.column(0).to_numpy()
                at = order[np.searchsorted(cids[order], lids)]
                r = offsets([rb.column(1 + i) for i in range(len(columns))], C[at].astype(np.float64))
                own, inv = np.unique(lids, return_inverse=True)
                most = np.zeros(len(own))
                np.maximum.at(most, inv, r)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(most)], ["list_id", "radius"])

    far = rows.select("list_id", *columns).mapInArrow(kernel, "list_id int, radius double")
    return far.groupBy("list_id").agg(F.max("radius").alias("radius"))


def vector_offsets(metric: str) -> Callable:
    """Distances of stored vectors (unit vectors for cosine) from their centroids."""

    def run(columns, C):
        X = vectors_from_arrow(columns[0])
        diff = (unit(X) if metric == "cosine" else X) - C
        return np.sqrt(np.einsum("nd,nd->n", diff, diff))

    return run


def lower_bounds(metric: str, Q: np.ndarray, C: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each query and list, what no row's distance in the list is under."""
    r = r * (1 + SAFETY)
    if metric in ("l2", "l2sq"):
        d2 = np.maximum(np.einsum("qd,qd->q", Q, Q)[:, None] - 2 * Q @ C.T + np.einsum("ld,ld->l", C, C), 0)
        low = np.maximum(np.sqrt(d2) * (1 - SAFETY) - r, 0)
        return low if metric == "l2" else low * low
    if metric == "cosine":
        return 1 - unit(Q) @ C.T - r - SAFETY
    norm = np.sqrt(np.einsum("qd,qd->q", Q, Q))[:, None]
    return -(Q @ C.T) - norm * (r + SAFETY)


def filled(first: DataFrame, q: DataFrame, k: int, n_probes: int, metric: str, lists: tuple[np.ndarray, np.ndarray, np.ndarray],
           nearest: Callable[[np.ndarray, int], np.ndarray], partials: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``(qid, id, d)``: the rows of ``first`` and, for queries ``q(qid, v)`` that it gives under k rows, the nearest of all lists.

    ``lists``: ids, centroids and radii (negative: an empty list); ``nearest(Q, n)``: positions of the lists each query has
    probed before; ``partials(q, pairs)``: ``(qid, id, d)`` of the pairs (qid, list_id).
    """
    from quiver.operators.knn import rank_partials

    cids, C, r = lists
    if n_probes >= len(cids):
        return first
    spark = q.sparkSession
    first = first.checkpoint(eager=True)
    per = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = q.join(per, "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid", "v").checkpoint(eager=True)
    if short.isEmpty():
        return first
    found = first.join(short.select("qid"), "qid", "left_semi")
    done = first.join(short.select("qid"), "qid", "left_anti")
    bc = spark.sparkContext.broadcast((cids, C.astype(np.float64), r))

    def window(start: int, stop: int):
        def kernel(batches):
            import pyarrow as pa

            ids, centroids, radius = bc.value
            for rb in batches:
                step = max(1, (1 << 21) // len(ids))
                for a in range(0, rb.num_rows, step):
                    qid, kth = (rb.column(c).slice(a, step).to_numpy(zero_copy_only=False) for c in (0, 2))
                    Q = vectors_from_arrow(rb.column(1).slice(a, step))
                    low = lower_bounds(metric, Q, centroids, np.maximum(radius, 0))
                    low[:, radius < 0] = np.inf
                    np.put_along_axis(low, nearest(Q, n_probes), np.inf, axis=1)
                    order = np.argsort(low, axis=1, kind="stable")[:, start:stop]
                    bound = np.take_along_axis(low, order, axis=1)
                    row, col = np.nonzero(np.isfinite(bound) & (bound <= kth[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row], pa.int64()), pa.array(ids[order[row, col]], pa.int32())], ["qid", "list_id"])

        return kernel

    start, size = 0, n_probes * GROWTH
    while start < len(cids):
        kth = found.groupBy("qid").agg(F.when((F.count("d") >= k), F.max("d")).alias("kth"))
        # A null distance counts as infinite; a query under k rows goes on whatever the bound.
        todo = short.join(kth, "qid", "left").select("qid", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
        pairs = todo.mapInArrow(window(start, start + size), "qid long, list_id int").checkpoint(eager=True)
        if pairs.isEmpty():
            break
        more = partials(short.join(pairs.select("qid").distinct(), "qid", "left_semi"), pairs)
        found = rank_partials(found.unionByName(more), k).select("qid", "id", "d").checkpoint(eager=True)
        start, size = start + size, size * GROWTH
    return done.unionByName(found)
