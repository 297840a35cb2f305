"""Graph search inside blocks that fit a task.

A block holds some vectors and their pruned kNN graph as arrays (ids, vectors, neighbour positions). A walk
in a block takes no Spark job per step: a batch of queries advances together through numpy, with the
steps of :func:`quiver.operators.graph.graph_search` (same beam, same order of opening, same rows).

* ``replicated``: a graph within the broadcast budget is one block, which tasks write to the shared checkpoint folder and every task of a search
  reads; the driver holds its ids alone, and queries stay where they are.
* ``sharded``: :func:`build_shards` cuts the vectors by a hash of their id into blocks of ``block_bytes`` and builds
  an independent graph in each, so the build is n x block work instead of n x n and nothing but a block's rows ever meets.
  A search sends the queries (size-checked) to the blocks, walks each, and merges the partial top-k; the blocks never move.

Blocks are rows of an ordinary table: ``(shard, n, dim, degree, ids, vectors, edges, seeds)``, the last four binary.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.vector import resolve_metric
from quiver.operators import packed
from quiver.operators.topk_kernel import TILE_DOUBLES, TopK, exact, vectors_from_arrow

BLOCK_BYTES = 64 << 20
BLOCK_SCHEMA = "shard int, n int, dim int, degree int, ids binary, vectors binary, edges binary, seeds binary"


def _arrow_schema(ddl: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


@dataclass
class Block:
    ids: np.ndarray  # sorted
    X: np.ndarray  # float32
    edges: np.ndarray  # positions of neighbours, -1 where there are fewer
    seeds: np.ndarray  # positions

    def row(self, shard: int) -> dict:
        return {"shard": shard, "n": len(self.ids), "dim": self.X.shape[1], "degree": self.edges.shape[1], "ids": self.ids.astype("<i8").tobytes(),
                "vectors": self.X.astype("<f4").tobytes(), "edges": self.edges.astype("<i4").tobytes(), "seeds": self.seeds.astype("<i4").tobytes()}

    @classmethod
    def from_row(cls, r: dict) -> Block:
        return cls(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f4").reshape(r["n"], r["dim"]),
                   np.frombuffer(r["edges"], "<i4").reshape(r["n"], r["degree"]), np.frombuffer(r["seeds"], "<i4"))


@dataclass
class StoredBlock:
    """A block in the shared checkpoint folder, of which the driver holds the ids and seeds."""

    path: str
    ids: np.ndarray  # sorted
    seeds: np.ndarray  # positions

    @classmethod
    def write(cls, vectors: DataFrame, edges: DataFrame, seeds: list[int], size: int) -> StoredBlock:
        """The graph of ``vectors(id, embed)`` and ``edges(src, dst, rank)``, about ``size`` bytes."""
        ids = np.sort(vectors.select("id").toArrow().column("id").to_numpy().astype(np.int64))
        bc = vectors.sparkSession.sparkContext.broadcast(ids)
        lists = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("nb"))  # a node's degree
        rows = vectors.join(lists.select(F.col("src").alias("id"), F.col("nb.dst").alias("nb")), "id", "left").select("id", "embed", "nb")

        def pack(rb):
            nb = rb.column(2)
            return {"vectors": vectors_from_arrow(rb.column(1), stored=True).astype("<f4"), "counts": np.diff(list_offsets(nb)).astype("<i4"),
                    "edges": position_of(nb.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bc.value).astype("<i4")}

        path = packed.write_packed(rows, ["id"], "graph-block", pack, ["vectors", "counts", "edges"], size)
        return cls(path, ids, np.searchsorted(ids, np.sort(np.array(seeds, np.int64))))

    def load(self) -> Block:
        counts = packed.column(self.path, "counts", "<i4").ravel()
        edges = np.full((len(counts), max(1, int(counts.max(initial=0)))), -1, np.int32)
        at = 0
        for n, (flat,) in packed.read_packed(self.path, ["edges"]):
            own = edges[at : at + n]
            own[np.arange(edges.shape[1])[None, :] < counts[at : at + n, None]] = np.frombuffer(flat, "<i4")  # row by row, as they are stored
            at += n
        return Block(self.ids, packed.column(self.path, "vectors", "<f4"), edges, self.seeds)


def list_offsets(col) -> np.ndarray:
    """Offsets of a list column's values, flattened; a NULL list has none."""
    import pyarrow.compute as pc

    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])


def position_of(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of ``values`` in the sorted ``ids``, -1 where they aren't there."""
    at = np.minimum(np.searchsorted(ids, values), max(0, len(ids) - 1))
    return np.where(ids[at] == values, at, -1) if len(ids) else np.full(len(values), -1)


def pruned(near: np.ndarray, degree: int) -> np.ndarray:
    """Steps 2 and 3 of the build for one block: neighbour positions by rank (-1: none) to the final edges, as ``graph.prune`` has them."""
    n, g = near.shape
    half = max(1, degree // 2)
    valid = near >= 0
    detours = np.zeros((n, g), np.int64)
    step = max(1, TILE_DOUBLES // max(1, g * g * g))
    for a in range(0, n, step):  # detour s -> z -> d: rank(s, z) and rank(z, d) both under rank(s, d)
        own = near[a : a + step]
        via = np.where(own[:, :, None] >= 0, near[own], -2)  # (s, z, rank of z's neighbour)
        for d in range(1, g):
            hit = (via[:, :d, :d] == own[:, d, None, None]).any(axis=2)
            detours[a : a + step, d] = np.where(own[:, d] >= 0, hit.sum(axis=1), 0)
    rank = np.broadcast_to(np.arange(g), (n, g))
    order = np.lexsort((rank, np.where(valid, detours, np.iinfo(np.int64).max)), axis=1)
    pos = np.empty_like(order)
    np.put_along_axis(pos, order, rank, axis=1)
    src = np.broadcast_to(np.arange(n)[:, None], (n, g))
    first, rest = valid & (pos < half), valid & (pos >= half)
    k_src, k_dst, k_rank = src[first], near[first], rank[first]
    by = np.lexsort((k_src, k_rank, k_dst))  # reversed edges: best rank first, at most `degree` into a node
    r_src, r_dst, r_rank = k_dst[by], k_src[by], k_rank[by]
    count = np.bincount(r_src, minlength=n)
    cut = np.arange(len(r_src)) - np.repeat(np.cumsum(count) - count, count) < degree
    parts = [(src[first], near[first], 0, detours[first], rank[first]), (r_src[cut], r_dst[cut], 1, r_rank[cut], r_dst[cut]),
             (src[rest], near[rest], 2, detours[rest], rank[rest])]
    s, d, k1, k2 = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1, 3, 4))
    prio = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    order = np.lexsort((k2, k1, prio, s))
    s, d = s[order], d[order]
    _, at = np.unique(s * n + d, return_index=True)  # the first of equal edges
    at.sort()
    s, d = s[at], d[at]
    count = np.bincount(s, minlength=n)
    place = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    out = np.full((n, degree), -1, np.int32)
    keep = place < degree
    out[s[keep], place[keep]] = d[keep]
    return out


def neighbours(X: np.ndarray, igd: int, metric: str) -> np.ndarray:
    """Exact ``igd`` nearest other rows of each row, by position, nearest first (ties by position)."""
    n = len(X)
    near = np.full((n, igd), -1, np.int32)
    step = max(1, (8 << 20) // max(1, X.shape[1] * 8 + (igd + 1) * 24))
    at = np.arange(n, dtype=np.int64)
    for a in range(0, n, step):
        top = TopK(at[a : a + step], X[a : a + step], igd + 1, metric)
        for b in range(0, n, 4096):
            top.add(at[b : b + 4096], X[b : b + 4096])
        rows = top.best_i
        other = (rows != at[a : a + step, None]) & (rows < n)
        order = np.argsort(~other, axis=1, kind="stable")[:, :igd]
        got = np.where(np.take_along_axis(other, order, axis=1), np.take_along_axis(rows, order, axis=1), -1)
        near[a : a + step, : got.shape[1]] = got
    return near


def build_block(ids: np.ndarray, X: np.ndarray, seed_keys: np.ndarray, degree: int, igd: int, metric: str, n_seeds: int) -> Block:
    order = np.argsort(ids)
    ids, X = ids[order], X[order]
    seeds = np.sort(np.lexsort((ids, seed_keys[order]))[:n_seeds])
    return Block(ids, X.astype(np.float32), pruned(neighbours(X, igd, metric), degree), seeds.astype(np.int32))


def walk(block: Block, Q: np.ndarray, k: int, itopk: int, width: int, max_iter: int, metric: str,
         ok: np.ndarray | None = None, only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in one block: positions (-1: none) and distances, nearest first.

    With ``only`` the beam also keeps the k nearest nodes that are ``ok``, and only these are returned.
    """
    itopk = max(itopk, k)
    slots = block.edges.shape[1] * width
    tile = max(1, TILE_DOUBLES // max(1, (slots + len(block.seeds)) * max(Q.shape[1], itopk + k)))
    parts = [_walk(block, Q[a : a + tile], k, itopk, width, max_iter, metric, ok, only) for a in range(0, len(Q), tile)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, k), np.int64), np.zeros((0, k)))


def _walk(block, Q, k, itopk, width, max_iter, metric, ok, only):
    nq, n = len(Q), len(block.ids)

    def kept(at, d, seen):
        """The beam, sorted by distance and id: the ``itopk`` nearest and, with ``only``, the k nearest eligible ones."""
        order = np.lexsort((np.where(at < 0, n, at), d, at < 0), axis=1)
        at, d, seen = (np.take_along_axis(x, order, axis=1) for x in (at, d, seen))
        keep = np.arange(at.shape[1])[None, :] < itopk
        if only:
            fits = (at >= 0) & ok[at]
            keep = keep | (fits & (np.cumsum(fits, axis=1) <= k))
        keep = keep & (at >= 0)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : itopk + (k if only else 0)]
        keep, at, d, seen = (np.take_along_axis(x, order, axis=1) for x in (keep, at, d, seen))
        return np.where(keep, at, -1), np.where(keep, d, np.inf), seen & keep

    def scored(at):
        d = exact(metric, Q, block.X[at].astype(np.float64))
        return np.where((at < 0) | np.isnan(d), np.inf, d)

    at = np.broadcast_to(block.seeds.astype(np.int64), (nq, len(block.seeds)))
    at, d, seen = kept(at, scored(at), np.zeros(at.shape, bool))
    for _ in range(max_iter):
        fresh = (at >= 0) & ~seen
        null = fresh & np.isinf(d)  # null distances open first, as they sort first among the unvisited
        turn = np.where(null, np.cumsum(null, axis=1), np.cumsum(fresh & ~null, axis=1) + null.sum(axis=1, keepdims=True))
        opened = fresh & (turn <= width)
        if not opened.any():
            break
        seen = seen | opened
        place = np.argsort(~opened, axis=1, kind="stable")[:, :width]
        front = np.where(np.take_along_axis(opened, place, axis=1), np.take_along_axis(at, place, axis=1), -1)
        new = np.where(front[:, :, None] >= 0, block.edges[front], -1).reshape(nq, -1).astype(np.int64)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        # Drop what the beam holds: both sides as one sorted key list per batch.
        base = np.arange(nq)[:, None] * (n + 1)
        held = np.sort((base + np.where(at >= 0, at, n)).ravel())
        key = (base + np.where(new >= 0, new, n)).ravel()
        spot = np.minimum(np.searchsorted(held, key), len(held) - 1)
        new = np.where((new >= 0) & (held[spot] != key).reshape(new.shape), new, -1)
        new = np.sort(new, axis=1)[:, ::-1][:, : max(1, int((new >= 0).sum(axis=1).max(initial=0)))]
        at, d, seen = kept(np.concatenate([at, new], axis=1), np.concatenate([d, scored(new)], axis=1),
                           np.concatenate([seen, np.zeros(new.shape, bool)], axis=1))
    if only:
        fits = (at >= 0) & ok[at]
        order = np.argsort(~fits, axis=1, kind="stable")
        at, d = np.take_along_axis(np.where(fits, at, -1), order, axis=1), np.take_along_axis(np.where(fits, d, np.inf), order, axis=1)
    pad = max(0, k - at.shape[1])
    return np.pad(at[:, :k], ((0, 0), (0, pad)), constant_values=-1), np.pad(d[:, :k], ((0, 0), (0, pad)), constant_values=np.inf)


def result_batch(qids: np.ndarray, ids: np.ndarray, at: np.ndarray, d: np.ndarray, ok: np.ndarray | None = None):
    import pyarrow as pa

    valid = at >= 0
    row, dist = np.repeat(qids, valid.sum(axis=1)), d[valid]
    columns = {"qid": pa.array(row, pa.int64()), "id": pa.array(ids[at[valid]], pa.int64()), "d": pa.array(dist, pa.float64(), mask=~np.isfinite(dist))}
    if ok is not None:
        columns["ok"] = pa.array(ok[at[valid]], pa.bool_())
    return pa.RecordBatch.from_pydict(columns)


def replicated_search(q: DataFrame, block: StoredBlock, k: int, itopk: int, width: int, max_iter: int, metric: str,
                      ok: np.ndarray | None = None, only: bool = False) -> DataFrame:
    """Top-k of every query ``(qid, v)`` in a block that every task reads; no shuffle of queries or block."""
    bc = q.sparkSession.sparkContext.broadcast((block, ok))
    flagged = ok is not None and not only

    def kernel(batches):
        stored, fits = bc.value
        own = None
        for rb in batches:
            if rb.num_rows:
                own = own or stored.load()  # held while the task runs
                at, d = walk(own, vectors_from_arrow(rb.column(1)), k, itopk, width, max_iter, metric, fits, only)
                yield result_batch(rb.column(0).to_numpy(), own.ids, at, d, fits if flagged else None)

    return q.mapInArrow(kernel, "qid long, id long, d double" + (", ok boolean" if flagged else ""))


@dataclass
class GraphShards:
    """A graph index of independent blocks."""

    blocks: DataFrame
    metric: str = "l2"
    itopk: int = 64
    search_width: int = 4
    max_iter: int = 32
    attributes: DataFrame | None = None  # shard, id and the columns that filters read
    meta: dict = field(default_factory=dict)

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None, itopk: int | None = None,
               search_width: int | None = None, max_iter: int | None = None, qvec_col: str = "embed", broadcast_bytes: int | None = None) -> DataFrame:
        """Each query walks every block; ``(qid, id, d, rk)`` of the merged top-k, with ``flag`` also ``ok``."""
        from quiver.operators.knn import DEFAULT_BROADCAST_BYTES, _collect_matrix, _conf_int, _vector_stats, rank_partials

        spark = queries.sparkSession
        condition = where if where is not None else flag
        only, flagged = where is not None, where is None and flag is not None
        blocks = self.blocks
        if condition is not None:
            if self.attributes is None:
                raise ValueError("this graph index keeps no attribute columns to filter on")
            fits = self.attributes.where(F.coalesce(condition, F.lit(False))).groupBy("shard").agg(F.collect_list("id").alias("fits"))  # a block's ids at most
            rows = blocks.agg(F.sum("n")).first()[0] or 0
            small = rows * 8 <= _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
            blocks = blocks.join(F.broadcast(fits) if small else fits, "shard", "left")
        q = queries.select(F.col("qid").cast("long"), F.col(qvec_col).alias("v"))
        nq, dim = _vector_stats(q, "v")
        if nq and q.select("qid").distinct().count() < nq:
            raise ValueError("query ids repeat")
        budget = broadcast_bytes or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
        pieces = max(1, math.ceil(nq * (max(dim, 1) * 4 + k * 24) / budget))  # of the query set, each a scan of the blocks
        args = (k, itopk or self.itopk, search_width or self.search_width, max_iter or self.max_iter, resolve_metric(self.metric))
        shares = max(1, spark.sparkContext.defaultParallelism // max(1, self.blocks.count()))  # where blocks are few, each goes to several tasks
        if shares > 1:
            blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(spark.sparkContext.defaultParallelism)
        out = None
        for b in range(pieces):
            part = q if pieces == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(pieces)) == b)
            bc = spark.sparkContext.broadcast(_collect_matrix(part, "qid", "v")[:2])
            found = blocks.mapInArrow(_shard_kernel(bc, args, only, flagged, shares), "qid long, id long, d double" + (", ok boolean" if flagged else ""))
            out = found if out is None else out.unionByName(found)
        return rank_partials(out, k).select("qid", "id", "d", "rk", *(["ok"] if flagged else []))


def _shard_kernel(bc, args, only: bool, flagged: bool, shares: int = 1):
    """Walks of every query in a row's block, or with ``shares`` of each one in so many, from the row's ``share``."""

    def kernel(batches):
        qids, Q = bc.value
        tops = {}
        for rb in batches:
            for r in rb.to_pylist():
                share = r.get("share", 0)
                if share not in tops:
                    tops[share] = TopK(qids[share::shares], Q[share::shares].astype(np.float64), args[0], args[-1])
                top = tops[share]
                block, fits = Block.from_row(r), None
                if only or flagged:
                    fits = np.isin(block.ids, np.asarray(r["fits"] or [], np.int64))
                at, d = walk(block, top.Q, *args, fits, only)
                ids = np.where(at >= 0, block.ids[at], np.iinfo(np.int64).max)
                top.merge(np.arange(len(top.Q)), d, ids, fits[at] if flagged else np.ones(at.shape, bool))
        for top in tops.values():
            if len(top.Q):
                yield top.result(with_flag=flagged)

    return kernel


def build_shards(table: DataFrame, graph_degree: int = 64, intermediate_graph_degree: int = 128, metric: str = "l2", *, shards: int | None = None,
                 shard: Column | None = None, block_bytes: int = BLOCK_BYTES, n_seeds: int = 16, seed: int = 42, seed_family: str = "fast",
                 path: str | None = None, **search_kw) -> GraphShards:
    """I6 under ``sharded`` distribution: an independent graph per shard, written as blocks.

    ``shard``: an integer column in ``[0, shards)``; by default a hash of the id. The number of shards is what blocks of ``block_bytes`` need.
    """
    from quiver.operators.dml import _hash_key
    from quiver.operators.ivf import _write_text
    from quiver.operators.knn import _vector_stats
    from quiver.session import scratch_dir

    m, spark = resolve_metric(metric), table.sparkSession
    n, dim = _vector_stats(table, "embed")
    shards = shards or max(1, math.ceil(n * (dim * 4 + graph_degree * 4 + 8) / block_bytes))
    at = (shard if shard is not None else F.pmod(F.xxhash64("id"), F.lit(shards))).cast("int")
    rows = table.withColumn("shard", at)

    def build(t):
        import pyarrow as pa

        ids, keys = t.column("id").to_numpy(), t.column("h").to_pylist()
        block = build_block(ids, vectors_from_arrow(t.column("embed")), np.unique(np.array(keys), return_inverse=True)[1],
                            graph_degree, intermediate_graph_degree, m, n_seeds)
        return pa.Table.from_pylist([block.row(t.column("shard")[0].as_py())], schema=arrow)

    arrow = _arrow_schema(BLOCK_SCHEMA)
    base = (path or scratch_dir(spark, "graph-shards")).rstrip("/")
    blocks = rows.select("shard", "id", "embed", _hash_key(seed, seed_family).alias("h")).groupBy("shard").applyInArrow(build, BLOCK_SCHEMA)
    blocks.write.mode("overwrite").parquet(f"{base}/blocks")
    rows.drop("embed").write.mode("overwrite").parquet(f"{base}/attributes")
    _write_text(spark, f"{base}/meta.json", json.dumps({"type": "graph-shards", "metric": m, **search_kw}))
    return load_shards(spark, base)


def load_shards(spark, path: str) -> GraphShards:
    """I12 for blocks."""
    from quiver.operators.ivf import _read_text

    p = path.rstrip("/")
    meta = json.loads(_read_text(spark, f"{p}/meta.json"))
    kw = {c: meta[c] for c in ("itopk", "search_width", "max_iter") if c in meta}
    return GraphShards(spark.read.schema(BLOCK_SCHEMA).parquet(f"{p}/blocks"), meta["metric"], **kw, attributes=spark.read.parquet(f"{p}/attributes"), meta=meta)
