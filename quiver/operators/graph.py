"""kNN-graph index (build with detour pruning, beam search) as tables.

Build (after Ootomo et al., CAGRA, arXiv:2308.15136):

1. ``igd`` nearest neighbours of every vector -> ``edges(src, dst, rank)``
   (exact search, or through an IVF index for large tables).
2. For each edge s->d, count detours s->z->d with
   ``max(rank(s,z), rank(z,d)) < rank(s,d)``: by default a numpy kernel over
   each node's grouped neighbour arrays (no row per two-hop path); the
   relational form (wedge join on z, join back on (s, d), grouped count) is
   kept as ``detours`` and gives the same counts.
3. Per node keep the ``graph_degree/2`` edges with fewest detours (tie ->
   rank), then add reversed edges by rank (no duplicates, no self loops), then
   the remaining forward edges, up to ``graph_degree``.

Every per-node group is bounded by the degree parameters; reversed edges into
a hub (unbounded in-degree) are cut to ``graph_degree`` per node by a
``row_number`` limit that Spark applies partially before the shuffle.

Search: a graph within the broadcast budget is read by the tasks as one block, where each
batch of queries walks without a Spark job per step (:mod:`quiver.operators.graph_block`, which also has
independent graphs per shard for what is larger). Beyond it, an iterative beam join (frontier -> edges -> vectors) over one
graph, one checkpointed table per step in the shared checkpoint folder. Both give the same rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.vector import distance, resolve_metric
from quiver.operators import graph_block
from quiver.operators.knn import DEFAULT_BROADCAST_BYTES, _conf_int, knn, rank_partials
from quiver.session import ensure_checkpoint_dir


def knn_edges(table: DataFrame, igd: int, metric: str = "l2", index=None) -> DataFrame:
    """Step 1: ``(src, dst, rank)`` with the igd nearest other vectors of each vector."""
    q = table.select(F.col("id").alias("qid"), "embed")
    res = index.search(q, igd + 1) if index is not None else knn(table, q, igd + 1, metric)
    res = res.where(F.col("id") != F.col("qid"))
    w = Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), "id")
    return res.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= igd).select(
        F.col("qid").alias("src"), F.col("id").alias("dst"), "rank")


def detours(edges: DataFrame) -> DataFrame:
    """Step 2: ``(src, dst, rank, detours)`` for every edge."""
    a = edges.select(F.col("src").alias("s"), F.col("dst").alias("z"), F.col("rank").alias("r_sz"))
    b = edges.select(F.col("src").alias("z"), F.col("dst").alias("d"), F.col("rank").alias("r_zd"))
    wedges = a.join(b, "z").where(F.col("s") != F.col("d"))
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("rank").alias("r_sd"))
    tri = wedges.join(e, ["s", "d"]).where(F.greatest("r_sz", "r_zd") < F.col("r_sd"))
    counts = tri.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n_detours"))
    return edges.join(counts.select(F.col("s").alias("src"), F.col("d").alias("dst"), "n_detours"), ["src", "dst"], "left").select(
        "src", "dst", "rank", F.coalesce("n_detours", F.lit(0)).cast("long").alias("detours"))


def detours_arrays(edges: DataFrame) -> DataFrame:
    """Step 2 without wedge rows: ``(src, dst, rank, detours)`` from grouped neighbour arrays.

    Each node's out-list is grouped once (bounded by the degree); every edge
    s->z is joined to z's list, and per source node a bounded group of
    ``degree`` lists of ``degree`` ids goes through a numpy kernel that finds
    rank(z, d) for all pairs with one sort + ``searchsorted``. The shuffle
    carries ids packed in arrays instead of one row per two-hop path; hub
    nodes on the join key are split by AQE's skew join.
    """
    adj = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("nb")).select(
        F.col("src").alias("z"), F.transform("nb", lambda x: x["dst"]).alias("nz"))
    two = edges.select(F.col("src").alias("s"), F.col("dst").alias("z"), F.col("rank").alias("r")).join(adj, "z", "left")
    grp = two.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("r", "z", "nz"))).alias("lst"))
    return grp.mapInArrow(_detour_kernel, "src long, dst long, rank int, detours long")


def _detour_kernel(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for rb in batches:
        if rb.num_rows == 0:
            continue
        srcs = rb.column(0).to_numpy()
        lst = rb.column(1)
        out_s, out_d, out_r, out_c = [], [], [], []
        for k in range(rb.num_rows):
            items = lst[k].values  # struct array (r, z, nz), sorted by r
            r = items.field("r").to_numpy().astype(np.int64)
            z = items.field("z").to_numpy().astype(np.int64)
            nz = items.field("nz")
            g = len(z)
            lens = pc.list_value_length(nz).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = nz.flatten().to_numpy().astype(np.int64)
            if len(flat):
                rowid = np.repeat(np.arange(g), lens)
                starts = np.cumsum(lens) - lens
                within = np.arange(len(flat)) - np.repeat(starts, lens) + 1  # 1-based rank inside z_j's list
                uniq, inv = np.unique(np.concatenate([z, flat]), return_inverse=True)
                cz, cf = inv[:g], inv[g:]
                key = rowid * len(uniq) + cf
                order = np.argsort(key, kind="stable")
                skey, srank = key[order], within[order]
                q = (np.arange(g)[:, None] * len(uniq) + cz[None, :]).ravel()
                idx = np.minimum(np.searchsorted(skey, q), len(skey) - 1)
                M = np.where(skey[idx] == q, srank[idx], np.iinfo(np.int64).max).reshape(g, g)  # M[j, i] = rank(z_j, z_i)
                cond = (r[:, None] < r[None, :]) & (M < r[None, :])
                cnt = cond.sum(axis=0)
            else:
                cnt = np.zeros(g, dtype=np.int64)
            out_s.append(np.full(g, srcs[k], dtype=np.int64))
            out_d.append(z)
            out_r.append(r.astype(np.int32))
            out_c.append(cnt.astype(np.int64))
        if out_s:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_r)),
                 pa.array(np.concatenate(out_c))], names=["src", "dst", "rank", "detours"])


def prune(scored: DataFrame, graph_degree: int) -> DataFrame:
    """Step 3: final adjacency ``(src, dst, rank)`` with at most ``graph_degree`` edges per node."""
    half = max(1, graph_degree // 2)
    w_fwd = Window.partitionBy("src").orderBy("detours", "rank")
    fwd = scored.withColumn("pos", F.row_number().over(w_fwd))
    kept = fwd.where(F.col("pos") <= half)
    # Reversed kept edges, best original rank first; the limit is applied per
    # partition before the shuffle, so a hub never gathers all its in-edges.
    rev = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("k1"), F.col("src").alias("k2"))
    w_rev = Window.partitionBy("src").orderBy("k1", "k2")
    rev = rev.withColumn("rn", F.row_number().over(w_rev)).where(F.col("rn") <= graph_degree).drop("rn")
    cands = (
        kept.select("src", "dst", F.lit(0).alias("prio"), F.col("detours").alias("k1"), F.col("rank").cast("long").alias("k2"))
        .unionByName(rev.select("src", "dst", F.lit(1).alias("prio"), F.col("k1").cast("long").alias("k1"), "k2"))
        .unionByName(fwd.where(F.col("pos") > half).select("src", "dst", F.lit(2).alias("prio"), F.col("detours").alias("k1"),
                                                          F.col("rank").cast("long").alias("k2")))
        .where(F.col("src") != F.col("dst"))
    )
    w_dup = Window.partitionBy("src", "dst").orderBy("prio", "k1", "k2")
    uniq = cands.withColumn("u", F.row_number().over(w_dup)).where(F.col("u") == 1)
    w_fin = Window.partitionBy("src").orderBy("prio", "k1", "k2")
    return uniq.withColumn("rank", F.row_number().over(w_fin)).where(F.col("rank") <= graph_degree).select("src", "dst", "rank")


@dataclass
class GraphIndex:
    vectors: DataFrame  # (id, embed) partitioned by id
    edges: DataFrame  # (src, dst, rank)
    metric: str = "l2"
    itopk: int = 64
    search_width: int = 4
    n_seeds: int = 16
    max_iter: int = 32
    seed: int = 42
    seed_family: str = "fast"  # hash family of the start-node draw ("md5" has a DuckDB twin)
    attributes: DataFrame | None = None  # id and the columns that filters read
    _vec_ready: bool = False
    _edges_ready: bool = False
    _block: graph_block.StoredBlock | None = None

    def prepare(self) -> GraphIndex:
        """Hash partition vectors by id and edges by src once (checkpointed) for the search joins."""
        spark = self.vectors.sparkSession
        ensure_checkpoint_dir(spark)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not self._vec_ready:
            self.vectors = self.vectors.select("id", "embed").repartition(parts, "id").checkpoint(eager=True)
            self._vec_ready = True
        if not self._edges_ready:
            self.edges = self.edges.repartition(parts, "src").checkpoint(eager=True)
            self._edges_ready = True
        return self

    def block(self, budget: int) -> graph_block.StoredBlock | None:
        """The whole graph as one block, or None where its arrays are over the budget; checked before anything is written. The driver holds its ids alone."""
        if self._block is None:
            n, dim = self.vectors.agg(F.count(F.lit(1)), F.max(F.size("embed"))).first()
            degree = self.edges.agg(F.max("rank")).first()[0] or 1
            size = n * ((dim or 0) * 4 + degree * 4 + 9)
            if not n or size > budget:
                return None
            from quiver.operators.dml import sample_ids

            seeds = [r["id"] for r in sample_ids(self.vectors.select("id"), self.n_seeds, self.seed, self.seed_family).collect()]
            self._block = graph_block.StoredBlock.write(self.vectors.select("id", "embed"), self.edges, seeds, size)
        return self._block

    def release(self) -> None:
        """Deletes the block's folder: for searches whose results are stored."""
        from quiver.operators.ivf import drop_index

        if self._block is not None:
            drop_index(self.vectors.sparkSession, self._block.path)
            self._block = None

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None,
               itopk: int | None = None, search_width: int | None = None, max_iter: int | None = None,
               qvec_col: str = "embed", broadcast_bytes: int | None = None) -> DataFrame:
        """The walk visits every node; ``where`` decides which nodes may be returned, ``flag`` is returned as ``ok``."""
        args = (itopk or self.itopk, search_width or self.search_width, max_iter or self.max_iter)
        block = self.block(broadcast_bytes or _conf_int(queries.sparkSession, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES))
        if block is None:
            return graph_search(self, queries, k, *args, qvec_col, where=where, flag=flag)
        condition, ok = where if where is not None else flag, None
        if condition is not None:  # one id and flag a node: within the block's size
            marks = self.marks(condition).toArrow()
            ids, fits = marks.column("id").to_numpy(), marks.column("ok").to_numpy(zero_copy_only=False).astype(bool)
            ok = np.zeros(len(block.ids), bool)
            ok[np.searchsorted(block.ids, ids)] = fits
        q = queries.select(F.col("qid").cast("long").alias("qid"), F.col(qvec_col).alias("v"))
        parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = graph_block.replicated_search(q.repartition(parts, "qid"), block, k, *args, self.metric, ok, where is not None)
        return rank_partials(out, k).select("qid", "id", "d", "rk", *(["ok"] if where is None and flag is not None else []))

    def marks(self, condition: Column) -> DataFrame:
        """``(id, ok)`` for a filter over the attribute columns."""
        if self.attributes is None:
            raise ValueError("this graph index keeps no attribute columns to filter on")
        return self.attributes.select("id", F.coalesce(condition, F.lit(False)).alias("ok"))


def build_graph(table: DataFrame, graph_degree: int = 64, intermediate_graph_degree: int = 128, metric: str = "l2",
                index=None, detour_method: str = "arrays", neighbours: str = "exact", **search_kw) -> GraphIndex:
    """kNN graph with detour pruning.

    The initial neighbour lists are exact at every size (an all-pairs self
    search, so quadratic); ``neighbours="descent"`` takes them from NN-descent (:mod:`quiver.operators.descent`), which has no
    quadratic step, and an IVF ``index`` from its probes. Vectors and edges are hash partitioned by id once and checkpointed, so
    search steps shuffle only the small frontier and candidate tables.
    """
    m = resolve_metric(metric)
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    if neighbours not in ("exact", "descent"):
        raise ValueError(f"unknown neighbours {neighbours!r}")
    if neighbours == "descent":
        from quiver.operators.descent import nn_descent

        e = nn_descent(table, intermediate_graph_degree, m)
    else:
        e = knn_edges(table, intermediate_graph_degree, m, index)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = detours_arrays(e) if detour_method == "arrays" else detours(e)
    g = prune(scored, graph_degree).repartition(parts, "src").checkpoint(eager=True)
    # Vectors are partitioned for search on the first search (prepare()).
    return GraphIndex(table.select("id", "embed"), g, m, **search_kw, attributes=table.drop("embed"), _edges_ready=True)


def save_graph(g: GraphIndex, path: str) -> GraphIndex:
    """Vectors, edges and search parameters in a directory."""
    from quiver.operators.ivf import _write_text

    p = path.rstrip("/")
    g.vectors.write.mode("overwrite").parquet(f"{p}/vectors")
    g.edges.write.mode("overwrite").parquet(f"{p}/edges")
    if g.attributes is not None:
        g.attributes.write.mode("overwrite").parquet(f"{p}/attributes")
    meta = {"type": "graph", "metric": g.metric, "itopk": g.itopk, "search_width": g.search_width,
            "n_seeds": g.n_seeds, "max_iter": g.max_iter, "seed": g.seed, "seed_family": g.seed_family,
            "attributes": g.attributes is not None}
    _write_text(g.vectors.sparkSession, f"{p}/meta.json", json.dumps(meta))
    return load_graph(g.vectors.sparkSession, p)


def load_graph(spark, path: str) -> GraphIndex:
    from quiver.operators.ivf import _read_text

    p = path.rstrip("/")
    meta = json.loads(_read_text(spark, f"{p}/meta.json"))
    vec = spark.read.parquet(f"{p}/vectors")
    edges = spark.read.parquet(f"{p}/edges")
    return GraphIndex(vec, edges, meta["metric"], meta["itopk"], meta["search_width"], meta["n_seeds"], meta["max_iter"],
                      meta["seed"], meta.get("seed_family", "fast"),
                      spark.read.parquet(f"{p}/attributes") if meta.get("attributes") else None)


def hnsw_params(m: int = 100, ef_construction: int = 400, ef_search: int = 200) -> dict:
    """I8: hnsw settings served by the single-layer graph."""
    return {"graph_degree": m, "intermediate_graph_degree": max(m, ef_construction), "itopk": max(ef_search, 1)}


def graph_search(g: GraphIndex, queries: DataFrame, k: int, itopk: int, width: int, max_iter: int,
                 qvec_col: str = "embed", where: Column | None = None, flag: Column | None = None) -> DataFrame:
    """Beam search for a whole query set; result ``(qid, id, d, rk)``, with ``flag`` also ``ok``.

    With ``where`` the beam holds the ``itopk`` nearest nodes and, besides, the ``k``
    nearest eligible ones seen, so the walk goes on through ineligible nodes while
    only eligible ones are returned.
    """
    from quiver.operators.dml import sample_ids

    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    g.prepare()
    itopk = max(itopk, k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Partitioned by qid once: the per-step joins of candidates with their
    # query vectors then shuffle only the candidates.
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col(qvec_col).alias("qv")).repartition(parts, "qid").checkpoint(
        eager=True)
    vec = g.vectors.select("id", F.col("embed").alias("v"))
    condition = where if where is not None else flag
    if condition is None:
        vec = vec.withColumn("ok", F.lit(True))
    else:
        vec = vec.join(g.marks(condition), "id")
    seeds = [r["id"] for r in sample_ids(g.vectors.select("id"), g.n_seeds, g.seed, g.seed_family).collect()]  # n_seeds ids, a parameter
    # The seeds' vectors are n_seeds rows (a parameter): broadcast, so that no key gathers every query.
    start = q.select("qid", "qv", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("id"))
    start = _score(start, F.broadcast(vec.where(F.col("id").isin(seeds))), g.metric)
    keep = (lambda beam: _top(beam, itopk)) if where is None else (lambda beam: _top_eligible(beam, itopk, k))
    beam = keep(start.withColumn("visited", F.lit(False))).checkpoint(eager=True)
    edges = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("nid"))
    # Unvisited entries first (False < True), nearest first: one window over
    # the beam (already partitioned by qid) opens the `width` best unvisited
    # entries and marks them visited, with no join back to the beam.
    w = Window.partitionBy("qid").orderBy("visited", "d", "id")
    for _ in range(max_iter):
        o = F.row_number().over(w)
        opened = ~F.col("visited") & (o <= width)
        # No shuffle: the beam is checkpointed and partitioned by qid, so the
        # window is recomputed cheaply by the emptiness check and the step.
        marked = beam.select("qid", "id", "d", "ok", (F.col("visited") | opened).alias("visited"), opened.alias("opened"))
        frontier = marked.where(F.col("opened")).select("qid", "id")
        if frontier.isEmpty():
            break
        marked = marked.drop("opened")
        nbrs = frontier.join(edges, "id").select("qid", F.col("nid").alias("id")).distinct()
        new = nbrs.join(marked.select("qid", "id"), ["qid", "id"], "left_anti").join(q, "qid")
        scored = _score(new, vec, g.metric).withColumn("visited", F.lit(False))
        beam = keep(marked.unionByName(scored)).checkpoint(eager=True)
    out = beam.select("qid", "id", "d", "ok")
    out = rank_partials(out if where is None else out.where("ok"), k)
    return out.select("qid", "id", "d", "rk", *(["ok"] if flag is not None else []))


def _score(pairs: DataFrame, vec: DataFrame, metric: str) -> DataFrame:
    """Distances of (qid, qv, id) pairs to the stored vectors (JVM-side)."""
    return pairs.join(vec, "id").select("qid", "id", distance(metric, "qv", "v").alias("d"), "ok")


def _top(beam: DataFrame, itopk: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), "id")
    return beam.withColumn("b", F.row_number().over(w)).where(F.col("b") <= itopk).drop("b")


def _top_eligible(beam: DataFrame, itopk: int, k: int) -> DataFrame:
    """The ``itopk`` nearest and, besides, the ``k`` nearest eligible entries of each query."""
    near = Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), "id")
    own = Window.partitionBy("qid", "ok").orderBy(F.col("d").asc_nulls_last(), "id")
    ranked = beam.withColumn("b", F.row_number().over(near)).withColumn("e", F.row_number().over(own))
    return ranked.where((F.col("b") <= itopk) | (F.col("ok") & (F.col("e") <= k))).drop("b", "e")
