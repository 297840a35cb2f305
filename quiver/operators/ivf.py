"""Inverted-file index as ordinary tables.

Tables of an index directory::

    centroids(list_id int, centroid array<float>)
    lists(list_id int, id long, embed, i32v, f32v, strv)   partitioned by list_id
    list_sizes(list_id int, n long)
    meta.json  {"type": "ivfflat", "metric": ..., "lists": ..., "n_probes": ...}

Build: centroids (k-means on a sample, or given), nearest-centroid assignment
by a broadcast of the size-checked centroid matrix, ``REBALANCE(list_id)``
write (AQE splits a hot list over several files).

Search: the n_probes nearest lists per query (broadcast centroids, no
shuffle); only probed list directories are read (static partition filter).
Then either (a) the query set and a per-list map of probing queries are
broadcast (size-checked) and the lists are scanned once by an Arrow kernel -
no list row is shuffled; or (b) above the budget, one bounded cogroup cell per
(list, corpus split, query split), so that neither a hot list nor a list
probed by many queries lands whole in one task. Partial top-k per task or
cell, final ``row_number`` per query.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vector import normalize, resolve_metric
from quiver.operators.knn import (
    DEFAULT_BROADCAST_BYTES,
    DEFAULT_MAX_SCAN_BLOCKS,
    KNN_SCHEMA,
    _collect_matrix,
    _conf_int,
    _vector_stats,
    rank_partials,
    spread,
)
from quiver.operators import expand
from quiver.operators.topk_kernel import QUERY_GROUP, TopK, empty_result, flags_from, row_chunks, vectors_from_arrow
from quiver.session import ensure_checkpoint_dir, scratch_dir

DEFAULT_BLOCK_BYTES = 64 << 20
CENTROID_BROADCAST_BYTES = 256 << 20


def lists_rule(n: int) -> int:
    """n/1000 below a million rows, sqrt(n) from there on, at least 10."""
    # A list per 1,000 rows up to a million rows, ten lists at least.
    per_list, large, least = 1_000, 1_000_000, 10
    return max(least, math.isqrt(n) if n >= large else n // per_list)


def centroids_from_labels(df: DataFrame, label_col: str = "label", vec_col: str = "embed", digits: int = 6) -> DataFrame:
    """Deterministic centroids: mean vector per label (double sums, rounded).

    A JVM vector aggregate (Spark ML Summarizer) with partial aggregation,
    so a label holding most rows is combined map-side before the shuffle.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = df.groupBy(F.col(label_col).cast("int").alias("list_id")).agg(
        Summarizer.mean(array_to_vector(vec_col)).alias("mean"))
    return means.select(
        "list_id",
        F.transform(vector_to_array("mean"), lambda x: F.round(x, digits).cast("float")).alias("centroid"),
    )


def train_centroids(df: DataFrame, lists: int, train_percent: float = 10.0, metric: str = "l2", seed: int = 42,
                    vec_col: str = "embed", max_iter: int = 20) -> DataFrame:
    """K-means (Spark ML) on a ``train_percent`` sample; cosine/ip train on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    m = resolve_metric(metric)
    budget = _conf_int(df.sparkSession, "quiver.ivf.centroidBroadcastBytes", CENTROID_BROADCAST_BYTES)
    dim = len((df.select(vec_col).first() or [[]])[0] or [])
    if lists * dim * 4 > budget:  # before training: Spark's k-means holds all centres on the driver
        raise ValueError(f"{lists} centroids x {dim} exceed the broadcast budget {budget} bytes")
    vec = normalize(vec_col) if m in ("cosine", "ip") else F.col(vec_col)
    frac = min(1.0, max(train_percent, 0.0) / 100.0)
    sample = df.select(array_to_vector(vec).alias("features"))
    if frac < 1.0:
        sample = sample.sample(fraction=frac, seed=seed)
    km = KMeans(k=lists, seed=seed, maxIter=max_iter, initMode="k-means||", featuresCol="features")
    model = km.fit(sample)
    centers = model.clusterCenters()  # lists x dim, bounded by the list count
    spark = df.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "list_id int, centroid array<float>")


def assign(df: DataFrame, centroids: DataFrame, metric: str = "l2", vec_col: str = "embed",
           arrays: tuple | None = None) -> DataFrame:
    """Nearest-centroid ``list_id`` per row (ties -> smaller list id); all columns kept.

    The centroid matrix is size-checked and broadcast; rows stream through an
    Arrow kernel with no shuffle.
    """
    m = resolve_metric(metric)
    spark = df.sparkSession
    cids, C = arrays if arrays is not None else centroid_arrays(centroids)
    bc = spark.sparkContext.broadcast((cids, C))
    names = df.columns
    vi = names.index(vec_col)
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("list_id", T.IntegerType(), False)])

    def kernel(batches):
        import pyarrow as pa

        cids_, C_ = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = vectors_from_arrow(rb.column(vi), stored=True)
            top = TopK(np.arange(rb.num_rows, dtype=np.int64), X, 1, m)
            top.add(cids_, C_)
            res = top.result()
            lid = np.empty(rb.num_rows, dtype=np.int32)
            lid[res.column(0).to_numpy()] = res.column(1).to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [pa.array(lid, pa.int32())], schema=rb.schema.append(pa.field("list_id", pa.int32())))

    return df.mapInArrow(kernel, out_schema)


def centroid_arrays(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list ids, centroid matrix) on the driver, size-checked before collecting."""
    spark = centroids.sparkSession
    n, dim = _vector_stats(centroids, "centroid")
    budget = _conf_int(spark, "quiver.ivf.centroidBroadcastBytes", CENTROID_BROADCAST_BYTES)
    if n * max(dim, 1) * 4 > budget:
        raise ValueError(f"{n} centroids x {dim} exceed the broadcast budget {budget} bytes")
    cids, C, _ = _collect_matrix(centroids, "list_id", "centroid")
    return cids, C


@dataclass
class IvfIndex:
    centroids: DataFrame
    lists: DataFrame
    list_sizes: DataFrame
    metric: str = "l2"
    n_probes: int = 1
    vec_col: str = "embed"
    path: str | None = None
    meta: dict = field(default_factory=dict)
    _cen: tuple | None = field(default=None, repr=False)
    _radii: np.ndarray | None = field(default=None, repr=False)

    @property
    def shards(self) -> int:
        """K8: independent sub-indexes; the lists of shard s have the ids that leave s when divided by their number."""
        return int(self.meta.get("shards", 1))

    def centroid_groups(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The centroid matrix of each shard."""
        cids, C = self.centroid_matrix()
        return [(cids[cids % self.shards == s], C[cids % self.shards == s]) for s in range(self.shards)]

    def nearest(self, n_probes: int):
        """``(function, number)``: positions in ``centroid_matrix`` of the lists that :meth:`probes` gives each query, and how many."""
        cids, groups, m = self.centroid_matrix()[0], self.centroid_groups(), resolve_metric(self.metric)
        by = np.argsort(cids)

        def positions(Q: np.ndarray, _: int) -> np.ndarray:
            out = []
            for own, C in groups:
                top = TopK(np.arange(len(Q), dtype=np.int64), Q, min(n_probes, len(own)), m)
                top.add(own, C.astype(np.float64))
                out.append(by[np.searchsorted(cids[by], top.best_i)])
            return np.concatenate(out, axis=1)

        return positions, sum(min(n_probes, len(own)) for own, _ in groups)

    def centroid_matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The (size-checked) centroid matrix, collected once per index object."""
        if self._cen is None:
            self._cen = centroid_arrays(self.centroids)
        return self._cen

    def probes(self, queries: DataFrame, n_probes: int | None = None, qvec_col: str = "embed") -> DataFrame:
        """(qid, list_id, probe_rank): the nearest lists of each query, in every shard (broadcast centroids, no shuffle)."""
        from quiver.operators.knn import replicated_arrays

        p = n_probes or self.n_probes
        q = queries.select(F.col("qid").cast("long"), F.col(qvec_col).alias("v"))
        found = [replicated_arrays(q, cids, C, p, self.metric) for cids, C in self.centroid_groups() if len(cids)]
        if not found:
            return q.sparkSession.createDataFrame([], "qid long, list_id int, probe_rank int")
        r = functools.reduce(DataFrame.unionByName, found)
        return r.select("qid", F.col("id").cast("int").alias("list_id"), F.col("rk").alias("probe_rank"))

    def radii(self) -> np.ndarray:
        """Per list of ``centroid_matrix``, the greatest distance of a row from the centroid (-1: an empty list); stored with the index."""
        if self._radii is None:
            metric = resolve_metric(self.metric)
            self._radii = stored_radii(self, "list_radii", expand.vector_offsets(metric), [self.vec_col])
        return self._radii

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None,
               n_probes: int | None = None, qvec_col: str = "embed", block_bytes: int | None = None,
               broadcast_bytes: int | None = None, fill: bool = True) -> DataFrame:
        """Probe ``n_probes`` lists, rank exactly inside them, filter first (``pre``).

        Plan: when the query set and its probe map fit the broadcast budget,
        they are broadcast and the (partition-pruned) lists are scanned once
        by an Arrow kernel; each list's rows are ranked only against the
        queries that probe it and no list row is shuffled. Otherwise the
        bounded-cell cogroup plan (:func:`cell_search`) is used. With ``fill``, a query that a filter
        leaves under k rows goes on through further lists (:mod:`quiver.operators.expand`).
        """
        ensure_checkpoint_dir(queries.sparkSession)
        # (qid, list_id) is consumed twice (probe counts and query cells):
        # computed once and checkpointed (queries x probes small rows).
        probes = self.probes(queries, n_probes, qvec_col).checkpoint(eager=True)
        q = queries.select(F.col("qid").cast("long"), F.col(qvec_col).alias("v"))
        run = lambda q, probes: self._partials(q, probes, k, where, flag, block_bytes, broadcast_bytes)
        out = rank_partials(run(q, probes), k)
        if fill and where is not None and flag is None:
            cids, C = self.centroid_matrix()
            near, probed = self.nearest(n_probes or self.n_probes)
            if probed < len(cids):
                out = rank_partials(expand.filled(out.select("qid", "id", "d"), q, k, probed, resolve_metric(self.metric), (cids, C, self.radii()), near, run), k)
        return out.select("qid", "id", "d", "rk", *(["ok"] if flag is not None else []))

    def _partials(self, q: DataFrame, probes: DataFrame, k: int, where: Column | None, flag: Column | None,
                  block_bytes: int | None, broadcast_bytes: int | None) -> DataFrame:
        """Partial top-k ``(qid, id, d[, ok])`` of the pairs ``probes(qid, list_id)``."""
        rows = prune_lists(self.lists, probes)
        rows = rows if where is None else rows.where(where)
        cols = [F.col("list_id"), F.col("id"), F.col(self.vec_col).alias("v")]
        if flag is not None:
            cols.append(F.coalesce(flag, F.lit(False)).alias("ok"))
        rows = rows.select(*cols)
        with_flag = flag is not None
        partials = scan_partials(spread(rows), q, probes, k, broadcast_bytes,
                                 lambda bp: _flat_scan_kernel(bp, k, self.metric, with_flag),
                                 KNN_SCHEMA + (", ok boolean" if with_flag else ""))
        if partials is None:
            partials = cell_search(rows, q, probes, self.list_sizes, k, self.metric, flag is not None,
                                   block_bytes or _conf_int(rows.sparkSession, "quiver.knn.blockBytes", DEFAULT_BLOCK_BYTES),
                                   n_lists=len(self.centroid_matrix()[0]))
        return partials


def stored_radii(index: IvfIndex, name: str, offsets, columns: list[str]) -> np.ndarray:
    """The radii kept below the index's path under ``name``, computed and written there where they aren't yet."""
    spark = index.lists.sparkSession
    cids, C = index.centroid_matrix()
    if index.path and not index.meta.get("appended"):
        path = f"{index.path}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            expand.radii(index.lists, (cids, C), offsets, columns).write.mode("overwrite").parquet(path)
        table = spark.read.schema("list_id int, radius double").parquet(path)
    else:
        table = expand.radii(index.lists, (cids, C), offsets, columns)
    found = {r["list_id"]: r["radius"] for r in table.collect()}  # a row per list
    return np.array([found.get(int(c), -1.0) for c in cids])


def probe_plan(q: DataFrame, probes: DataFrame, k: int, budget: int | None = None):
    """Driver-side query matrix and per-list query index (CSR), or None when over the budget.

    Bytes = queries x (dim x 4 + k x 24) for vectors and per-task top-k state
    plus 12 per (query, list) probe; checked before anything is collected.
    """
    spark = q.sparkSession
    budget = budget or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
    nq, dim = _vector_stats(q, "v")
    n_probe_rows = probes.count()
    if nq * (max(dim, 1) * 4 + k * 24) + n_probe_rows * 12 > budget:
        return None
    qids, Q, _ = _collect_matrix(q, "qid", "v")
    if len(np.unique(qids)) < len(qids):
        raise ValueError("query ids repeat")
    t = probes.select("qid", "list_id").toArrow()
    p_qid = t.column("qid").to_numpy()
    p_lid = t.column("list_id").to_numpy().astype(np.int64)
    order = np.argsort(qids, kind="stable")
    qidx = order[np.searchsorted(qids[order], p_qid)]
    by_list = np.lexsort((qidx, p_lid))
    lids, starts = np.unique(p_lid[by_list], return_index=True)
    offsets = np.append(starts, len(by_list)).astype(np.int64)
    return qids, Q, lids, offsets, qidx[by_list]


def scan_partials(rows: DataFrame, q: DataFrame, probes: DataFrame, k: int, budget: int | None, kernel_for, schema: str):
    """Broadcast-scan partial top-k over the (pruned) list rows, or None when it does not fit.

    The query set (+ probe map) is broadcast whole when it fits the budget,
    else split by hash into at most ``quiver.knn.maxScanBlocks`` size-checked
    blocks, each with its own scan of the lists (read again, never shuffled).
    ``kernel_for(broadcast_plan)`` builds the mapInArrow kernel.
    """
    spark = rows.sparkSession
    budget = budget or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
    plan = probe_plan(q, probes, k, budget)
    if plan is not None:
        return rows.mapInArrow(kernel_for(spark.sparkContext.broadcast(plan)), schema)
    nq, dim = _vector_stats(q, "v")
    need = nq * (max(dim, 1) * 4 + k * 24) + probes.count() * 12
    blocks = max(2, math.ceil(need / budget))
    if blocks > _conf_int(spark, "quiver.knn.maxScanBlocks", DEFAULT_MAX_SCAN_BLOCKS):
        return None
    parts = []
    for b in range(blocks):
        in_block = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b
        plan_b = probe_plan(q.where(in_block), probes.where(in_block), k, budget)
        if plan_b is None:  # an unlucky block over the budget: use the cell plan
            return None
        parts.append(rows.mapInArrow(kernel_for(spark.sparkContext.broadcast(plan_b)), schema))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def list_queries(plan, lid: int, first: int = 0, stop: int | None = None):
    """Query row indices in ``[first, stop)`` probing list ``lid`` (empty when none), ascending."""
    _, _, lids, offsets, qix = plan
    j = int(np.searchsorted(lids, lid))
    if j >= len(lids) or lids[j] != lid:
        return qix[:0]
    own = qix[offsets[j]:offsets[j + 1]]
    return own if stop is None else own[np.searchsorted(own, first):np.searchsorted(own, stop)]


def by_list(lids: np.ndarray) -> list[np.ndarray]:
    """Row positions of each list, by one sort."""
    order = np.argsort(lids, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(lids[order])) + 1)


def list_runs(plan, lids: np.ndarray, first: int, stop: int) -> list[tuple[slice, np.ndarray | None]]:
    """(rows, query rows of the group) to be scanned together, for rows sorted by list; neighbouring lists that all of the group's queries probe are one run (None)."""
    size, found = min(stop, len(plan[0])) - first, []
    edges = np.flatnonzero(np.concatenate([[True], lids[1:] != lids[:-1], [True]])).tolist()
    for s, e in zip(edges, edges[1:]):
        own = list_queries(plan, int(lids[s]), first, stop) - first
        if len(own) == size:
            own = None
            if found and found[-1][1] is None and found[-1][0].stop == s:
                s = found.pop()[0].start
        if own is None or len(own):
            found.append((slice(s, e), own))
    return found


def _flat_scan_kernel(bplan, k: int, metric: str, with_flag: bool):
    def kernel(batches):
        plan = bplan.value
        qids, Q = plan[0], plan[1]
        for t in row_chunks(batches, Q.shape[1]):
            order = np.argsort(t.column(0).to_numpy(), kind="stable")
            lids, ids, X = t.column(0).to_numpy()[order], t.column(1).to_numpy()[order], vectors_from_arrow(t.column(2), stored=True)[order]
            flags = flags_from(t)[order] if with_flag else None
            del t  # the sorted rows are all that is held
            for a in range(0, len(qids), QUERY_GROUP):  # the state held is a group's, whatever the query set
                top = TopK(qids[a:a + QUERY_GROUP], Q[a:a + QUERY_GROUP], k, metric)
                for own, sel in list_runs(plan, lids, a, a + QUERY_GROUP):
                    top.add(ids[own], X[own], flags[own] if with_flag else None, qidx=sel)
                if top.seen.any():
                    yield top.result(with_flag=with_flag)

    return kernel


# Per-list statistics are broadcast up to this many lists.
MAX_BROADCAST_LISTS = 1 << 20
# Up to this many probed lists are a static partition filter; more are a broadcast semi join.
MAX_PRUNE_LISTS = 65536


def prune_lists(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """Read only probed lists: a static ``list_id IN (...)`` partition filter.

    The probed set is bounded by the list count (never by the data); the filter
    prunes ``list_id=`` directories at planning time for saved indexes.
    """
    distinct = probes.select("list_id").distinct()
    probed = [r[0] for r in distinct.limit(MAX_PRUNE_LISTS + 1).collect()]
    if len(probed) > MAX_PRUNE_LISTS:  # too long for a filter; still at most one row per list
        return lists.join(F.broadcast(distinct), "list_id", "left_semi").select(*lists.columns)
    return lists.where(F.col("list_id").isin(probed)) if probed else lists


def cell_search(rows: DataFrame, q: DataFrame, probes: DataFrame, list_sizes: DataFrame, k: int, metric: str,
                with_flag: bool, block_bytes: int, kernel_factory=None, n_lists: int | None = None, schema: str | None = None) -> DataFrame:
    """Partial top-k of probed queries inside each list, in bounded cells.

    rows: (list_id, id, v[, ok]); q: (qid, v); probes: (qid, list_id, ...).
    A list of n rows is cut into ceil(n * row_bytes / block_bytes) corpus
    splits; the queries probing it into as many query splits as their bytes
    need. Each (list_id, csplit, qsplit) cell is one cogroup.
    """
    # Bytes per row are estimated from the query vectors' dimension in the plan,
    # not on the driver: splits are Spark columns.
    dim = F.size(F.col("v"))
    row_bytes = dim * 4 + 24
    # Rows probed per list -> query splits; rows per list -> corpus splits. Both
    # tables have one row per list (bounded by the list count) and are broadcast.
    pq = probes.join(q, "qid").select("list_id", "qid", "v")
    qstats = pq.groupBy("list_id").agg(F.count(F.lit(1)).alias("nq"), F.max(row_bytes).alias("rb"))
    # One row per list: broadcast while the list count is within bounds.
    small = (n_lists if n_lists is not None else list_sizes.count()) <= MAX_BROADCAST_LISTS
    bq = F.broadcast(qstats) if small else qstats
    stats = list_sizes.join(bq, "list_id").select(
        "list_id",
        F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("rb") / F.lit(block_bytes))).cast("int").alias("cs"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") * F.col("rb") / F.lit(block_bytes))).cast("int").alias("qs"),
    )
    stats = F.broadcast(stats) if small else stats
    # Attach each list's split counts (broadcast, one row per list); the inner
    # join also drops rows of lists nobody probes.
    rows = rows.join(stats, "list_id", "inner")
    crep = rows.withColumn("csplit", F.pmod(F.xxhash64("id"), F.col("cs")).cast("int")).withColumn(
        "qsplit", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))
    ).drop("cs", "qs")
    qrep = pq.join(stats, "list_id").withColumn("qsplit", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int")).withColumn(
        "csplit", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))
    ).drop("cs", "qs")
    schema = schema or KNN_SCHEMA + (", ok boolean" if with_flag else "")
    fn = kernel_factory(with_flag) if kernel_factory else _flat_cell(k, metric, with_flag)
    keys = ["list_id", "csplit", "qsplit"]
    return crep.groupBy(*keys).cogroup(qrep.groupBy(*keys)).applyInArrow(fn, schema)


def _flat_cell(k: int, metric: str, with_flag: bool):
    def cell(ct, qt):
        import pyarrow as pa

        if ct.num_rows == 0 or qt.num_rows == 0:
            return empty_result(with_flag)
        top = TopK(qt.column("qid").to_numpy(), vectors_from_arrow(qt.column("v"), stored=True), k, metric)
        top.add(ct.column("id").to_numpy(), vectors_from_arrow(ct.column("v"), stored=True), flags_from(ct) if with_flag else None)
        return pa.Table.from_batches([top.result(with_flag=with_flag)])

    return cell


def build_ivf(df: DataFrame, lists: int | None = None, metric: str = "l2", *, centroids: DataFrame | list[DataFrame] | None = None,
              train_percent: float = 10.0, n_probes: int = 1, seed: int = 42, path: str | None = None,
              vec_col: str = "embed", shards: int = 1, shard: Column | None = None) -> IvfIndex:
    """I2 (+I12 when ``path`` is given): build an IVF-flat index.

    ``centroids`` may be supplied (e.g. :func:`centroids_from_labels`; one table per shard if there are several);
    otherwise k-means is trained on a ``train_percent`` sample with
    ``lists`` (default :func:`lists_rule`) clusters. ``shards`` (K8): that many independent sub-indexes, by the integer column
    ``shard`` (default: a hash of the id); a search probes ``n_probes`` lists in each and merges.
    """
    m = resolve_metric(metric)
    spark = df.sparkSession
    centroids, assigned, cen = assigned_lists(df, lists, m, centroids, train_percent, seed, vec_col, shards, shard)
    # Always written, partitioned by list: searches then prune lists, columns and filters at the scan.
    idx = IvfIndex(centroids, assigned, assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")), m, n_probes, vec_col)
    idx = save_ivf(idx, path or scratch_dir(spark, "ivf"), extra_meta={"shards": shards})
    idx._cen = cen
    return idx


def assigned_lists(df: DataFrame, lists: int | None, m: str, centroids, train_percent: float, seed: int, vec_col: str,
                   shards: int = 1, shard: Column | None = None) -> tuple[DataFrame, DataFrame, tuple]:
    """Frozen centroids, the rows with their ``list_id``, and the centroid arrays; each shard (a parameter: few) has its own."""
    at = shard if shard is not None else F.pmod(F.xxhash64("id"), F.lit(shards))
    given = centroids if isinstance(centroids, list) else [centroids] * shards
    tables, rows = [], []
    for s in range(shards):
        own = df if shards == 1 else df.where(at == s)
        cen = given[s]
        if cen is None:
            cen = train_centroids(own, lists or lists_rule(own.count()), train_percent, m, seed, vec_col)
        if shards > 1:
            cen = cen.select((F.col("list_id") * shards + s).cast("int").alias("list_id"), "centroid")
        tables.append(freeze_centroids(cen))
        rows.append(assign(own, tables[-1], m, vec_col, arrays=centroid_arrays(tables[-1])))
    centroids = tables[0] if shards == 1 else freeze_centroids(functools.reduce(DataFrame.unionByName, tables))
    return centroids, functools.reduce(DataFrame.unionByName, rows), centroid_arrays(centroids)


def is_local(df: DataFrame) -> bool:
    """Whether a DataFrame is a frozen, size-checked driver-side table (see :func:`freeze_centroids`)."""
    return bool(getattr(df, "_quiver_frozen", False))


def mark_frozen(df: DataFrame) -> DataFrame:
    df._quiver_frozen = True
    return df


def freeze_centroids(centroids: DataFrame) -> DataFrame:
    """Compute the centroid table once (bounded by the list count) as a local relation.

    A derived table (e.g. an aggregate over the whole vector table) is first
    checkpointed, so the size check and the collect read the small result
    instead of rescanning the source twice.
    """
    spark = centroids.sparkSession
    if is_local(centroids):
        return centroids
    ensure_checkpoint_dir(spark)
    centroids = centroids.checkpoint(eager=True)
    n, dim = _vector_stats(centroids, "centroid")
    budget = _conf_int(spark, "quiver.ivf.centroidBroadcastBytes", CENTROID_BROADCAST_BYTES)
    if n * dim * 4 > budget:
        return centroids
    return mark_frozen(spark.createDataFrame(centroids.select("list_id", "centroid").collect(),
                                             "list_id int, centroid array<float>"))


def save_ivf(idx: IvfIndex, path: str, kind: str = "ivfflat", extra_meta: dict | None = None) -> IvfIndex:
    """Write the index tables and meta.json; return the index read back."""
    spark = idx.lists.sparkSession
    p = path.rstrip("/")
    for stale in ("list_radii", "code_radii"):
        drop_index(spark, f"{p}/{stale}")
    idx.centroids.write.mode("overwrite").parquet(f"{p}/centroids")
    (idx.lists.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{p}/lists"))
    # The schema is kept: an index of no rows has no files to read it from.
    spark.read.schema(idx.lists.schema).parquet(f"{p}/lists").groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
        f"{p}/list_sizes"
    )
    meta = {"type": kind, "metric": idx.metric, "n_probes": idx.n_probes, "vec_col": idx.vec_col, "schema": idx.lists.schema.jsonValue(),
            **(extra_meta or {})}
    _write_text(spark, f"{p}/meta.json", json.dumps(meta))
    return load_ivf(spark, p)


def load_ivf(spark: SparkSession, path: str, n_probes: int | None = None) -> IvfIndex:
    """Read an index directory."""
    p = path.rstrip("/")
    meta = json.loads(_read_text(spark, f"{p}/meta.json"))
    return IvfIndex(
        spark.read.parquet(f"{p}/centroids"),
        (spark.read.schema(T.StructType.fromJson(meta["schema"])) if "schema" in meta else spark.read).parquet(f"{p}/lists"),
        spark.read.parquet(f"{p}/list_sizes"),
        meta["metric"],
        n_probes or meta.get("n_probes", 1),
        meta.get("vec_col", "embed"),
        p,
        meta,
    )


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def drop_index(spark: SparkSession, path: str) -> None:
    """Remove an index directory; the vector table is untouched."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        fs.delete(jpath, True)


def recreate_index(df: DataFrame, path: str, **kw) -> IvfIndex:
    """Drop and rebuild the index from the current table."""
    drop_index(df.sparkSession, path)
    return build_ivf(df, path=path, **kw)


def with_appended(index: IvfIndex, rows: DataFrame) -> IvfIndex:
    """The index with already-assigned rows (e.g. from :func:`quiver.streaming.maintain.maintain_ivf`) added to its lists."""
    cols = index.lists.columns
    lists = index.lists.unionByName(rows.select(*cols))
    sizes = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return IvfIndex(index.centroids, lists, sizes, index.metric, index.n_probes, index.vec_col, index.path, {**index.meta, "appended": True},
                    _cen=index._cen)


def add_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Vectors added in chunks become one table; chunking is Spark partitions."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(jpath)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)
