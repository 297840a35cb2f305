"""Product quantization (IVF-PQ) and scalar quantization.

IVF-PQ (Jegou, Douze, Schmid, TPAMI 2011): residual r = v - centroid(list),
split into ``m`` equal slices; slice s is encoded by the id of its nearest of
``2^bits`` sub-centroids; for cosine v is scaled to unit length first. Tables::

    codebook(sub int, code int, centroid array<float>)
    codes(list_id int, id long, codes array<smallint>, <metadata>, [embed])

Search probes lists like IVF-flat; inside a bounded cell, a per (query, list)
lookup table ``lut[s][c] = |q_res_s - cb[s][c]|^2`` (``-q_s . cb[s][c]`` for inner product
and cosine) is built in the kernel (never as rows) and distances are sums of table lookups. With ``rerank`` the
top ``k * rerank`` by table distance are re-ranked exactly from ``embed``. The scan finds the rows whose table distance may rank by one
matrix product with the decoded rows, and sums the table's terms of these only; of rows with equal codes it looks at
the k smallest ids. Where ``k * rerank`` covers a list, its table distances cut nothing and all its rows are ranked exactly.
Elsewhere the ``k * rerank`` are those of the whole list, whatever tasks its rows are dealt to: a search by many queries holds the rows in every
task (size-checked) and deals the queries; otherwise the tasks' candidates are merged per (query, list), each with both its distances.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vector import normalize, quantize, resolve_metric
from quiver.operators import expand, ivf, packed
from quiver.operators.knn import DEFAULT_BROADCAST_BYTES, KNN_SCHEMA, _conf_int, _vector_stats, rank_partials, spread
from quiver.operators.topk_kernel import (
    ID_SENTINEL, PAIR_DOUBLES, QUERY_GROUP, ROUNDING, TILE_DOUBLES, TopK, distinct_rows, empty_result, exact, flags_from, row_chunks, topk_indices, vectors_from_arrow)
from quiver.session import ensure_checkpoint_dir, scratch_dir

CODEBOOK_BROADCAST_BYTES = 64 << 20


def sub_slices(vec: str, m: int, dim: int) -> list[Column]:
    if dim % m:
        raise ValueError(f"dimension {dim} is not divisible by m={m}")
    ds = dim // m
    return [F.slice(vec, s * ds + 1, ds) for s in range(m)]


def codebook_from_labels(df: DataFrame, m: int, dim: int, label_col: str = "label", vec_col: str = "embed",
                         digits: int = 6) -> DataFrame:
    """Deterministic codebook: per sub-space, the mean slice per label (rounded)."""
    ds = dim // m
    cells = df.select(F.col(label_col).cast("int").alias("code"), F.posexplode(vec_col).alias("pos", "x"))
    cells = cells.select("code", (F.col("pos") / ds).cast("int").alias("sub"), (F.col("pos") % ds).alias("j"), "x")
    means = cells.groupBy("sub", "code", "j").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("x"))
    return means.groupBy("sub", "code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"].cast("float")).alias("centroid")
    )


def train_codebooks(residuals: DataFrame, m: int, dim: int, bits: int = 8, train_percent: float = 10.0,
                    seed: int = 42, vec_col: str = "embed", iters: int = 20) -> DataFrame:
    """I4 training: k-means in every sub-space, distributed over the rows.

    The sample is ``train_percent`` of the rows, nothing else cuts it. It is
    written once to the shared checkpoint folder; each iteration broadcasts the
    codebook (m x 2^bits x dim/m numbers, size-checked), every task sums its rows per
    (sub-space, code), and the sums are added per sub-space.
    """
    import pyarrow as pa

    spark = residuals.sparkSession
    ncodes, ds = 1 << bits, dim // m
    if m * ncodes * ds * 8 > CODEBOOK_BROADCAST_BYTES:
        raise ValueError("codebook over the broadcast budget")
    frac = min(1.0, train_percent / 100.0)
    sample = residuals.select(vec_col)
    path = scratch_dir(spark, "pq-sample")
    sample = sample.sample(fraction=frac, seed=seed) if frac < 1.0 else sample
    sample.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)  # even files: every iteration reads them on all cores
    sample = spark.read.parquet(path)
    # The first codes are the slices of 2^bits rows in hash order: a bounded read, whatever the sample's size.
    first = sample.orderBy(F.xxhash64(F.col(vec_col), F.lit(seed)), vec_col).limit(ncodes).toArrow().column(vec_col)
    first = vectors_from_arrow(first, dim)
    k = len(first)
    if not k:
        raise ValueError("no rows to train a codebook on")
    C = first.reshape(k, m, ds).transpose(1, 0, 2).copy()

    def sums(book):
        def kernel(batches):
            cb = book.value
            total, count = np.zeros((m, k, ds)), np.zeros((m, k))
            for rb in batches:
                X = vectors_from_arrow(rb.column(0), dim).reshape(-1, m, ds)
                for s, code in enumerate(nearest_codes(X, cb)):
                    np.add.at(total[s], code, X[:, s])
                    count[s] += np.bincount(code, minlength=k)
            if count.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(m), pa.int32()), pa.array([np.column_stack([t, c]).tobytes() for t, c in zip(total, count)], pa.binary())], ["sub", "sums"])

        return kernel

    def add(table):
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"sub": table.column("sub").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    for _ in range(iters):
        book = spark.sparkContext.broadcast(C)
        rows = sample.mapInArrow(sums(book), "sub int, sums binary").groupBy("sub").applyInArrow(add, "sub int, sums binary").collect()
        after = C.copy()
        for r in rows:  # m rows of 2^bits codes
            t = np.frombuffer(r["sums"]).reshape(k, ds + 1)
            used = t[:, -1] > 0
            after[r["sub"], used] = t[used, :-1] / t[used, -1:]
        book.unpersist()
        if np.allclose(after, C, rtol=0, atol=1e-9):
            break
        C = after
    rows = [(s, c, [float(x) for x in C[s, c].astype(np.float32)]) for s in range(m) for c in range(k)]
    return spark.createDataFrame(rows, "sub int, code int, centroid array<float>")


def nearest_codes(X: np.ndarray, CB: np.ndarray):
    """For each sub-space, the nearest code (the smaller of equals) of each row's slice; tiled to TILE_DOUBLES.

    By a product; where its rounding leaves several codes, by their differences.
    """
    m, nc, ds = CB.shape
    tile = max(1, TILE_DOUBLES // (4 * max(1, nc, ds)))
    for s in range(m):
        out = np.empty(len(X), np.int64)
        fit = np.isfinite(CB[s]).all(axis=1)  # codes that the codebook has
        C = np.where(fit[:, None], CB[s], 0.0)
        c2 = np.where(fit, np.einsum("cd,cd->c", C, C), np.inf)
        most = c2[fit].max(initial=0.0)
        for a in range(0, len(X), tile):
            x = X[a:a + tile, s].astype(np.float64, copy=False)
            D = x @ (-2.0 * C.T) + c2
            own = D.argmin(axis=1)
            low = np.take_along_axis(D, own[:, None], axis=1)[:, 0]
            bound = ROUNDING * (ds + 8) * (np.einsum("nd,nd->n", x, x) + most)
            several = np.flatnonzero(~((D <= (low + 2 * bound)[:, None]).sum(axis=1) == 1))  # or not numbers
            step = max(1, tile * 4 // max(1, ds))
            for b in range(0, len(several), step):
                r = several[b:b + step]
                diff = x[r, None, :] - CB[s][None, :, :]
                own[r] = np.einsum("ncd,ncd->nc", diff, diff).argmin(axis=1)
            out[a:a + tile] = own
        yield out


def freeze_codebook(codebook: DataFrame) -> DataFrame:
    """Compute the codebook once (size-checked, m * 2^bits rows) as a local relation."""
    if ivf.is_local(codebook):
        return codebook
    ensure_checkpoint_dir(codebook.sparkSession)
    codebook = codebook.checkpoint(eager=True)  # one pass over the source aggregate
    _codebook_array(codebook)  # raises when over the budget
    spark = codebook.sparkSession
    return ivf.mark_frozen(spark.createDataFrame(codebook.select("sub", "code", "centroid").collect(),
                                                 "sub int, code int, centroid array<float>"))


def _codebook_array(codebook: DataFrame) -> np.ndarray:
    """(m, ncodes, dsub) float64 on the driver; size-checked (m * 2^bits * dsub floats) before collecting."""
    r = codebook.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if (r["n"] or 0) * (r["d"] or 0) * 4 > CODEBOOK_BROADCAST_BYTES:
        raise ValueError("codebook over the broadcast budget")
    t = codebook.select("sub", "code", "centroid").toArrow()
    subs = t.column("sub").to_numpy()
    codes = t.column("code").to_numpy()
    C = vectors_from_arrow(t.column("centroid"))
    m, nc = int(subs.max()) + 1, int(codes.max()) + 1
    if m * nc * C.shape[1] * 4 > CODEBOOK_BROADCAST_BYTES:
        raise ValueError("codebook over the broadcast budget")
    out = np.full((m, nc, C.shape[1]), np.inf)
    out[subs, codes] = C
    return out


def encode(df: DataFrame, codebook: DataFrame, centroids: DataFrame | None = None, vec_col: str = "embed",
           cb_array: np.ndarray | None = None, cen_arrays: tuple | None = None, unit: bool = False) -> DataFrame:
    """I4: append ``codes array<smallint>`` (nearest sub-centroid per slice, ties -> smaller code).

    With ``centroids`` the residual to the row's ``list_id`` centroid is encoded; with ``unit`` that of the vector at unit length.
    """
    spark = df.sparkSession
    CB = cb_array if cb_array is not None else _codebook_array(codebook)
    cen = None
    if centroids is not None:
        cen = cen_arrays if cen_arrays is not None else ivf.centroid_arrays(centroids)
    bc = spark.sparkContext.broadcast((CB, cen))
    names = df.columns
    vi = names.index(vec_col)
    li = names.index("list_id") if centroids is not None else None
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("codes", T.ArrayType(T.ShortType(), False), False)])

    def kernel(batches):
        import pyarrow as pa

        CB_, cen_ = bc.value
        m, nc, ds = CB_.shape
        lookup = None
        if cen_ is not None:
            lookup = dict(zip(cen_[0].tolist(), range(len(cen_[0]))))
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = vectors_from_arrow(rb.column(vi))
            X = expand.unit(X) if unit else X
            if cen_ is not None:
                lids = rb.column(li).to_numpy()
                X = X - cen_[1].astype(np.float64)[[lookup[int(x)] for x in lids]]
            codes = _encode_block(X, CB_)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, m, dtype=np.int32)),
                                           pa.array(codes.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arr], schema=rb.schema.append(pa.field("codes", arr.type, False)))

    return df.mapInArrow(kernel, out_schema)


def _encode_block(X: np.ndarray, CB: np.ndarray) -> np.ndarray:
    m, _, ds = CB.shape
    return np.column_stack(list(nearest_codes(X.reshape(len(X), m, ds), CB)))


@dataclass
class IvfPqIndex:
    coarse: ivf.IvfIndex
    codebook: DataFrame
    m: int
    metric: str = "l2"
    rerank: int = 0
    _cb: np.ndarray | None = field(default=None, repr=False)
    _radii: dict = field(default_factory=dict, repr=False)

    @property
    def codes(self) -> DataFrame:
        return self.coarse.lists

    def radii(self, rerank: int) -> np.ndarray:
        """Per list, the greatest distance from the centroid of what the search ranks: stored vectors, or vectors as coded."""
        if bool(rerank) not in self._radii:
            if rerank:
                found = ivf.stored_radii(self.coarse, "list_radii", expand.vector_offsets(resolve_metric(self.metric)), [self.coarse.vec_col])
            else:
                norms = np.einsum("mcd,mcd->mc", *(np.nan_to_num(self.codebook_array(), posinf=0.0),) * 2)

                def offsets(columns, C):
                    codes = vectors_from_arrow(columns[0]).astype(np.int64)
                    return np.sqrt(sum(norms[s, codes[:, s]] for s in range(len(norms))))

                found = ivf.stored_radii(self.coarse, "code_radii", offsets, ["codes"])
            self._radii[bool(rerank)] = found
        return self._radii[bool(rerank)]

    def codebook_array(self) -> np.ndarray:
        if self._cb is None:
            self._cb = _codebook_array(self.codebook)
        return self._cb

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None,
               n_probes: int | None = None, qvec_col: str = "embed", rerank: int | None = None,
               broadcast_bytes: int | None = None, fill: bool = True) -> DataFrame:
        """Probe lists, table-lookup distances, optional exact re-rank of ``k * rerank``.

        Same two plans as IVF-flat: broadcast queries + one scan of the probed
        lists when they fit the budget, bounded cogroup cells otherwise. With ``fill``, a query that
        a filter leaves under k rows goes on through further lists, as in IVF-flat.
        """
        rr = self.rerank if rerank is None else rerank
        ensure_checkpoint_dir(queries.sparkSession)
        probes = self.coarse.probes(queries, n_probes, qvec_col).checkpoint(eager=True)
        q = queries.select(F.col("qid").cast("long"), F.col(qvec_col).alias("v"))
        run = lambda q, probes: self._partials(q, probes, k, rr, where, flag, broadcast_bytes)
        out = rank_partials(run(q, probes), k)
        if fill and where is not None and flag is None:
            cids, C = self.coarse.centroid_matrix()
            near, probed = self.coarse.nearest(n_probes or self.coarse.n_probes)
            if probed < len(cids):
                out = rank_partials(expand.filled(out.select("qid", "id", "d"), q, k, probed, resolve_metric(self.metric), (cids, C, self.radii(rr)), near, run), k)
        return out.select("qid", "id", "d", "rk", *(["ok"] if flag is not None else []))

    def _partials(self, q: DataFrame, probes: DataFrame, k: int, rr: int, where: Column | None, flag: Column | None,
                  broadcast_bytes: int | None) -> DataFrame:
        """Partial top-k ``(qid, id, d[, ok])`` of the pairs ``probes(qid, list_id)``."""
        rows = ivf.prune_lists(self.codes, probes)
        rows = rows if where is None else rows.where(where)
        cols = [F.col("list_id"), F.col("id"), F.col("codes")]
        if rr:
            cols.append(F.col(self.coarse.vec_col).alias("x"))
        if flag is not None:
            cols.append(F.coalesce(flag, F.lit(False)).alias("ok"))
        rows = rows.select(*cols)
        spark = rows.sparkSession
        cids, C = self.coarse.centroid_matrix()
        by_id = np.argsort(cids)
        bc = spark.sparkContext.broadcast((self.codebook_array(), cids[by_id], C[by_id].astype(np.float64)))
        m = self.metric
        if rr and k * rr < (self.coarse.list_sizes.agg(F.max("n")).first()[0] or 0):
            return self._reranked(rows, q, probes, k, k * rr, flag is not None, broadcast_bytes, bc)

        def factory(with_flag):
            def cell(ct, qt):
                import pyarrow as pa

                if ct.num_rows == 0 or qt.num_rows == 0:
                    return empty_result(with_flag)
                CB_, cids_, C_ = bc.value
                cen = C_[np.searchsorted(cids_, int(qt.column("list_id")[0].as_py()))]
                X = vectors_from_arrow(ct.column("x")) if rr else None
                Dk, Ik, pos = pq_candidates(vectors_from_arrow(qt.column("v")), cen,
                                            vectors_from_arrow(ct.column("codes")).astype(np.int64),
                                            ct.column("id").to_numpy().astype(np.int64), CB_, k, rr, X, m)
                d = Dk.ravel()
                out = {"qid": np.repeat(qt.column("qid").to_numpy().astype(np.int64), Dk.shape[1]), "id": Ik.ravel(),
                       "d": pa.array(d, pa.float64(), mask=~np.isfinite(d))}
                if with_flag:
                    out["ok"] = flags_from(ct)[pos].ravel()
                return pa.table(out)

            return cell

        with_flag = flag is not None

        def kernel_for(bplan):
            def kernel(batches):
                CB_, cids_, C_ = bc.value
                pl = bplan.value
                qids_, Q_ = pl[0], pl[1]
                for t in row_chunks(batches, Q_.shape[1]):
                    order = np.argsort(t.column("list_id").to_numpy(), kind="stable")
                    lids, ids = t.column("list_id").to_numpy()[order], t.column("id").to_numpy()[order]
                    codes = vectors_from_arrow(t.column("codes")).astype(np.int16)[order]
                    X = vectors_from_arrow(t.column("x"), stored=True)[order] if rr else None
                    flags = flags_from(t)[order] if with_flag else np.ones(len(ids), dtype=bool)
                    lists = []
                    for own in [] if rr else ivf.by_list(lids):  # rows coded alike are equally far: the k smallest ids of a code are all that can rank
                        own = own[distinct_rows(ids[own], codes[own], k)]
                        lists.append((int(lids[own[0]]), own))
                    for a in range(0, len(qids_), QUERY_GROUP):  # the state held is a group's, whatever the query set
                        Q = Q_[a:a + QUERY_GROUP].astype(np.float64)
                        zero = ~Q.any(axis=1)
                        shifted = m == "cosine" and not rr  # 1 - q'.c: ranked by the product with the query at unit length
                        top = TopK(qids_[a:a + QUERY_GROUP], expand.unit(Q) if shifted else Q, k, "ip" if shifted else m)
                        for own, sel in ivf.list_runs(pl, lids, a, a + QUERY_GROUP) if rr else []:  # no candidate is cut by its table distance
                            top.add(ids[own], X[own], flags[own], sel)
                        for lid, own in lists:
                            sel = ivf.list_queries(pl, lid, a, a + QUERY_GROUP) - a
                            if len(sel) == 0:
                                continue
                            cen = C_[np.searchsorted(cids_, lid)]
                            R = decoded(codes[own], CB_)
                            norms = np.sqrt(np.einsum("nd,nd->n", R, R)) + np.sqrt(cen @ cen)
                            top.add(ids[own], cen + R, flags[own], sel, coded_distances(top.metric, top.Q, cen, R, len(CB_)), norms)
                        if shifted:
                            top.best_d += 1.0
                            top.best_d[zero] = np.inf
                        if top.seen.any():
                            yield top.result(with_flag=with_flag)

            return kernel

        partials = ivf.scan_partials(spread(rows), q, probes, k, broadcast_bytes, kernel_for,
                                     KNN_SCHEMA + (", ok boolean" if with_flag else ""))
        if partials is None:
            partials = ivf.cell_search(rows, q, probes, self.coarse.list_sizes, k, m, with_flag,
                                       _conf_int(spark, "quiver.knn.blockBytes", ivf.DEFAULT_BLOCK_BYTES),
                                       kernel_factory=factory, n_lists=len(cids))
        return partials

    def _reranked(self, rows: DataFrame, q: DataFrame, probes: DataFrame, k: int, keep: int, with_flag: bool, broadcast_bytes: int | None, bc) -> DataFrame:
        """Partial top-k by exact distance among the ``keep`` nearest by table distance of each (query, list), as a whole list has them.

        ``rows(list_id, id, codes, x[, ok])``. Where every task reads less by holding the rows than it would send as candidates, and they are
        within the budget, the queries are dealt to the tasks and nothing else moves; else the rows are scanned, or cut into cells.
        """
        spark, m = rows.sparkSession, self.metric
        budget = broadcast_bytes or _conf_int(spark, "quiver.knn.broadcastBytes", DEFAULT_BROADCAST_BYTES)
        n, dim = _vector_stats(rows, "x")
        nq = q.count()
        size = n * (max(dim, 1) * 4 + self.m * 2 + 13)
        if size <= budget and size <= nq * keep * 40:
            if q.select("qid").distinct().count() < nq:
                raise ValueError("query ids repeat")
            return _replicated_rerank(rows, q, probes, k, keep, m, with_flag, size, bc)
        fields = [("qid", "q"), ("list_id", "l"), ("id", "i"), ("a", "a"), ("d", "d"), *([("ok", "f")] if with_flag else [])]

        def found(qids, Q, lid, ids, codes, X, flags):
            """Both distances of the candidates that these rows of a list hold."""
            import pyarrow as pa

            CB_, cids_, C_ = bc.value
            own = distinct_by_id(ids, codes, keep)
            A, pos = coded_candidates(m, Q, keep, C_[np.searchsorted(cids_, lid)], codes[own], CB_)
            D = exact_at(m, Q, X, pos, own)
            valid = pos != ID_SENTINEL
            at = own[pos[valid]]
            a, d = A[valid], D[valid]
            values = {"q": pa.array(np.repeat(qids, valid.sum(axis=1)).astype(np.int64)), "l": pa.array(np.full(len(at), lid, np.int32)), "i": pa.array(ids[at].astype(np.int64)),
                      "a": pa.array(a), "d": pa.array(d, pa.float64(), mask=~np.isfinite(d)), "f": pa.array(flags[at]) if with_flag else None}
            return pa.RecordBatch.from_arrays([values[v] for _, v in fields], [c for c, _ in fields])

        def kernel_for(bplan):
            def kernel(batches):
                pl = bplan.value
                qids, Q = pl[0], pl[1]
                for t in row_chunks(batches, Q.shape[1]):
                    lids, ids = t.column("list_id").to_numpy(), t.column("id").to_numpy()
                    codes, X = vectors_from_arrow(t.column("codes")).astype(np.int16), vectors_from_arrow(t.column("x"), stored=True)
                    flags = flags_from(t) if with_flag else None
                    for own in ivf.by_list(lids):
                        lid = int(lids[own[0]])
                        rows_ = (ids[own], codes[own], X[own], flags[own] if with_flag else None)
                        for a in range(0, len(qids), QUERY_GROUP):  # the state held is a group's, whatever the query set
                            sel = ivf.list_queries(pl, lid, a, a + QUERY_GROUP)
                            if len(sel):
                                yield found(qids[sel], Q[sel].astype(np.float64), lid, *rows_)

            return kernel

        def factory(with_flag):
            def cell(ct, qt):
                import pyarrow as pa

                if ct.num_rows == 0 or qt.num_rows == 0:
                    return empty.empty_table()
                return pa.Table.from_batches([found(qt.column("qid").to_numpy(), vectors_from_arrow(qt.column("v")), int(qt.column("list_id")[0].as_py()), ct.column("id").to_numpy(),
                                                    vectors_from_arrow(ct.column("codes")).astype(np.int16), vectors_from_arrow(ct.column("x"), stored=True), flags_from(ct) if with_flag else None)])

            return cell

        schema = "qid long, list_id int, id long, a double, d double" + (", ok boolean" if with_flag else "")
        empty = _arrow_schema(with_flag)
        partials = ivf.scan_partials(spread(rows), q, probes, keep, broadcast_bytes, kernel_for, schema)
        if partials is None:
            partials = ivf.cell_search(rows, q, probes, self.coarse.list_sizes, keep, m, with_flag, _conf_int(spark, "quiver.knn.blockBytes", ivf.DEFAULT_BLOCK_BYTES),
                                       kernel_factory=factory, n_lists=len(self.coarse.centroid_matrix()[0]), schema=schema)
        w = Window.partitionBy("qid", "list_id").orderBy("a", "id")
        return partials.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("list_id", "a", "place")


def _arrow_schema(with_flag: bool):
    import pyarrow as pa

    kinds = [("qid", pa.int64()), ("list_id", pa.int32()), ("id", pa.int64()), ("a", pa.float64()), ("d", pa.float64())]
    return pa.schema(kinds + ([("ok", pa.bool_())] if with_flag else []))


def _replicated_rerank(rows: DataFrame, q: DataFrame, probes: DataFrame, k: int, keep: int, m: str, with_flag: bool, size: int, bc) -> DataFrame:
    """The search of :meth:`IvfPqIndex._reranked` with the rows in every task and the queries dealt to all cores."""

    def pack(rb):
        at = {c: rb.column(i) for i, c in enumerate(rb.schema.names)}
        return {"list_id": at["list_id"].to_numpy().astype("<i4"), "id": at["id"].to_numpy().astype("<i8"), "codes": vectors_from_arrow(at["codes"]).astype("<i2"),
                "x": vectors_from_arrow(at["x"], stored=True).astype("<f4"), "ok": flags_from(rb).astype("<i1") if with_flag else None}

    fields = ["list_id", "id", "codes", "x", *(["ok"] if with_flag else [])]
    path = packed.write_packed(rows, ["list_id", "id"], "pq-rows", pack, fields, size)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    own_lists = probes.groupBy("qid").agg(F.collect_list("list_id").alias("lists"))
    dealt = q.join(own_lists, "qid").select("qid", "v", "lists").repartition(2 * cores, "qid")

    def kernel(batches):
        CB, cids, C = bc.value
        held = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            Q = vectors_from_arrow(rb.column(1)).astype(np.float64)
            if held is None:
                held = _read_rows(path, keep, with_flag)
            ids, codes, X, flags, lists = held
            lids, of = rb.column(2).flatten().to_numpy(), np.repeat(np.arange(rb.num_rows), np.diff(rb.column(2).offsets.to_numpy()))
            top = TopK(rb.column(0).to_numpy().astype(np.int64), Q, k, m)
            for lid, own in lists:
                sel = of[lids == lid]
                if len(sel):
                    _, pos = coded_candidates(m, Q[sel], keep, C[np.searchsorted(cids, lid)], codes[own], CB)
                    D = exact_at(m, Q[sel], X, pos, own)
                    at = own[np.where(pos == ID_SENTINEL, 0, pos)]
                    top.merge(sel, D, np.where(pos == ID_SENTINEL, ID_SENTINEL, ids[at]), flags[at] if with_flag else np.ones(pos.shape, dtype=bool))
            yield top.result(with_flag=with_flag)

    return dealt.mapInArrow(kernel, KNN_SCHEMA + (", ok boolean" if with_flag else ""))


def _read_rows(path: str, keep: int, with_flag: bool):
    """Ids, codes, vectors and flags of the packed rows, and per list the positions of those that can be candidates, by id."""
    lids, ids = packed.column(path, "list_id", "<i4").ravel(), packed.column(path, "id", "<i8").ravel()
    codes, flags = packed.column(path, "codes", "<i2"), packed.column(path, "ok", "<i1").ravel().astype(bool) if with_flag else None
    lists = [(int(lids[own[0]]), own[distinct_by_id(ids[own], codes[own], keep)]) for own in ivf.by_list(lids)] if len(lids) else []
    return ids, codes, packed.column(path, "x", "<f4"), flags, lists


def distinct_by_id(ids: np.ndarray, codes: np.ndarray, keep: int) -> np.ndarray:
    """Positions, in the order of ids, of the rows that can be among the ``keep`` nearest by table distance: rows coded alike are equally far."""
    own = distinct_rows(ids, codes, keep)
    return own[np.argsort(ids[own], kind="stable")]


def coded_candidates(metric: str, Q: np.ndarray, keep: int, cen: np.ndarray, codes: np.ndarray, CB: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` rows of one list nearest to each query by table distance (the earlier of equals): distances and positions, ID_SENTINEL where there are fewer."""
    shifted = metric == "cosine"  # 1 - q'.c: ranked by the product with the query at unit length
    top = TopK(np.arange(len(Q)), expand.unit(Q) if shifted else Q, keep, "ip" if shifted else metric)
    step = max(1, TILE_DOUBLES // (4 * max(1, Q.shape[1])))  # rows decoded at once
    for a in range(0, len(codes), step):
        R = decoded(codes[a:a + step], CB)
        norms = np.sqrt(np.einsum("nd,nd->n", R, R)) + np.sqrt(cen @ cen)
        top.add(np.arange(a, a + len(R)), cen + R, None, None, coded_distances(top.metric, top.Q, cen, R, len(CB)), norms)
    return top.best_d, top.best_i


def exact_at(metric: str, Q: np.ndarray, X: np.ndarray, pos: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact distances of each query to its rows ``X[own[pos]]``; infinite where there is no row or no distance."""
    D = np.full(pos.shape, np.inf)
    step = max(1, PAIR_DOUBLES // max(1, pos.shape[1] * X.shape[1]))
    if len(own):
        for a in range(0, len(Q), step):
            at = np.where(pos[a:a + step] == ID_SENTINEL, 0, pos[a:a + step])
            D[a:a + step] = exact(metric, Q[a:a + step], X[own[at]].astype(np.float64))
    return np.where((pos == ID_SENTINEL) | np.isnan(D), np.inf, D)


def save_ivfpq(idx: IvfPqIndex, path: str) -> IvfPqIndex:
    """Codes as IVF lists, plus the codebook and PQ parameters in meta.json."""
    p = path.rstrip("/")
    idx.codebook.write.mode("overwrite").parquet(f"{p}/codebook")
    coarse = ivf.save_ivf(idx.coarse, p, kind="ivfpq", extra_meta={"m": idx.m, "rerank": idx.rerank, "shards": idx.coarse.shards})
    return IvfPqIndex(coarse, idx.codebook.sparkSession.read.parquet(f"{p}/codebook"), idx.m, idx.metric, idx.rerank)


def load_ivfpq(spark, path: str, n_probes: int | None = None) -> IvfPqIndex:
    coarse = ivf.load_ivf(spark, path, n_probes)
    return IvfPqIndex(coarse, spark.read.parquet(f"{path.rstrip('/')}/codebook"), int(coarse.meta["m"]), coarse.metric,
                      int(coarse.meta.get("rerank", 0)))


def decoded(codes: np.ndarray, CB: np.ndarray) -> np.ndarray:
    """What the codes stand for: each row's residual, put together from its sub-centroids."""
    return np.concatenate([CB[s][codes[:, s]] for s in range(len(CB))], axis=1)


def coded_distances(metric: str, Q: np.ndarray, cen: np.ndarray, R: np.ndarray, m: int):
    """A function of (query rows, row positions): :func:`table_distances` of these pairs, where ``R`` has the decoded residuals."""
    ds = Q.shape[1] // m

    def score(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if metric in ("l2", "l2sq"):
            diff = ((Q[i] - cen) - R[j]).reshape(-1, m, ds)
            parts = np.einsum("pmd,pmd->pm", diff, diff)
            D = np.zeros(len(i))
        else:
            parts = -np.einsum("pmd,pmd->pm", Q[i].reshape(-1, m, ds), R[j].reshape(-1, m, ds))
            D = -np.einsum("pd,d->p", Q[i], cen)
        for s in range(m):  # added in one order, so that equal codes are equally far
            D = D + parts[:, s]
        return np.sqrt(D) if metric == "l2" else D

    return score


def pq_candidates(Q: np.ndarray, cen: np.ndarray, codes: np.ndarray, ids: np.ndarray, CB: np.ndarray, k: int,
                  rerank: int, X: np.ndarray | None, metric: str):
    """Top-k of queries ``Q`` among rows of one list: (distances, ids, row positions), each (nq, <=k).

    Candidates by table-lookup distance (tie-aware); with ``rerank`` the top
    ``k * rerank`` are re-ranked by exact distance from ``X``. Queries are taken in tiles, so that
    no matrix of a tile (distances, lookup tables, re-ranked rows) is over TILE_DOUBLES.
    """
    keep = min(len(ids), k * rerank if rerank else k)
    widest = max(len(ids), CB[0].size, keep * (X.shape[1] if rerank else 1), 1)
    tile = max(1, TILE_DOUBLES // widest)
    parts = []
    for a in range(0, len(Q), tile):
        q = Q[a:a + tile]
        D = table_distances(metric, q, cen, codes, CB)
        cand = topk_indices(D, keep, ids)
        Dc = exact("l2sq" if metric == "l2" else metric, q, X[cand]) if rerank else np.take_along_axis(D, cand, axis=1)
        Ic = ids[cand]
        order = np.lexsort((Ic, Dc), axis=1)[:, :k]
        Dk = np.take_along_axis(Dc, order, axis=1)
        if metric == "l2":
            Dk = np.sqrt(np.maximum(Dk, 0.0))
        parts.append((Dk, np.take_along_axis(Ic, order, axis=1), np.take_along_axis(cand, order, axis=1)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def table_distances(metric: str, Q: np.ndarray, cen: np.ndarray, codes: np.ndarray, CB: np.ndarray) -> np.ndarray:
    """Distances (squared for l2) of each query to each vector as coded in a list with centroid ``cen``; infinite for cosine of a zero query."""
    if metric in ("l2", "l2sq"):
        return adc_distances(Q - cen, codes, CB)
    m, nc, ds = CB.shape
    unit = expand.unit(Q) if metric == "cosine" else Q
    parts = unit.reshape(len(Q), m, ds)
    D = np.repeat(-(unit @ cen)[:, None], len(codes), axis=1)
    for s in range(m):
        D -= (parts[:, s] @ CB[s].T)[:, codes[:, s]]  # (nq, ncodes), built per cell, never as rows
    if metric == "cosine":
        D += 1.0
        D[~Q.any(axis=1)] = np.inf
    return D


def adc_distances(Qres: np.ndarray, codes: np.ndarray, CB: np.ndarray) -> np.ndarray:
    """Squared distances of each residual query to each encoded row: sum_s lut[q, s, codes[:, s]]."""
    m, nc, ds = CB.shape
    Qs = Qres.reshape(len(Qres), m, ds)
    D = np.zeros((len(Qres), len(codes)))
    for s in range(m):
        diff = Qs[:, s, None, :] - CB[s][None, :, :]
        lut = np.einsum("qcd,qcd->qc", diff, diff)  # (nq, ncodes), built per cell, never as rows
        D += lut[:, codes[:, s]]
    return D


def build_ivfpq(df: DataFrame, m: int, dim: int, *, lists: int | None = None, bits: int = 8, metric: str = "l2",
                centroids: DataFrame | None = None, codebook: DataFrame | None = None, train_percent: float = 10.0,
                n_probes: int = 1, rerank: int = 0, seed: int = 42, keep_vectors: bool | None = None,
                vec_col: str = "embed", shards: int = 1, shard: Column | None = None) -> IvfPqIndex:
    """I4: coarse IVF + PQ codes of residuals. ``lists=1`` with a zero centroid is plain PQ.

    ``shards``: as in :func:`quiver.operators.ivf.build_ivf`, independent lists per shard; the codebook is one.
    """
    mt = resolve_metric(metric)
    spark = df.sparkSession
    if centroids is None and lists == 1:
        centroids = spark.createDataFrame([(0, [0.0] * dim)], "list_id int, centroid array<float>")
    centroids, assigned, cen = ivf.assigned_lists(df, lists, mt, centroids, train_percent, seed, vec_col, shards, shard)
    if codebook is not None:
        codebook = freeze_codebook(codebook)
    if codebook is None:
        # Residuals of a training sample, JVM-side: the centroid table is bounded
        # by the list count and broadcast into the join.
        frac = min(1.0, train_percent / 100.0)
        smp = assigned.sample(fraction=frac, seed=seed) if frac < 1.0 else assigned
        cen_df = F.broadcast(centroids) if ivf.is_local(centroids) else centroids
        scaled = normalize(vec_col) if mt == "cosine" else F.col(vec_col)
        res = smp.join(cen_df, "list_id").select(
            F.zip_with(scaled, "centroid", lambda x, c: (x - c).cast("float")).alias(vec_col))
        codebook = freeze_codebook(train_codebooks(res, m, dim, bits, 100.0, seed, vec_col))
    cb_arr = _codebook_array(codebook)
    coded = encode(assigned, codebook, centroids, vec_col, cb_array=cb_arr, cen_arrays=cen, unit=mt == "cosine")
    if keep_vectors is False or (keep_vectors is None and not rerank):
        coded = coded.drop(vec_col)
    # Written by list like an IVF index: searches prune lists and columns at the scan.
    coarse = ivf.IvfIndex(centroids, coded, coded.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")), mt, n_probes, vec_col)
    coarse = ivf.save_ivf(coarse, scratch_dir(spark, "ivfpq"), kind="ivfpq", extra_meta={"m": m, "rerank": rerank, "shards": shards})
    coarse._cen = cen
    return IvfPqIndex(coarse, codebook, m, mt, rerank, _cb=cb_arr)


# -- V8: scalar quantization of a whole table -----------------------------------------


def quantize_table(df: DataFrame, qtype: str, vec_col: str = "embed") -> DataFrame:
    """V8: global min/max (one aggregate, two numbers to the driver), then per-element affine codes."""
    q = qtype.lower()
    if q in ("int8", "uint8"):
        r = df.agg(F.min(F.array_min(vec_col)).alias("lo"), F.max(F.array_max(vec_col)).alias("hi")).first()
        lo, hi = float(r["lo"]), float(r["hi"])
        return df.withColumn(vec_col, quantize(vec_col, F.lit(lo), F.lit(hi), q))
    return df.withColumn(vec_col, quantize(vec_col, F.lit(0.0), F.lit(0.0), q))
