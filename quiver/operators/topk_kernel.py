"""Numpy top-k block kernel used inside Spark tasks (mapInArrow / applyInPandas).

Given a block of queries and a block of corpus rows it keeps, per query, the
k nearest rows seen so far. Distances are chosen with a BLAS product (in single
precision where the numbers allow) and the survivors are recomputed exactly (difference form, double precision), so the
emitted distances do not depend on the block layout. A survivor is every row whose
product-form value lies within that form's rounding bound of the k-th, so close
vectors are never cut by rounding. Only k rows per query per
task leave the kernel; no (query, row) pair is ever materialised as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ID_SENTINEL = np.iinfo(np.int64).max
# Cap on the doubles held by one distance tile (rows x queries): 32 MiB.
TILE_DOUBLES = 1 << 22
# Doubles of the rows gathered at once to be scored: what a core's cache holds.
PAIR_DOUBLES = 1 << 16
# Queries and rows of one product.
QUERIES, COLUMNS = 256, 2048
# Float bytes of a task's rows held at once, and queries whose top-k is held with them.
CHUNK_BYTES, QUERY_GROUP = 32 << 20, 1 << 14
# Queries with more candidates above k in a block are merged apart from the others.
EXTRA = 16
# Rounding of the product form, in units of dim * machine epsilon * magnitude.
ROUNDING, ROUNDING_SINGLE = 4 * np.finfo(np.float64).eps, 4 * np.finfo(np.float32).eps
# Norms under which no product in single precision overflows, and what one may lose by underflow.
LARGE, TINY = 1e18, 4 * float(np.finfo(np.float32).tiny)


def vectors_from_arrow(col: pa.Array | pa.ChunkedArray, dim: int | None = None, stored: bool = False) -> np.ndarray:
    """``list<float>`` Arrow column -> (n, dim) float64 matrix; raises on NULL or ragged rows.

    ``stored``: floats stay in single precision, as a view of the column.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    if col.null_count:
        raise ValueError("NULL vector in input")
    offsets = col.offsets.to_numpy()
    sizes = np.diff(offsets)
    d = int(sizes[0]) if dim is None else dim
    if (sizes != d).any():
        bad = int(sizes[sizes != d][0])
        raise ValueError(f"vector dimension mismatch: expected {d}, got {bad}")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if stored and flat.dtype == np.float32:
        return flat.reshape(n, d)
    return flat.astype(np.float64, copy=False).reshape(n, d)


class Columns:
    """A block of rows, made ready for product-form distances to many queries."""

    def __init__(self, metric: str, X: np.ndarray, norms: np.ndarray | None = None):
        """``norms``: bounds of the rows' norms, where the rows are sums whose parts are longer than they are."""
        self.metric, self.X = metric, X
        xn = np.sqrt(np.einsum("nd,nd->n", X, X))
        fit = np.isfinite(xn)
        self.far = float(np.max((xn if norms is None else norms)[fit], initial=0.0))
        if metric in ("l2", "l2sq"):
            # Shifting both sides by the rows' mean leaves differences alone and shrinks the magnitudes that cancel.
            self.mean = X[fit].mean(axis=0) if fit.any() else np.zeros(X.shape[1])
            Xs = X - self.mean
            x2 = np.einsum("nd,nd->n", Xs, Xs)
            self.most = float(np.max(x2[fit], initial=0.0))
            self.rows = np.column_stack([Xs, x2])
        elif metric == "cosine":
            self.zero = xn == 0
            self.rows = X / np.where(self.zero, 1.0, xn)[:, None]
        else:
            self.rows = X
        self.small = self.rows.astype(np.float32) if fit.all() and self.far < LARGE else None

    def distances(self, Q: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Product-form distances (squared for l2) less ``base``, ``base`` and a bound on their rounding error, the last two per query."""
        single = self.small is not None and bool((qn < LARGE).all())
        rows, kind = (self.small, np.float32) if single else (self.rows, np.float64)
        unit = (ROUNDING_SINGLE if single else ROUNDING) * (Q.shape[1] + 8)
        lost = TINY * (Q.shape[1] + 8) * (1 + qn + self.far) if single else 0.0
        if self.metric in ("l2", "l2sq"):
            Qs = Q - self.mean
            q2 = np.einsum("qd,qd->q", Qs, Qs)
            shift = ROUNDING * (qn + self.far) * (np.sqrt(q2) + np.sqrt(self.most))  # the shift itself rounds
            sides = np.column_stack([-2.0 * Qs, np.ones(len(Q))]).astype(kind, copy=False)
            return sides @ rows.T, q2, unit * (q2 + self.most) + 4 * shift + lost
        if self.metric == "ip":
            return (-Q).astype(kind, copy=False) @ rows.T, np.zeros(len(Q)), unit * qn * self.far + lost
        D = (-Q / np.where(qn == 0, 1.0, qn)[:, None]).astype(kind, copy=False) @ rows.T
        D[:, self.zero] = np.inf
        D[qn == 0] = np.inf
        return D, np.ones(len(Q)), np.full(len(Q), unit) + lost


def within(D: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that are not over their row's limit, rows ascending; what isn't a number is one of them."""
    if not D.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.flatnonzero(~(D.min(axis=1) > limit))  # most rows have none
    part = D if len(near) == len(D) else D[near]
    with np.errstate(over="ignore"):
        limit = np.nextafter(limit[near].astype(D.dtype), np.inf, dtype=D.dtype)  # compared in the entries' own precision
    hit = ~(part > limit[:, None])
    eights = hit.reshape(-1, 8) if D.shape[1] % 8 == 0 else hit.reshape(-1, 1)  # looked through by eights, as few are set
    some = np.flatnonzero(eights.view(np.uint64 if eights.shape[1] == 8 else np.uint8))
    i, j = np.divmod(np.flatnonzero(eights[some]), eights.shape[1])
    r, c = np.divmod(some[i] * eights.shape[1] + j, D.shape[1])
    return near[r], c


def exact(metric: str, Q: np.ndarray, Xc: np.ndarray) -> np.ndarray:
    """Exact distances of Q[i] to each row of Xc[i] (shape (nq, kk, dim))."""
    if metric in ("l2", "l2sq"):
        diff = Xc - Q[:, None, :]
        d2 = np.einsum("qkd,qkd->qk", diff, diff)
        return np.sqrt(d2) if metric == "l2" else d2
    dots = np.einsum("qkd,qd->qk", Xc, Q)
    if metric == "ip":
        return -dots
    qn = np.sqrt(np.einsum("qd,qd->q", Q, Q))
    xn = np.sqrt(np.einsum("qkd,qkd->qk", Xc, Xc))
    den = qn[:, None] * xn
    with np.errstate(divide="ignore", invalid="ignore"):
        D = 1.0 - dots / den
    D[den == 0] = np.inf
    return D


def topk_indices(D: np.ndarray, keep: int, ids: np.ndarray) -> np.ndarray:
    """Column indices of the ``keep`` smallest entries per row, ordered by (D, id) at the boundary.

    ``argpartition`` alone may cut a run of equal values arbitrarily; rows
    where the boundary splits ties are redone exactly (rare).
    """
    nq, n = D.shape
    if keep >= n:
        return np.broadcast_to(np.arange(n), (nq, n)).copy()
    part = np.argpartition(D, keep - 1, axis=1)[:, :keep]
    vals = np.take_along_axis(D, part, axis=1)
    kth = vals.max(axis=1)
    split = (D == kth[:, None]).sum(axis=1) > (vals == kth[:, None]).sum(axis=1)
    for r in np.nonzero(split)[0]:
        cand = np.nonzero(D[r] <= kth[r])[0]
        part[r] = cand[np.lexsort((ids[cand], D[r, cand]))[:keep]]
    return part


def empty_result(with_flag: bool = False) -> pa.Table:
    cols = {"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())}
    if with_flag:
        cols["ok"] = pa.array([], pa.bool_())
    return pa.table(cols)


def flags_from(t: pa.Table, name: str = "ok") -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False).astype(bool)


def distinct_rows(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that can rank under ``k``: of equal ``rows``, the k with the smallest ids."""
    rows = np.ascontiguousarray(rows)
    _, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    count = np.bincount(same)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(order[place < k])


def row_chunks(batches, dim: int):
    """A task's Arrow batches joined to tables of at most CHUNK_BYTES of float vectors."""
    most = max(1, CHUNK_BYTES // (4 * max(1, dim)))
    held, n = [], 0

    def joined() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()  # not held beside the table
        return t

    for rb in batches:
        for a in range(0, rb.num_rows, most):
            part = rb.slice(a, most)
            if n + part.num_rows > most:
                yield joined()
                n = 0
            held.append(part)
            n += part.num_rows
    if n:
        yield joined()


class TopK:
    """Running per-query top-k over blocks of corpus rows.

    Queries and rows may be in single precision; a tile of them at a time is taken to doubles.
    """

    def __init__(self, qids: np.ndarray, Q: np.ndarray, k: int, metric: str):
        self.qids = qids
        self.Q = Q
        self.qn = np.sqrt(np.einsum("qd,qd->q", Q, Q, dtype=np.float64)) if len(Q) else np.zeros(0)
        self.k = k
        self.metric = metric
        nq = len(qids)
        self.best_d = np.full((nq, k), np.inf)
        self.best_i = np.full((nq, k), ID_SENTINEL, dtype=np.int64)
        self.best_f = np.zeros((nq, k), dtype=bool)
        self.seen = np.zeros(nq, dtype=np.int64)
        self.reach = 0.0  # greatest norm of the rows seen

    def add(self, ids: np.ndarray, X: np.ndarray, flags: np.ndarray | None = None,
            qidx: np.ndarray | None = None, score=None, norms: np.ndarray | None = None) -> None:
        """Merge rows ``(ids, X)`` into the top-k of all queries, or of the queries ``qidx`` only.

        A row is scored only if its product-form distance may be under the query's k-th so far.
        ``score(query rows, row positions)``: the distances that count, by default the exact ones; they must be those of ``X`` but for
        rounding, for which ``norms`` bounds the parts that a row is the sum of.
        """
        n = len(ids)
        sel = np.arange(len(self.qids)) if qidx is None else np.asarray(qidx)
        if n == 0 or len(sel) == 0:
            return
        if X.shape[1] != self.Q.shape[1]:
            raise ValueError(f"vector dimension mismatch: queries {self.Q.shape[1]}, rows {X.shape[1]}")
        if flags is None:
            flags = np.ones(n, dtype=bool)
        dim = X.shape[1]
        edges = np.linspace(0, n, -(-n // COLUMNS) + 1).astype(int).tolist()  # even blocks
        for a, b in zip(edges, edges[1:]):
            own = slice(a, b)
            block = Columns(self.metric, X[own].astype(np.float64, copy=False), None if norms is None else norms[own])
            self.reach = max(self.reach, block.far)
            for s in range(0, len(sel), QUERIES):
                rows = sel[s:s + QUERIES]
                Qt, qn = self.Q[rows].astype(np.float64, copy=False), self.qn[rows]
                D, base, bound = block.distances(Qt, qn)
                kth = self.best_d[rows, -1]
                kth = kth * kth if self.metric == "l2" else kth
                limit = kth + ROUNDING * (dim + 8) * np.abs(kth) + 2 * bound - base
                free = np.isinf(kth)  # under k rows so far
                if free.any() and D.shape[1] >= self.k:
                    limit[free] = np.partition(D[free], self.k - 1, axis=1)[:, self.k - 1] + 2 * bound[free]
                r, c = within(D, limit)
                if len(r):
                    self._score(rows, Qt, block.X, ids[own], flags[own], r, c, score and (lambda i, j, a=a: score(i, j + a)))
        self.seen[sel] += n

    def _score(self, rows, Q, X, ids, flags, r, c, score) -> None:
        """Distances of the pairs (query ``rows[r]``, row ``c``), merged; ``r`` ascends."""
        d = np.empty(len(r))
        step = max(1, PAIR_DOUBLES // max(1, X.shape[1]))
        for p in range(0, len(r), step):
            i, j = r[p:p + step], c[p:p + step]
            d[p:p + step] = exact(self.metric, Q[i], X[j][:, None, :])[:, 0] if score is None else score(rows[i], j)
        d = np.where(np.isnan(d), np.inf, d)
        count = np.bincount(r, minlength=len(rows))
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        few = count <= self.k + EXTRA
        for some in (few & (count > 0), ~few):  # those with many candidates are padded among themselves
            if not some.any():
                continue
            at = np.cumsum(some) - 1
            pair = some[r]
            shape = (int(some.sum()), int(count[some].max()))
            pd, pi, pf = np.full(shape, np.inf), np.full(shape, ID_SENTINEL, dtype=np.int64), np.zeros(shape, dtype=bool)
            to = (at[r[pair]], place[pair])
            pd[to], pi[to], pf[to] = d[pair], ids[c[pair]], flags[c[pair]]
            self.merge(rows[some], pd, pi, pf)

    def merge(self, rows: np.ndarray, d: np.ndarray, i: np.ndarray, f: np.ndarray) -> None:
        """Merge candidate (distance, id, flag) matrices into the top-k of query rows ``rows``."""
        cd = np.concatenate([self.best_d[rows], d], axis=1)
        ci = np.concatenate([self.best_i[rows], i], axis=1)
        cf = np.concatenate([self.best_f[rows], f], axis=1)
        order = np.lexsort((ci, cd), axis=1)[:, : self.k]
        self.best_d[rows] = np.take_along_axis(cd, order, axis=1)
        self.best_i[rows] = np.take_along_axis(ci, order, axis=1)
        self.best_f[rows] = np.take_along_axis(cf, order, axis=1)

    def result(self, with_rank: bool = False, with_flag: bool = False, limit: np.ndarray | None = None) -> pa.RecordBatch:
        """The rows kept; with ``limit`` (a distance per query, inf for none) only those not beyond it."""
        valid = self.best_i != ID_SENTINEL  # queries that saw no row emit nothing
        if limit is not None:
            slack = 1e-9 * np.abs(limit) + 1e-10 * self.qn * self.reach + 1e-12  # above the rounding of a distance
            valid &= self.best_d <= (limit + slack)[:, None]
        q = np.broadcast_to(self.qids[:, None], self.best_i.shape)[valid]
        i = self.best_i[valid]
        d = self.best_d[valid]
        cols = {
            "qid": pa.array(q, pa.int64()),
            "id": pa.array(i, pa.int64()),
            "d": pa.array(d, pa.float64(), mask=~np.isfinite(d)),
        }
        if with_rank:
            rk = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32)[None, :], self.best_i.shape)[valid]
            cols["rk"] = pa.array(rk, pa.int32())
        if with_flag:
            cols["ok"] = pa.array(self.best_f[valid], pa.bool_())
        return pa.RecordBatch.from_pydict(cols)
