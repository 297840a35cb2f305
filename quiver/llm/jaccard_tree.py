"""Operator 5: exact Jaccard join of word-shingle sets with signature trees.

A document's set holds the 64-bit hashes of its distinct ``width``-word
shingles (fewer words: the whole sequence as one; no words: empty, linked with
nothing). Two documents link when ``100 * |A & B| >= threshold * |A | B|``.

1. *Routing level.* Linked sets of sizes a and b differ in at most
   ``H = (a + b)(100 - t) // (100 + t)`` shingles, so when the shingle space is
   cut into more than H parts, some part is equal in both. Each document
   carries one 64-bit key per part; documents that share a key are joined to the
   smallest id of the key, and the connected components of these stars are the
   trees' roots. Near copies share most keys, so keys meet in two rounds: first the
   ``EARLY`` least keys of each size class, then all keys under the ids of the components
   found so far, where near copies have one id and give no further links. A bucket of keys gives a
   spanning forest at most. Parts with fewer than ``MIN_PART`` shingles are left out where
   the spare parts guarantee another equal one, so common passages don't glue
   unrelated documents together. Keys travel as packed blocks; equal keys
   are combined before the shuffle.
2. *Exact copies* (equal sets, by size and 128 bits of sum and parity) are represented by
   their smallest id; only representatives are routed and enter a tree.
3. *Trees.* A root of more than ``BLOCK`` shingles is cut by size range, and
   by hash inside a range, into blocks; every pair of blocks with compatible
   size ranges is one tree join, so no task holds more than two blocks. Inside a
   task, leaves hold a bitmap of their shingles, inner nodes the OR of their
   children and the size range; the dual traversal drops node pairs whose
   sizes cannot match or whose largest possible overlap is too small, and pairs
   that verified links have already put into one component. Surviving leaf pairs
   are verified on the full sets. ``jaccard_links`` verifies every surviving pair, also
   inside a component, and counts each document's links.
4. The verified links and the copies give the components.

Nothing is approximate: each pruning step has a proof, and no partner,
candidate or bucket is capped.

Defined results: null or empty texts have 0 shingles and are their own
component; rows with a null ``doc_id`` are counted but never linked (null
component); rows that repeat a ``doc_id`` are one node and all of them returned;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import textkernel as K
from quiver.llm.batches import bound_batches
from quiver.llm.components import components
from quiver.llm.selection import one_of_each, without
from quiver.session import scratch_dir

MIN_PART = {90: 4}  # smallest part (in shingles) that makes a key, by threshold; 2 elsewhere
FLUSH_KEYS = 2_000_000  # keys a routing task gathers before it sends blocks
BUCKET_KEYS = 1_000_000  # keys a routing bucket holds on average
EARLY = 2  # keys of a size class that meet in the first round
BLOCK = 2_000_000  # shingles of a tree block
BROADCAST_ROWS = 1_000_000  # member rows (at most 40 bytes each) that may be broadcast
FANOUT = 16
LINK = ("n_a", "sum_a", "par_a", "n_b", "sum_b", "par_b")  # a link between two sets, each by size, sum and parity
PAIRS = 1 << 12  # node pairs handled at once; their children are up to FANOUT**2 times as many


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a text buffer (A-Z folded)."""
    starts, ends, first = K.word_spans(raw, offsets)
    words = K.word_hashes(raw, starts, ends, lower=True)
    windows = K.window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(windows[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(K.window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _batch_sets(texts, width):
    raw, offsets = K.text_buffer(texts)
    for lo, hi in K.pieces(offsets):
        part = offsets[lo : hi + 1]
        yield lo, shingle_sets(raw[part[0] : part[-1]], part - part[0], width)


class Parts:
    """Which keys a set of n shingles needs so that every possible partner shares one."""

    def __init__(self, threshold: int):
        self.t = threshold
        self.min_part = MIN_PART.get(threshold, 2)
        self.edges = [1]  # class c holds pairs whose larger set has edges[c] .. edges[c + 1] - 1 shingles

    def _reach(self, total: int) -> int:
        return total * (100 - self.t) // (100 + self.t)

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """``(class, parts, spare)``: at most ``spare`` parts may be left out."""
        most = n * 100 // self.t
        while self.edges[-1] <= most:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))
        out = []
        for c in range(len(self.edges) - 1):
            low, high = self.edges[c], self.edges[c + 1] - 1
            if high < n or low > most or not self._reach(2 * high):
                continue
            parts = math.ceil(1.1 * self._reach(2 * high)) + 2
            out.append((c, parts, parts - 1 - self._reach(n + min(most, high))))
        return out

    def keys(self, s: np.ndarray) -> list[np.ndarray]:
        """The keys of a set, by size class."""
        out = []
        spread = s >> K.U(31)  # the hashes are well mixed: any bits deal them out, and sums tell sets apart
        for c, k, spare in self.classes(len(s)):
            part = (spread % K.U(k)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            count = np.bincount(part, minlength=k)
            sums = np.zeros(k + 1, np.uint64)
            full = np.flatnonzero(count)
            at = np.concatenate(([0], np.cumsum(count)))[full]
            sums[full] = np.add.reduceat(s[order], at)
            key = K.mix(sums[:k] + K.mix(np.arange(k, dtype=np.uint64), 1000 + c), 7)
            small = count < self.min_part
            out.append(key[~small] if small.sum() <= spare else key)
        return out


def signatures(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """``(doc_id, n_shingles, fp_a, fp_b, early, keys)`` of every row; ``early`` are the least keys of each class."""
    none = np.zeros(0, np.uint64)

    def run(batches):
        plan = Parts(threshold)
        for batch in batches:
            for lo, sets in _batch_sets(batch.column(1), width):
                fp = _prints(sets)
                keys = [plan.keys(s) for s in sets]
                early = [np.concatenate([none, *(np.sort(c)[:EARLY] for c in k)]) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[0]), pa.array(fp[1]),
                     K.binary(early), K.binary([np.concatenate([none, *k]) for k in keys])],
                    ["doc_id", "n_shingles", "fp_a", "fp_b", "early", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp_a long, fp_b long, early binary, keys binary")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``(a, b)`` connects: each id to the smallest one of its component."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for side in (x, y):
            np.minimum.at(root, root[side], low)
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest id of each distinct key, and a link to it from every other id."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    lead = np.repeat(i[head], np.diff(np.append(head, len(k))))
    return k[head], i[head], *_forest(i[lead != i], lead[lead != i])


def key_links(sig: DataFrame, n_buckets: int) -> DataFrame:
    """``(a, b)``: links that connect all ids of ``sig(doc_id, keys)`` which share a key; a spanning forest per bucket."""

    def deal(batches):
        keys, ids, held = [], [], 0

        def flush():
            k, i, a, b = _stars(np.concatenate(keys), np.concatenate(ids))
            to, where = (k % K.U(n_buckets)).astype(np.int64), (K.mix(a.astype(np.uint64)) % K.U(n_buckets)).astype(np.int64)
            o, w = np.argsort(to, kind="stable"), np.argsort(where, kind="stable")
            k, i, a, b = k[o], i[o], a[w], b[w]
            present = np.unique(np.concatenate((to, where)))
            cut = [(np.searchsorted(x, present), np.searchsorted(x, present, side="right")) for x in (to[o], where[w])]
            blocks = [K.binary([x[p:q] for p, q in zip(*cut[c], strict=True)]) for x, c in ((k, 0), (i, 0), (a, 1), (b, 1))]
            return pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), *blocks], ["bucket", "keys", "ids", "a", "b"])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(packed.as_buffer(), np.uint64)
                keys.append(own)
                ids.append(np.full(len(own), doc, np.int64))
                held += len(own)
                if held >= FLUSH_KEYS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        got = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64 if c == "keys" else np.int64) for c in ("keys", "ids", "a", "b")}
        _, _, a, b = _stars(got["keys"], got["ids"])
        a, b = _forest(np.concatenate((a, got["a"])), np.concatenate((b, got["b"])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = sig.where("doc_id is not null").select("doc_id", "keys").mapInArrow(deal, "bucket long, keys binary, ids binary, a binary, b binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


class Forest:
    """Union-find over the leaves of one tree."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)

    def labels(self) -> np.ndarray:
        lab = np.array(self.parent)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                return lab
            lab = up


def tree_links(sets: list[np.ndarray], threshold: int, every: bool = False) -> list[tuple[int, int]]:
    """Index pairs of linked sets that connect what is linked (a spanning forest of all links), or all of them with ``every``."""
    m, t = len(sets), threshold
    if m < 2:
        return []
    order = sorted(range(m), key=lambda i: (sets[i][:2].tolist(), len(sets[i])))
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    need = lambda a, b: -((a + b) * -t // (100 + t))  # noqa: E731  least overlap that links sizes a and b
    bits = 1 << max(10, math.ceil(math.log2(8 * size.mean())))
    maps = np.zeros((m, bits // 64), np.uint64)
    for i, s in enumerate(sets):
        b = s & K.U(bits - 1)
        np.bitwise_or.at(maps[i], (b >> K.U(6)).astype(np.int64), K.U(1) << (b & K.U(63)))
    ones = np.bitwise_count(maps).sum(1, dtype=np.int64)
    # Levels from leaves to root: bitmap, size range, and the most shingles that share a bit in one leaf.
    levels = [(maps, size, size, size - ones)]
    while len(levels[-1][0]) > 1:
        lower, lo, hi, slack = levels[-1]
        at = np.arange(0, len(lower), FANOUT)
        levels.append((np.bitwise_or.reduceat(lower, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at)))
    forest, found = Forest(m), []

    def verify(x: int, y: int) -> None:
        a, b = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        if int((b[at] == a).sum()) >= need(int(size[x]), int(size[y])):
            forest.join(x, y)
            found.append((order[x], order[y]))

    for x in range(0 if every else m - 1):  # neighbours in the tree's order are the likeliest links
        if min(size[x], size[x + 1]) * 100 >= t * max(size[x], size[x + 1]):
            verify(x, x + 1)

    def uniform() -> list[np.ndarray]:
        """By level: the component of all leaves below a node, or -1."""
        lab = forest.labels()
        out = [lab]
        for level in levels[1:]:
            at = np.arange(0, len(out[-1]), FANOUT)
            a, b = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(a == b, a, -1)[: len(level[0])])
        return out

    same = uniform()
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, x, y = stack.pop()
        if len(x) > PAIRS:
            stack += [(depth, x[PAIRS:], y[PAIRS:]), (depth, x[:PAIRS], y[:PAIRS])]
            continue
        nodes, lo, hi, slack = levels[depth]
        keep = (same[depth][x] < 0) | (same[depth][x] != same[depth][y]) | every
        keep &= (hi[x] * 100 >= t * lo[y]) & (hi[y] * 100 >= t * lo[x])
        x, y = x[keep], y[keep]
        step = max(1, (1 << 19) // nodes.shape[1])
        bound = np.empty(len(x), np.int64)
        for at in range(0, len(x), step):
            p, q = nodes[x[at : at + step]], nodes[y[at : at + step]]
            shared = np.bitwise_count(p & q).sum(1, dtype=np.int64)
            if depth:
                shared += np.minimum(slack[x[at : at + step]], slack[y[at : at + step]])
            else:  # a set bit that the other leaf lacks is a shingle that it lacks
                i, j = x[at : at + step], y[at : at + step]
                shared += np.minimum(size[i] - ones[i], size[j] - ones[j])
            bound[at : at + step] = shared
        keep = bound >= need(lo[x], lo[y])
        x, y, bound = x[keep], y[keep], bound[keep]
        if depth:
            n = len(levels[depth - 1][0])
            kids = np.arange(FANOUT)
            cx = (x[:, None, None] * FANOUT + kids[None, :, None] + 0 * kids[None, None, :]).ravel()
            cy = (y[:, None, None] * FANOUT + 0 * kids[None, :, None] + kids[None, None, :]).ravel()
            ok = (cx < n) & (cy < n) & ((cx < cy) if depth == 1 else (cx <= cy))
            stack.append((depth - 1, cx[ok], cy[ok]))
            continue
        joined = len(found)
        for k in np.argsort(-bound + need(size[x], size[y]), kind="stable"):
            i, j = int(x[k]), int(y[k])
            if every or forest.find(i) != forest.find(j):
                verify(i, j)
        if len(found) > joined and not every:
            same = uniform()
    return found


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sum and parity of every set, which with its size tell sets apart."""
    return [np.array([f.reduce(s) for s in sets], np.uint64).view(np.int64) for f in (np.add, np.bitwise_xor)]


def verified_links(docs: DataFrame, members: DataFrame, n_members: int, weight: int, width: int, threshold: int, every: bool = False) -> DataFrame:
    """``(a, b)`` links inside the groups of ``members(doc_id, gid)``, which hold ``weight`` shingles in all.

    With ``every``, all links between different sets, by size, sum and parity: ``(n_a, sum_a, par_a, n_b, sum_b, par_b)``, each once.
    """
    bins = max(1, -(-weight // BLOCK))

    def sets(batches):
        for batch in batches:
            for lo, got in _batch_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, len(got)) for c in (0, 2, 3)), K.binary(got)], ["doc_id", "gid", "bin", "shingles"])

    def trees(table: pa.Table) -> pa.Table:
        gid, ids = table.column("gid").to_numpy(), table.column("doc_id").to_numpy()
        order = np.argsort(gid, kind="stable")
        cuts = np.flatnonzero(np.diff(gid[order])) + 1
        packed, links = table.column("shingles"), []
        for group in np.split(order, cuts):
            got = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in group]
            links += [(int(ids[group[x]]), int(ids[group[y]])) for x, y in tree_links(got, threshold)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def all_pairs(table: pa.Table) -> pa.Table:
        gid, packed = table.column("gid").to_numpy(), table.column("shingles")
        order = np.argsort(gid, kind="stable")
        parts = []
        for group in np.split(order, np.flatnonzero(np.diff(gid[order])) + 1):
            got = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in group]
            marks = np.stack([np.array([len(s) for s in got], np.int64), *_prints(got)], axis=1)
            marks, first = np.unique(marks, axis=0, return_index=True)  # rows that repeat an id repeat its set
            full = np.flatnonzero(marks[:, 0] > 0)
            pairs = np.array(tree_links([got[first[i]] for i in full], threshold, every=True), np.int64).reshape(-1, 2)
            pairs = full[np.sort(pairs, axis=1)]
            parts.append(np.concatenate([marks[pairs[:, 0]], marks[pairs[:, 1]]], axis=1))
        out = np.concatenate(parts)
        return pa.table({c: pa.array(out[:, k], pa.int64()) for k, c in enumerate(LINK)})

    members = members.withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(bins)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    routed = texts.join(F.broadcast(members) if n_members <= BROADCAST_ROWS else members, "doc_id")
    routed = routed.select("doc_id", "text", "gid", "bin").mapInArrow(sets, "doc_id long, gid long, bin long, shingles binary")
    if every:  # sets of one cell meet in several trees
        return routed.groupBy("bin").applyInArrow(all_pairs, ", ".join(f"{c} long" for c in LINK)).distinct()
    return routed.groupBy("bin").applyInArrow(trees, "a long, b long")


def tree_groups(members: DataFrame, threshold: int) -> DataFrame:
    """``(doc_id, gid)``: the tree joins that each of ``members(doc_id, n_shingles, root)`` takes part in.

    A root within BLOCK is one tree. A larger one is cut into cells by size range (linked sets lie in
    the same or neighbouring ranges) and by hash; each pair of cells of such ranges is a tree join.
    """
    weights = members.groupBy("root").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    own = members.join(weights, "root")
    small = own.where(F.col("w") <= BLOCK).select("doc_id", "n_shingles", F.xxhash64("root").alias("gid"))
    ratio = math.log(100 / threshold) * 1.0000001
    large = own.where(F.col("w") > BLOCK).withColumn("band", F.floor(F.log("n_shingles") / F.lit(ratio)))
    cells = large.groupBy("root", "band").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK)).alias("cells"))
    up = cells.select("root", (F.col("band") - 1).alias("band"), F.col("cells").alias("above"))
    down = cells.select("root", (F.col("band") + 1).alias("band"), F.col("cells").alias("below"))
    large = large.join(cells, ["root", "band"]).join(up, ["root", "band"], "left").join(down, ["root", "band"], "left")
    large = large.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells")))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda b1, c1, b2, c2: F.xxhash64("root", b1, c1, b2, c2)
    band, cell, none = F.col("band"), F.col("cell"), F.array().cast("array<bigint>")
    gids = F.concat(
        F.transform(to("cells"), lambda j: pair(band, F.least(cell, j), band, F.greatest(cell, j))),
        F.when(F.col("above").isNull(), none).otherwise(F.transform(to("above"), lambda j: pair(band, cell, band + 1, j))),
        F.when(F.col("below").isNull(), none).otherwise(F.transform(to("below"), lambda j: pair(band - 1, j, band, cell))),
    )
    return small.unionByName(large.select("doc_id", "n_shingles", F.explode(gids).alias("gid")))


MARK = ("n_shingles", "fp_a", "fp_b")


def _roots(spark: SparkSession, sig: DataFrame) -> DataFrame:
    """``(node, component)`` of all ids of ``sig(doc_id, early, keys)`` that share a key with another one, in two rounds."""
    bytes_of = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    buckets = [max(1, n // 8 // BUCKET_KEYS) for n in sig.agg(bytes_of("early"), bytes_of("keys")).first()]
    path = scratch_dir(spark, "rounds")
    components(spark, key_links(sig.select("doc_id", F.col("early").alias("keys")), buckets[0])).write.parquet(path)
    found = spark.read.parquet(path)
    few = found.count() <= BROADCAST_ROWS
    again = sig.join(F.broadcast(found) if few else found, sig["doc_id"] == found["node"], "left")
    again = again.select(F.coalesce("component", "doc_id").alias("doc_id"), "keys")
    return components(spark, found.toDF("a", "b").unionByName(key_links(again, buckets[1])))


def _routed(spark: SparkSession, docs: DataFrame, width: int, threshold: int) -> tuple:
    """Signatures, those that can link, each copy's ``lead``, tree members, and the members' rows and shingles."""
    if not 50 < threshold <= 100:
        raise ValueError("threshold is a percentage over 50")
    bound_batches(spark)
    base = scratch_dir(spark, "jaccard")
    signatures(docs, width, threshold).write.parquet(f"{base}/signatures")
    sig = spark.read.parquet(f"{base}/signatures")
    known = sig.where("doc_id is not null and n_shingles > 0")
    leads = known.groupBy(*MARK).agg(F.min("doc_id").alias("lead"))
    known.select("doc_id", *MARK).join(leads, list(MARK)).where("doc_id <> lead").distinct().write.parquet(f"{base}/copies")
    copies = spark.read.parquet(f"{base}/copies")
    led = copies.drop("lead")
    distinct = known.join(F.broadcast(led) if led.count() <= BROADCAST_ROWS else led, ["doc_id", *MARK], "left_anti")
    roots = _roots(spark, distinct).withColumnsRenamed({"node": "doc_id", "component": "root"})
    tree_groups(distinct.select("doc_id", *MARK).distinct().join(roots, "doc_id"), threshold).write.parquet(f"{base}/members")
    members = spark.read.parquet(f"{base}/members")
    rows, weight = members.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    return sig, known, copies, members.select("doc_id", "gid"), rows, weight or 0


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``; see the module."""
    sig, _, copies, members, rows, weight = _routed(spark, docs, width, threshold)
    links = verified_links(docs, members, rows, weight, width, threshold)
    found = components(spark, links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))))
    out = sig.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_links(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for every row of ``docs``, no link left out.

    ``n_links`` counts the other documents whose set links with the row's; a document whose rows hold different sets counts once per set.
    Rows with a null ``doc_id`` have none.
    """
    sig, known, same, members, rows, weight = _routed(spark, docs, width, threshold)
    path = scratch_dir(spark, "links")
    verified_links(docs, members, rows, weight, width, threshold, every=True).write.parquet(path)
    links = spark.read.parquet(path)
    mark = list(MARK)
    one, other = LINK[:3], LINK[3:]
    sides = [links.select(*(F.col(c).alias(m) for c, m in zip(x, mark, strict=True)), *(F.col(c).alias(f"to_{m}") for c, m in zip(y, mark, strict=True))) for x, y in ((one, other), (other, one))]
    copies = known.groupBy(*mark).agg(F.countDistinct("doc_id").alias("copies"), F.min("doc_id").alias("lead"))
    partner = copies.select(*(F.col(m).alias(f"to_{m}") for m in mark), F.col("copies").alias("partners"), F.col("lead").alias("b"))
    met = sides[0].unionByName(sides[1]).join(partner, [f"to_{m}" for m in mark])
    own = copies.join(met.groupBy(*mark).agg(F.sum("partners").alias("partners")), mark, "left")
    own = own.select(*mark, "lead", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    edges = met.join(copies, mark).select(F.col("lead").alias("a"), "b").where("a > b")
    found = components(spark, edges.unionByName(same.select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))))
    out = sig.select("doc_id", *mark).join(own.drop("lead"), mark, "left").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    n_links = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), n_links.alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id. Rows with a null id stay."""
    linked = jaccard_components(spark, docs, width, threshold).where("doc_id <> component_id")
    return one_of_each(spark, without(spark, docs, linked))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(spark, docs, width=3, threshold=90)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT b.q, r.root FROM reach r JOIN both_ways b ON b.p = r.node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id
FROM sets JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) ON node = doc_id
"""
