"""Operator 13: the prefix trie of conversations, as intervals of their sorted order.

Every turn is a 128-bit digest of (role, text), every conversation the string of its digests. The conversations are range sorted
by that string; the longest common prefixes (LCP) of neighbours, counted in turns, go into a sparse table, which
answers range minima in two look-ups. A node of depth d is an interval of the order within which every LCP is at
least d: each candidate prefix (one that its left neighbour doesn't have) finds the left and the right end of its interval by
two independent binary searches over the table, so neither a stack nor an order of work is needed. Everything else about a node
is a difference of running sums or a range minimum over its interval.

An interval that touches an end of its range partition may go on in the next one. Such nodes are prefixes of the
partition's first or last conversation, so there are few of them. They are written as partial sums; the
LCPs between partitions and the least LCP in each (three numbers a partition, all that reaches the driver) make a second
sparse table, in which each finds by the same search the partition where its node begins, and a grouped
aggregate adds the parts. So the root, a first turn of a third of all conversations or a conversation with as many copies
never meets in one task; only the digest over such a node's member list is one task's work, which reads the list
piece by piece, as SHA-256 must.

Output: a row per node with ``first``, the rank of its first member: its members are the ranks ``first`` to ``first + n_convs - 1``
of the second table ``(rank, conv_id)``.

Defined results: turns are ordered by ``turn`` (null first), equal ones by their digest; repeated turns all stay. A null role or text is
empty. Rows without a ``conv_id`` are no conversation and are left out. Other columns are ignored. A conversation without turns after rebuilding
is a member of the root alone. An empty table has no node, not even a root. A long text counts by its digest and its bytes. What one task must hold of a conversation is 24 bytes
a turn; its texts never move.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_dir

RANGE_TURNS = 200_000  # turns in a range partition, on average
WIDTH = 16  # bytes of a turn's digest
NOTHING = hashlib.sha256(b"").hexdigest()
HEADS, GROUP = 9, 5  # of the rebuilding: turns taken over are below HEADS, from the first of GROUP ids


class SparseTable:
    """Range minima of an array, and how far from a place they stay at or above a bound."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        levels, step = [values], 1
        while 2 * step <= self.n:
            last = levels[-1].copy()
            last[: self.n - step] = np.minimum(last[: self.n - step], last[step:])
            levels.append(last)
            step *= 2
        self.least_from = np.stack(levels)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of ``values[low..high]``, both ends included."""
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        return np.minimum(self.least_from[k, low], self.least_from[k, high - (1 << k) + 1])

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last places up to which all values after ``at`` are at least ``bound``."""
        at = at.copy()
        for k in range(len(self.least_from) - 1, -1, -1):
            to = at + (1 << k)
            at = np.where((to < self.n) & (self.least_from[k, np.minimum(at + 1, self.n - 1)] >= bound), to, at)
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first places after which all values up to ``at`` are at least ``bound``."""
        at = at.copy()
        for k in range(len(self.least_from) - 1, -1, -1):
            to = at - (1 << k)
            at = np.where((to >= 0) & (self.least_from[k, np.maximum(to + 1, 0)] >= bound), to, at)
        return at


def common_prefixes(digests: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The turns that each sequence shares with the one before it; -1 for the first."""
    out = np.zeros(len(lens), np.int64)
    out[:1] = -1
    at, d = np.arange(1, len(lens)), 0
    while len(at):
        at = at[(lens[at] > d) & (lens[at - 1] > d)]
        at = at[(digests[starts[at] + d] == digests[starts[at - 1] + d]).all(1)]
        d += 1
        out[at] = d
    return out


NODES = ("kind int, tl boolean, tr boolean, depth long, ptl boolean, ptr boolean, conv_id long, parent_conv_id long, first long, n_convs long, n_children long, "
         "opens boolean, n_leaves long, saved long, below long, ends string, least long, head binary, tail binary, sizes array<long>")
CLOSED, INNER, OPEN, EDGE, RANK = range(5)  # closed node, closed node under an open one, part of an open node, a partition's ends, order


def nodes_of(keys: list[bytes], convs: np.ndarray, sizes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All nodes of one sorted run of sequences, as if nothing stood before or after it."""
    n = len(keys)
    lens = np.array([len(k) // WIDTH for k in keys], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    digests = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    lcp = common_prefixes(digests, starts, lens)
    running = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])
    upto = lambda row, d: running[starts[row] + d] - running[starts[row]]  # noqa: E731  bytes of a row's first d turns
    at = np.repeat(np.arange(n), lens - lcp)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(lens - lcp) - (lens - lcp), lens - lcp) + lcp[at] + 1
    table, ids = SparseTable(lcp), SparseTable(convs)
    low, high = table.left(at, depth), table.right(at, depth)
    up = np.maximum(depth - 1, 0)
    above, under = table.left(at, up), table.right(at, up)
    inner = np.arange(1, n)
    new = inner[lens[1:] > lcp[1:]]
    new = np.sort(lcp[new] * (n + 1) + new)  # a child begins at each of them, in the node of depth lcp
    children = np.searchsorted(new, depth * (n + 1) + high, "right") - np.searchsorted(new, depth * (n + 1) + low, "right")
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:] < lens[:-1], 0))])  # the last row's is not known here
    shared = np.concatenate([[0], np.cumsum(np.concatenate([[0], upto(inner, lcp[1:])]))])
    same = np.append((lcp[1:] != lens[1:]) | (lens[1:] != lens[:-1]), True)  # the row is the last of equal ones
    run = np.flatnonzero(same)[np.searchsorted(np.flatnonzero(same), low)]
    out = {"low": low, "high": high, "depth": depth, "conv_id": ids.least(low, high), "parent_conv_id": ids.least(above, under), "n_convs": high - low + 1,
           "n_children": children, "opens": lens[low] > depth, "n_leaves": leaf[high + 1] - leaf[low], "saved": shared[high + 1] - shared[low + 1], "below": upto(low, up),
           "tl": low == 0, "tr": high == n - 1, "ptl": above == 0, "ptr": under == n - 1}
    return out | {"run": np.where(lens[low] == depth, run, -1), "lcp": lcp, "lens": lens}


def _partition(batches):
    """The rows of ``NODES`` of one range partition."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    keys, convs = table.column("key").to_pylist(), table.column("conv_id").to_numpy()
    sizes = [np.asarray(s, np.int64) for s in table.column("sizes").to_pylist()]
    x, n = nodes_of(keys, convs, sizes), len(keys)
    kind = np.where(x["tl"] | x["tr"], OPEN, np.where((x["depth"] > 0) & (x["ptl"] | x["ptr"]), INNER, CLOSED))
    names = convs.astype(str)
    members = [",".join(names[a : b + 1]) if b >= 0 else None for a, b in zip(x["low"], x["run"], strict=True)]
    closed = kind != OPEN
    x["n_children"] = x["n_children"] + closed * x["opens"]
    x["saved"] = x["saved"] - closed * (x["n_convs"] - 1) * x["below"]
    ends = [m if o else NOTHING if m is None else hashlib.sha256(m.encode()).hexdigest() for m, o in zip(members, ~closed, strict=True)]
    schema = pa.schema([pa.field(f, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t])
                        for f, t in (c.split() for c in NODES.split(", "))])
    columns = {**{c: pa.array(x[c]) for c in ("tl", "tr", "depth", "ptl", "ptr", "conv_id", "parent_conv_id", "n_convs", "n_children", "opens", "n_leaves", "saved", "below")},
               "kind": pa.array(kind, pa.int32()), "first": pa.array(x["low"]), "ends": pa.array(ends, pa.string())}
    whole = lambda c, rows: pa.RecordBatch.from_arrays([c[f.name].cast(f.type) if f.name in c else pa.nulls(rows, f.type) for f in schema], schema=schema)
    yield whole(columns, len(kind))
    least = int(x["lcp"][1:].min()) if n > 1 else np.iinfo(np.int64).max
    yield whole({"kind": pa.array([EDGE], pa.int32()), "n_convs": pa.array([n]), "least": pa.array([least]), "depth": pa.array([int(x["lens"][-1])]),
                 "head": pa.array([keys[0]], pa.binary()), "tail": pa.array([keys[-1]], pa.binary()), "sizes": pa.array([sizes[0]], pa.list_(pa.int64()))}, 1)
    yield whole({"kind": pa.array(np.full(n, RANK), pa.int32()), "first": pa.array(np.arange(n)), "conv_id": pa.array(convs)}, n)


def _boundaries(batches):
    """The LCP of each partition's first sequence with the sequence before it, and the bytes of those turns."""
    for batch in batches:
        rows = batch.to_pylist()
        shared = []
        for r in rows:
            both = np.frombuffer(r["tail"], np.uint64).reshape(-1, 2), np.frombuffer(r["head"], np.uint64).reshape(-1, 2)
            most = min(map(len, both))
            shared.append(int(np.append((both[0][:most] == both[1][:most]).all(1), False).argmin()))
        yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), pa.array(shared, pa.int64()),
                                          pa.array([sum(r["sizes"][:k]) for r, k in zip(rows, shared, strict=True)], pa.int64())], ["part", "shared", "bytes"])


def _digests(batches):
    """SHA-256 over each node's pieces, which arrive in order."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([key[2]]), pa.array([state.hexdigest()])], ["q", "depth", "s", "ends_sha256"])
    for batch in batches:
        for r in batch.to_pylist():
            if key == (r["q"], r["depth"], r["s"]):
                state.update(b",")
            else:
                if key:
                    yield done()
                key, state = (r["q"], r["depth"], r["s"]), hashlib.sha256()
            state.update(r["ends"].encode())
    if key:
        yield done()


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "first")


def prefix_trie(spark: SparkSession, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and order ``(rank, conv_id)`` of ``sequences(conv_id, key, sizes)``: digests of ``WIDTH`` bytes joined up, and bytes, of the turns."""
    path = scratch_dir(spark, "trie")
    sequences.write.parquet(f"{path}/sequences")
    sequences = spark.read.parquet(f"{path}/sequences")
    turns = sequences.agg(F.count(F.lit(1)) + F.sum(F.size("sizes"))).first()[0] or 0
    laid = sequences.repartitionByRange(max(1, -(-turns // RANGE_TURNS)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    laid.mapInArrow(_partition, NODES).withColumn("part", F.spark_partition_id()).write.partitionBy("kind").parquet(f"{path}/nodes")
    if not turns:
        empty = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)
        return spark.createDataFrame([], empty), spark.createDataFrame([], "rank long, conv_id long")
    rows = spark.read.schema(f"{NODES}, part int").parquet(f"{path}/nodes")
    edges = rows.where(F.col("kind") == EDGE)
    ends = sorted(tuple(r) for r in edges.select("part", "n_convs", "least", "depth").collect())  # a row per partition
    parts = [p for p, *_ in ends]
    before = spark.createDataFrame([(p, q) for q, p in zip(parts, parts[1:], strict=False)], "part int, prev int")
    meet = edges.select("part", "head", "sizes").join(before, "part").join(edges.select(F.col("part").alias("prev"), "tail"), "prev")
    meet = {p: (k, b) for p, k, b in meet.select("part", "head", "tail", "sizes").mapInArrow(_boundaries, "part int, shared long, bytes long").collect()}
    shared = np.array([meet.get(p, (-1, 0))[0] for p in parts], np.int64)
    carried = np.array([meet.get(p, (-1, 0))[1] for p in parts], np.int64)
    chain = SparseTable(np.stack([shared, np.array([e[2] for e in ends], np.int64)], 1).ravel())
    counts = np.array([e[1] for e in ends], np.int64)
    offsets = np.cumsum(counts) - counts
    last_leaf = np.append(shared[1:], -1) < np.array([e[3] for e in ends], np.int64)
    places = np.array(parts)

    def resolved(batches):
        for batch in batches:
            c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in ("part", "depth", "tl", "tr", "n_children", "opens", "n_leaves", "saved", "first")}
            at = np.searchsorted(places, c["part"])
            goes_on = c["tl"] & (shared[at] >= c["depth"])
            q = np.where(goes_on, chain.left(2 * at, c["depth"]) // 2, at)
            # A part that goes on begins a child where the first row leaves the shared prefix at this depth.
            child = np.where(goes_on, c["opens"] & (shared[at] == c["depth"]), c["opens"])
            add = {"n_children": c["n_children"] + child, "n_leaves": c["n_leaves"] + (c["tr"] & last_leaf[at]), "saved": c["saved"] + goes_on * carried[at],
                   "first": c["first"] + offsets[at], "q": q, "s": goes_on | c["tr"]}
            yield pa.RecordBatch.from_arrays([pa.array(add[f.split()[0]]) if f.split()[0] in add else batch.column(f.split()[0]) for f in fields], [f.split()[0] for f in fields])

    fields = ["part int", "tl boolean", "depth long", "ptl boolean", "conv_id long", "n_convs long", "below long", "ends string",
              "n_children long", "n_leaves long", "saved long", "first long", "q long", "s boolean"]
    opened = rows.where(F.col("kind") == OPEN)
    opened.select("part", "tl", "tr", "depth", "ptl", "conv_id", "n_convs", "below", "ends", "n_children", "opens", "n_leaves", "saved", "first").mapInArrow(resolved, ", ".join(fields)).write.parquet(f"{path}/open")
    opened = spark.read.parquet(f"{path}/open")
    pieces = opened.where("ends is not null").select("q", "depth", "s", "part", "ends").repartition("q", "depth").sortWithinPartitions("q", "depth", "s", "part")
    ends_of = pieces.mapInArrow(_digests, "q long, depth long, s boolean, ends_sha256 string")
    total = opened.groupBy("q", "depth", "s").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("below").alias("below"), F.min("first").alias("first"), F.min(F.struct("part", "ptl")).alias("up"))
    total.join(ends_of, ["q", "depth", "s"], "left").write.parquet(f"{path}/merged")
    total = spark.read.parquet(f"{path}/merged")
    # Each partition's own names of its open nodes, with the smallest member of the whole node: nodes below look it up by partition.
    known = opened.select("q", "depth", "s", "part", "tl").join(total.select("q", "depth", "s", "conv_id"), ["q", "depth", "s"])
    known = known.select(F.col("part").alias("up_part"), F.col("tl").alias("up_tl"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv"))
    merged = total.select("*", F.col("up.part").alias("up_part"), F.col("up.ptl").alias("up_tl")).join(known, ["up_part", "up_tl", "depth"], "left")
    merged = merged.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                           (F.col("saved") - (F.col("n_convs") - 1) * F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "first")
    starts = spark.createDataFrame([(int(p), int(o)) for p, o in zip(parts, offsets, strict=True)], "part int, offset long")  # a row per partition
    done = rows.where(F.col("kind").isin(CLOSED, INNER)).join(F.broadcast(starts), "part")
    done = done.withColumn("first", F.col("first") + F.col("offset")).withColumnRenamed("saved", "saved_tokens").withColumnRenamed("ends", "ends_sha256")
    closed = done.where(F.col("kind") == CLOSED).select(*COLUMNS)
    under = done.where(F.col("kind") == INNER).withColumnsRenamed({"part": "up_part", "ptl": "up_tl"}).drop("parent_conv_id").join(known, ["up_part", "up_tl", "depth"])
    under = under.withColumnRenamed("up_conv", "parent_conv_id").select(*COLUMNS)
    order = rows.where(F.col("kind") == RANK).join(F.broadcast(starts), "part").select((F.col("first") + F.col("offset")).alias("rank"), "conv_id")
    return closed.unionByName(under).unionByName(merged), order


def digested(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: an array of (turn, digest in hex, bytes) in order, for each ``conv_id`` of ``turns(conv_id, turn, role, text)``."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].alias("turn"),
                        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))


def sequences_of(convs: DataFrame) -> DataFrame:
    """What ``prefix_trie`` takes, from ``(conv_id, turns)`` as ``digested`` gives it."""
    return convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def rebuilt(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """Each conversation c with its first ``crc32(c) % 9`` turns taken from conversation ``c - c % 5``, where that has them."""
    path = scratch_dir(spark, "turns")
    convs.write.parquet(path)
    convs = spark.read.parquet(path)
    heads = convs.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = convs.join(heads, F.expr(f"conv_id - conv_id % {GROUP}") == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    return both.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, rebuilt; a row per node."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(spark, sequences_of(rebuilt(spark, digested(turns))))[0].select(*COLUMNS)


ORACLE = f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % {HEADS})::BIGINT AS h FROM ids),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c.conv_id, t.i AS k, 0 AS own, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {GROUP} AND t.i < c.h
  UNION ALL SELECT c.conv_id, t.i, 1, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
n AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS m, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d FROM r),
p AS (SELECT conv_id, d, bytes, list(m) OVER w AS path FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM ids),
size AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
node AS (SELECT path, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (len = d), '')) AS ends FROM p JOIN size USING (conv_id) GROUP BY path, d),
child AS (SELECT u.path, count(c.path) AS n_children FROM node u LEFT JOIN node c ON c.d = u.d + 1 AND c.path[:u.d] = u.path GROUP BY u.path),
below AS (SELECT u.path, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (k.n_children = 0) AS leaves
  FROM node v JOIN child k ON k.path = v.path, unnest(range(v.d + 1)) x(e) JOIN node u ON u.d = e AND u.path = v.path[:e] GROUP BY u.path),
sorted AS (SELECT conv_id, row_number() OVER (ORDER BY array_to_string(path, ''), conv_id) - 1 AS rank, path FROM p JOIN size USING (conv_id) WHERE d = len),
starts AS (SELECT s.path[:e] AS path, min(rank) AS first FROM sorted s, unnest(range(len(s.path) + 1)) x(e) GROUP BY 1)
SELECT a.conv_id, a.d::BIGINT AS depth, up.conv_id AS parent_conv_id, a.n_convs, k.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256, s.first
FROM node a JOIN child k ON k.path = a.path JOIN below b ON b.path = a.path JOIN starts s ON s.path = a.path LEFT JOIN node up ON up.d = a.d - 1 AND up.path = a.path[:a.d - 1]
"""
