"""Operator 9: substring deduplication with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words; each word covered by a window that also starts
in a document with a smaller id is removed. Windows are judged on the input.

1. *Copies.* Rows with the same word sequence as a smaller id are removed whole; only the
   smallest id of a sequence goes on, since its windows have the smaller id anyway.
2. *Prefixes.* Each window is assigned to the anchor with the least hash among its
   ``PREFIX``-word sequences (the first of equals): equal windows have equal anchors at
   equal places, and a document has few of them. Anchors that occur in one document only
   are dropped: their windows cannot repeat.
3. *Groups.* Windows that share an anchor, with their words, form a group. An anchor with more than
   ``GROUP`` occurrences would outgrow a task's memory, so its prefix is lengthened to the
   whole window; such a group is one leaf, and its smallest id a grouped minimum. Equal
   stretches of words are combined before they are sent, so a passage in a third of all documents is one row
   per task.
4. *Trees.* In a group the windows are the suffixes of its distinct stretches, sorted; runs of
   neighbours with a common prefix of at least WINDOW words are the subtrees below its deep
   internal nodes (the maximal repeats), and their smallest id decides.
5. The decided stretches are joined back to their occurrences (adaptive execution may
   split a hot one), and each text is cut in one more pass.

Word equality inside trees is that of 32 bits of the word's hash, in stretches whose anchors agree in 64.

Defined results: null and empty texts have no words and the digest of the empty
string; shorter texts than a window keep all; rows with a null ``doc_id`` neither lose words nor
count as sources; rows that repeat a ``doc_id`` are one document for the order and
judged each by its own text; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import textkernel as K
from quiver.llm.batches import bound_batches
from quiver.session import scratch_dir

WINDOW = 50
PREFIX = 8
GROUP = 8_000  # occurrences of an anchor whose stretches one task sorts
BIN_ROWS = 20_000  # distinct stretches per task, on average
FLUSH = 30_000  # distinct stretches held while writing
BROADCAST_BYTES = 32 << 20  # of positions or ranges sent to every executor


def _anchors(hashes: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """Anchor position of every window of one document (hashes: of its prefix-word sequences)."""
    reach = window - prefix + 1
    if len(hashes) < reach:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(hashes, reach).argmin(axis=1) + np.arange(len(hashes) - reach + 1)


def _documents(texts, prefix: int):
    """``(row, word hashes, prefix hashes)`` of every row with words, and the rest with none."""
    raw, offsets = K.text_buffer(texts)
    for lo, hi in K.pieces(offsets):
        part = offsets[lo : hi + 1]
        starts, ends, first = K.word_spans(raw[part[0] : part[-1]], part - part[0])
        words = K.word_hashes(raw[part[0] : part[-1]], starts, ends)
        grams = K.window_hashes(words, prefix)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            yield lo + i, words[a:b], grams[a : max(a, b - prefix + 1)]


def _fingerprint(words: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _packed(arrays: list[np.ndarray], kind) -> pa.Array:
    return pa.array([np.asarray(a, kind).tobytes() for a in arrays], pa.binary())


def sequences(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """``(doc_id, n_words, fp_a, fp_b, keys)``: ``keys`` holds (hash, position) of each anchor, packed."""

    def run(batches):
        for batch in batches:
            n, fa, fb, keys = [], [], [], []
            for _, words, grams in _documents(batch.column(1), prefix):
                n.append(len(words))
                a, b = _fingerprint(words)
                fa.append(a)
                fb.append(b)
                at = np.unique(_anchors(grams, window, prefix))
                keys.append(np.stack([grams[at].view(np.int64), at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), _packed(keys, np.int64)], ["doc_id", "n_words", "fp_a", "fp_b", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, fp_a long, fp_b long, keys binary")


def _unpacked(rows: DataFrame) -> DataFrame:
    """``(doc_id, fp_a, key, at)`` from packed anchors: a row per anchor of a document, with all its positions there."""

    def run(batches):
        for batch in batches:
            count, keys, sizes, at = [], [], [], []
            for packed in batch.column(2):
                key, pos = np.frombuffer(packed.as_buffer(), np.int64).reshape(2, -1)
                order = np.argsort(key, kind="stable")
                key = key[order]
                head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                count.append(len(head))
                keys.append(key[head])
                sizes.append(np.diff(np.append(head, len(key))))
                at.append(pos[order].astype(np.int32))
            if count:
                ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(at)))
                own = [pa.array(np.repeat(batch.column(c).to_numpy(), count)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(keys)), places], ["doc_id", "fp_a", "key", "at"])

    return rows.select("doc_id", "fp_a", "keys").mapInArrow(run, "doc_id long, fp_a long, key long, at array<int>")


def _sized_join(left: DataFrame, right: DataFrame, size: int, how: str) -> DataFrame:
    """Join on ``doc_id``; the right side is broadcast when its counted bytes are within the limit."""
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, "doc_id", how)


def stretches(docs: DataFrame, live: DataFrame, size: int, window: int, prefix: int) -> DataFrame:
    """``(key, id, hot, words, lowest, docs, fps, at)``: distinct stretches of a task with their occurrences.

    ``live(doc_id, fp_a, at, hot)``: positions of repeated anchors. A stretch spans the consecutive windows of one anchor
    (one window if hot); ``docs, fps, at`` are packed.
    """

    def run(batches):
        held: dict[tuple, list] = {}

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys]),
                 pa.array([held[k][0] for k in keys], pa.binary()), pa.array([min(held[k][1]) for k in keys], pa.int64()),
                 *(_packed([held[k][c] for k in keys], np.int64) for c in (1, 2, 3))],
                ["key", "id", "hot", "words", "lowest", "docs", "fps", "at"])
            held.clear()
            return out

        for batch in batches:
            ids, fps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, words, grams in _documents(batch.column(1), prefix):
                if _fingerprint(words)[0] != fps[row]:
                    continue  # another text under the same id
                anchor = _anchors(grams, window, prefix)
                hot = np.full(len(grams), -1, np.int8)
                hot[np.array(batch.column(3)[row].as_py(), np.int64)] = np.array(batch.column(4)[row].as_py(), np.int8)
                state = hot[anchor]
                breaks = np.flatnonzero((anchor[1:] != anchor[:-1]) | (state[1:] > 0)) + 1
                whole = K.window_hashes(words, window) if (state > 0).any() else None
                small = (words >> K.U(32)).astype(np.uint32)
                for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(anchor)], strict=True):
                    if state[s] < 0:
                        continue
                    m = int(anchor[s])
                    key = int(grams[m].view(np.int64))
                    if state[s] > 0:
                        entry, content = (key, int(whole[s].view(np.int64)), True), b""
                    else:
                        content = small[s : e - 1 + window].tobytes()
                        own = hashlib.blake2b(words[s : e - 1 + window].tobytes(), digest_size=8, salt=(m - s).to_bytes(8, "little")).digest()
                        entry = (key, int.from_bytes(own, "little", signed=True), False)
                    got = held.setdefault(entry, [content, [], [], []])
                    got[1].append(ids[row])
                    got[2].append(fps[row])
                    got[3].append(s)
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    marked = F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("hot").cast("int").alias("hot")))
    per_doc = live.groupBy("doc_id", "fp_a").agg(F.sort_array(F.flatten(F.collect_list(marked))).alias("z"))
    per_doc = per_doc.select("doc_id", "fp_a", F.col("z.pos").alias("pos"), F.col("z.hot").alias("hot"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = _sized_join(texts, per_doc, size, "inner").select("doc_id", "text", "fp_a", "pos", "hot")
    return joined.mapInArrow(run, "key long, id long, hot boolean, words binary, lowest long, docs binary, fps binary, at binary")


def deep_nodes(contents: list[np.ndarray], lowest: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch, the smallest id below the subtree of depth ``window`` that holds each of its windows."""
    count = [len(c) - window + 1 for c in contents]
    suffixes = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, window) for c in contents])
    order = np.ascontiguousarray(suffixes).view(np.dtype((np.void, suffixes.itemsize * window))).ravel().argsort(kind="stable")
    common = (suffixes[order[1:]] == suffixes[order[:-1]]).all(axis=1)  # neighbours with a common prefix of window words
    head = np.flatnonzero(np.concatenate(([True], ~common)))
    owner = np.repeat(lowest, count)[order]
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
    return np.split(least, np.cumsum(count)[:-1])


def _runs(least: np.ndarray) -> np.ndarray:
    """(first window, last window, smallest id) of equal neighbours."""
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return np.column_stack([cut, np.append(cut[1:], len(least)) - 1, least[cut]])


def decided(found: DataFrame, rows: int, window: int) -> DataFrame:
    """``(key, id, runs)`` of every distinct stretch."""

    def trees(table: pa.Table) -> pa.Table:
        key, lowest = table.column("key").to_numpy(), table.column("lowest").to_numpy()
        order = np.argsort(key, kind="stable")
        packed, out = table.column("words"), [None] * len(key)
        for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(group):
                contents = [np.frombuffer(packed[int(i)].as_buffer(), np.uint32) for i in group]
                for i, least in zip(group, deep_nodes(contents, lowest[group], window), strict=True):
                    out[i] = _runs(least).astype(np.int64).tobytes()
        return pa.table({"key": table.column("key"), "id": table.column("id"), "runs": pa.array(out, pa.binary())})

    def single(batches):
        for batch in batches:
            low = batch.column(2).to_numpy()
            runs = [np.array([0, 0, x], np.int64).tobytes() for x in low]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], ["key", "id", "runs"])

    cold = found.where("not hot").groupBy("key", "id").agg(F.min("lowest").alias("lowest"), F.first("words").alias("words"))
    cold = cold.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(max(1, rows // BIN_ROWS))))
    hot = found.where("hot").groupBy("key", "id").agg(F.min("lowest").alias("lowest"))
    schema = "key long, id long, runs binary"
    return cold.groupBy("bin").applyInArrow(trees, schema).unionByName(hot.mapInArrow(single, schema))


def covered(found: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, fp_a, first, last)``: word ranges (last excluded) under windows that start in a smaller id."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for packed, own in zip(batch.column(3), zip(*(batch.column(c) for c in range(3)), strict=True), strict=True):
                doc, fp, at = (np.frombuffer(x.as_buffer(), np.int64) for x in own)
                for lo, hi, least in np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 3):
                    later = doc > least
                    for k, x in enumerate((doc[later], fp[later], at[later] + lo, at[later] + hi + window)):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["doc_id", "fp_a", "first", "last"])

    joined = found.select("key", "id", "docs", "fps", "at").join(runs, ["key", "id"]).select("docs", "fps", "at", "runs")
    return joined.mapInArrow(run, "doc_id long, fp_a long, first long, last long")


def deduplicated(spark: SparkSession, docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row of ``docs(doc_id, text)``.

    ``kept``: the words left, joined by one space; with ``digest`` their SHA-256 as ``kept_sha256`` instead.
    """
    bound_batches(spark)
    base = scratch_dir(spark, "suffixes")
    sequences(docs, window, prefix).write.parquet(f"{base}/sequences")
    seq = spark.read.parquet(f"{base}/sequences").where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    same = ["fp_a", "fp_b", "n_words"]
    leads = seq.groupBy(*same).agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")).where("lead < other")
    copies = seq.select("doc_id", *same).join(leads, same).where("doc_id > lead").select("doc_id", *same)
    anchors = _unpacked(seq.join(copies.select("doc_id", *same).distinct(), ["doc_id", *same], "left_anti"))
    keys = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum(F.size("at")).alias("c")).where("a < b")
    # Written, so that the join deals both sides anew and adaptive execution may split a hot anchor.
    keys.select("key", (F.col("c") > GROUP).alias("hot")).write.parquet(f"{base}/keys")
    anchors.join(spark.read.parquet(f"{base}/keys"), "key").select("doc_id", "fp_a", "at", "hot").write.parquet(f"{base}/live")
    live = spark.read.parquet(f"{base}/live")
    n_live = live.agg(F.sum(F.size("at"))).first()[0] or 0
    stretches(docs, live, n_live * 16, window, prefix).write.parquet(f"{base}/stretches")
    found = spark.read.parquet(f"{base}/stretches")
    ranges = covered(found, decided(found, found.count(), window), window)
    ranges = ranges.unionByName(copies.distinct().select("doc_id", "fp_a", F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    ranges = ranges.groupBy("doc_id", "fp_a").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("r"))
    ranges.select("doc_id", "fp_a", F.col("r.first").alias("first"), F.col("r.last").alias("last")).write.parquet(f"{base}/ranges")
    ranges = spark.read.parquet(f"{base}/ranges")
    size = ranges.agg(F.sum(F.size("first") * 16 + 64)).first()[0] or 0
    per_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("fp_a", "first", "last")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            out = [[], [], []]
            cuts = batch.column(2).to_pylist()
            hashed = {}
            if any(cuts):  # several texts may share an id: each takes the cuts of its own fingerprint
                for row, words, _ in _documents(batch.column(1).filter(pa.array([bool(c) for c in cuts])), prefix):
                    hashed[row] = _fingerprint(words)[0]
            k = 0
            for text, some in zip(raw, cuts, strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if some:
                    gone = np.zeros(n + 1, np.int64)
                    for c in some:
                        if c["fp_a"] == hashed[k]:
                            np.add.at(gone, c["first"], 1)
                            np.add.at(gone, c["last"], -1)
                    k += 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
                kept = b" ".join(words)
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = _sized_join(texts, per_doc, size, "left").select("doc_id", "text", "cuts")
    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return deduplicated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)),
firsts AS (SELECT g, min(doc_id) AS d FROM wins GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM wins JOIN firsts USING (g), range(0, {WINDOW}) AS r(k) WHERE d < doc_id),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(words) AS n, list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS k FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
