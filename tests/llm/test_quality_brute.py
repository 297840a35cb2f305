"""Operator 2 against a plain version: statistics by Python's strings, one normal equation, isotonic means by the min-max formula."""

import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quiver.llm import quality_model as Q

SETS = [set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"abcdefghijklmnopqrstuvwxyz"), set(b"0123456789"), set(b"\t\x0b\x0c\r "), set(b"\n"), set(b".,;:"), set(b"!?"),
        set(b"|"), set(b"#*$%&<>"), set(b"\"'()-/+=@[]\\^_`{}~"), set(range(0xC0, 0x100))]


def plain_statistics(text):
    if not text:
        return [0.0] * (7 + len(SETS))
    raw = text.encode()
    words, lines = raw.split(), re.findall(rb"[^\n]*\n|[^\n]+", raw)
    counts = [sum(b in s for b in raw) for s in SETS]
    n, chars = len(words), len(text)
    triples = {tuple(words[i : i + 3]) for i in range(n - 2)}
    return [
        math.log1p(chars), math.log1p(n), (chars - counts[3] - counts[4]) / max(n, 1), len(set(words)) / max(n, 1), len(triples) / (n - 2) if n > 2 else 1.0,
        len(set(lines)) / max(len(lines), 1), math.log1p(max(map(len, words), default=0)), *(math.sqrt(c / chars) for c in counts)]


def plain_isotonic(n, y):
    """max over j <= i of the min over k >= i of the mean of j..k."""
    m = len(n)
    mean = lambda j, k: Fraction(sum(y[j : k + 1]), sum(n[j : k + 1]))
    return [max(min(mean(j, k) for k in range(i, m)) for j in range(i + 1)) for i in range(m)]


def plain_scores(docs, labels):
    x = np.array([plain_statistics(t) for _, t in docs])
    by = {}
    for i, q in labels:
        if q is not None and i is not None:
            by.setdefault(i, []).append(q)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(k, fold(i), q) for k, (i, _) in enumerate(docs) if i is not None for q in by.get(i, [])]
    at, y = [k for k, f, _ in rows if f > 1], np.array([q for _, f, q in rows if f > 1], float)
    rng = np.random.default_rng(Q.SEED)
    w, b = rng.normal(0, Q.GAMMA, (x.shape[1], Q.D)), rng.uniform(0, 2 * math.pi, Q.D)
    z = np.clip((x - x[at].mean(0)) / np.maximum(x[at].std(0), 1e-6), -8, 8)
    phi = np.column_stack([math.sqrt(2 / Q.D) * np.cos(z @ w + b), np.ones(len(x))])
    penalty = np.diag([Q.RIDGE] * Q.D + [0.0])
    raw = phi @ np.linalg.solve(phi[at].T @ phi[at] + penalty, phi[at].T @ y)
    bins = {}
    for k, f, q in rows:
        if f == 1:
            bins.setdefault(round((min(max(raw[k], -1), 2) + 1) / 3 * Q.BINS), []).append(int(q))
    place = sorted(bins)
    n, means = [len(bins[p]) for p in place], plain_isotonic([len(bins[p]) for p in place], [sum(bins[p]) for p in place])
    xs, ys = [], []
    for value in sorted(set(means)):
        block = [i for i, v in enumerate(means) if v == value]
        xs.append(sum(n[i] * (place[i] / Q.BINS * 3 - 1) for i in block) / sum(n[i] for i in block))
        ys.append(float(value))
    return x, np.clip(np.interp(raw, xs, ys), 0, 1)


@pytest.mark.parametrize("which", ["odd", "sf0.01"])
def test_scores_against_the_plain_version(spark, odd_docs, odd_dir, which):
    sf = odd_dir if which == "odd" else "/root/testdata/sf0.01"
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    x, scores = plain_scores(rows, [(r.doc_id, r.quality) for r in labels.select("doc_id", "quality").collect()])
    key = lambda i, v: (i is None, i or 0, *np.round(v, 6).tolist())
    stats = sorted(key(r.doc_id, r.x) for r in Q.document_statistics(docs).collect())
    assert np.allclose(np.array(stats, float), np.array(sorted(key(i, v) for (i, _), v in zip(rows, x, strict=True)), float), atol=2e-6)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score, r.predicted, r.held_out) for r in Q.quality_scores(spark, docs, labels).collect())
    want = sorted((i is None, i or 0, float(s), i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for (i, _), s in zip(rows, scores, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[4] for g in got] == [w[3] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)
    assert all(g[3] == int(g[2] >= 0.3) for g in got)


@pytest.mark.parametrize("empty", ["documents", "labels", "both"])
def test_empty_tables(spark, odd_docs, odd_dir, empty):
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet")
    got = Q.quality_scores(spark, odd_docs if empty == "labels" else odd_docs.limit(0), labels if empty == "documents" else labels.limit(0))
    assert [r.score for r in got.collect()] == [0.5] * (odd_docs.count() if empty == "labels" else 0)
