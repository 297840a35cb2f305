import hashlib

import pytest

from quiver.llm import suffix_dedup as S


def brute(rows, window):
    """(doc_id, text) rows to sorted (doc_id, n_words, n_removed, digest)."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "broadcast", "window"), [(8_000, 1 << 25, 50), (3, 0, 50), (8_000, 1 << 25, 12)])
def test_against_brute_force(spark, odd_docs, monkeypatch, group, broadcast, window):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(S, "FLUSH", 40)
    monkeypatch.setattr(S, "BIN_ROWS", 30)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = S.deduplicated(spark, odd_docs, window, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_kept_text(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (3, "x a b c d y")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in S.deduplicated(spark, docs, window=4, prefix=2).collect()}
    assert got == {3: "x a b c d y", 5: "e f"}
