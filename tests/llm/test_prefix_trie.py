"""The trie against one built of Python dictionaries, with ranges so small that nodes span many of them."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiver.llm import prefix_trie as P
from quiver.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, duck


def plain(sequences):
    """Rows of the nodes of ``{conv_id: [(turn, bytes), ...]}``, as COLUMNS has them but for the rank."""
    members, size = defaultdict(list), {}
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            path = tuple(t for t, _ in sequences[c][:d])
            members[path].append(c)
            size[path] = sequences[c][d - 1][1] if d else 0
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)

    def below(path):
        parts = [below(c) for c in children[path]]
        return sum(p[0] for p in parts) or 1, sum(p[1] for p in parts) + (len(members[path]) - 1) * size[path]

    out = []
    for path, own in members.items():
        leaves, saved = below(path)
        ends = ",".join(str(c) for c in own if len(sequences[c]) == len(path))
        out.append((own[0], len(path), members[path[:-1]][0] if path else None, len(own), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def keyed(spark, sequences):
    rows = [(c, b"".join(hashlib.md5(str(t).encode()).digest() for t, _ in s), [n for _, n in s]) for c, s in sequences.items()]
    return spark.createDataFrame(rows, "conv_id long, key binary, sizes array<long>")


def trees(seed, n, hot):
    rng = random.Random(seed)
    size = lambda t: t * 7 % 11
    out = {c * 3 - 20: [(t, size(t)) for t in (rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))] for c in range(n)}
    return out | {10**6 + c: [(1, size(1)), (2, size(2)), (1, size(1))] for c in range(hot)}


@pytest.mark.parametrize("seed,n,hot,turns", [(1, 60, 0, 10**6), (2, 60, 40, 3), (3, 1, 0, 1), (4, 0, 25, 2), (5, 150, 70, 25)])
def test_nodes_and_order(spark, monkeypatch, seed, n, hot, turns):
    monkeypatch.setattr(P, "RANGE_TURNS", turns)
    sequences = trees(seed, n, hot)
    nodes, order = P.prefix_trie(spark, keyed(spark, sequences))
    rows = nodes.collect()
    assert sorted((tuple(r[c] for c in P.COLUMNS[:-1]) for r in rows), key=str) == plain(sequences)
    ranks = {r["rank"]: r["conv_id"] for r in order.collect()}
    assert sorted(ranks) == list(range(len(sequences)))
    for r in rows:  # members are an interval of the order
        own = [ranks[k] for k in range(r["first"], r["first"] + r["n_convs"])]
        path = [t for t, _ in sequences[r["conv_id"]][: r["depth"]]]
        assert min(own) == r["conv_id"] and all([t for t, _ in sequences[c][: r["depth"]]] == path for c in own)


def test_rebuilt_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "", None])) for c in [*range(-7, 40), 10**12] if c not in (5, 20) for t in range(rng.randrange(1, 12))]
    rows += [(3, None, "system", "null turn comes first"), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append(((role or "", text or ""), len(text or "")))
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        want[c] = own.get(base, [])[:h] + own[c][h:]
    convs = P.digested(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = P.prefix_trie(spark, P.sequences_of(P.rebuilt(spark, convs)))[0]
    assert sorted((tuple(r[c] for c in P.COLUMNS[:-1]) for r in nodes.collect()), key=str) == plain(want)


def test_the_twin_with_ranges_of_a_few_turns(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(P, "RANGE_TURNS", 7)
    name = "op13_prefix_trie"
    assert compare(spark, odd_dir, name, QUERIES[name], ORACLE[name], duck(odd_dir))["status"] == "ok"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 6), min_size=1, max_size=40), st.data())
def test_sparse_table(values, data):
    table, a = P.SparseTable(np.array(values)), np.array(values)
    i = data.draw(st.integers(0, len(a) - 1))
    j = data.draw(st.integers(i, len(a) - 1))
    bound = data.draw(st.integers(-4, 7))
    at = np.array([i])
    assert table.least(at, np.array([j]))[0] == a[i : j + 1].min()
    right, left = i, i
    while right + 1 < len(a) and a[right + 1] >= bound:
        right += 1
    while left > 0 and a[left] >= bound:
        left -= 1
    assert table.right(at, np.array([bound]))[0] == right
    assert table.left(at, np.array([bound]))[0] == left
