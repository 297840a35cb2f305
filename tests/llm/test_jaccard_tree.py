import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiver.llm import jaccard_tree as J


def brute_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute_components(nodes, sets, threshold):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(nodes[i]), find(nodes[j])))
                parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("width", "threshold"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, odd_docs, width, threshold):
    rows = odd_docs.select("doc_id", "text").collect()
    known = [r for r in rows if r.doc_id is not None]
    want = brute_components([r.doc_id for r in known], brute_sets([r.text for r in known], width), threshold)
    got = J.jaccard_components(spark, odd_docs, width, threshold).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_shingles) for r in got) == sorted(len(s) for s in brute_sets([r.text for r in rows], width))
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)


def test_blocks_of_one_root_give_the_same(spark, odd_docs, monkeypatch):
    want = sorted(map(tuple, J.jaccard_components(spark, odd_docs, 3, 90).collect()), key=str)
    monkeypatch.setattr(J, "BLOCK", 150)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "BUCKET_KEYS", 100)
    monkeypatch.setattr(J, "FLUSH_KEYS", 50)
    assert sorted(map(tuple, J.jaccard_components(spark, odd_docs, 3, 90).collect()), key=str) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([80, 90]), st.integers(1, 400))
def test_linked_sets_share_a_key(seed, threshold, n):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    most = 2 * len(a) * (100 - threshold) // (100 + threshold)
    cut = rng.integers(0, most // 2 + 1)
    b = np.unique(np.concatenate((rng.permutation(a)[cut:], rng.integers(0, 2**64, rng.integers(0, most - cut + 1), dtype=np.uint64))))
    both = len(np.intersect1d(a, b))
    if 100 * both >= threshold * (len(a) + len(b) - both) and not np.array_equal(a, b):
        plan = J.Parts(threshold)
        assert set(np.concatenate(plan.keys(a)).tolist()) & set(np.concatenate(plan.keys(b)).tolist())


def test_tree_finds_what_pairs_find():
    rng = random.Random(3)
    base = [rng.sample(range(10**9), 60) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(30):
            s = set(b)
            for _ in range(rng.randint(0, 6)):
                s.discard(rng.choice(b))
                s.add(rng.randrange(10**9))
            sets.append(np.array(sorted(s), np.uint64))
    want = brute_components(list(range(len(sets))), [set(s.tolist()) for s in sets], 90)
    links = J.tree_links(sets, 90)
    forest = J.Forest(len(sets))
    for a, b in links:
        forest.join(a, b)
    assert {i: int(x) for i, x in enumerate(forest.labels())} == want
    assert len(links) < len(sets)


def test_keep_one(spark, odd_docs):
    kept = J.keep_one(spark, odd_docs, 5, 80)
    found = {r.doc_id: r.component_id for r in J.jaccard_components(spark, odd_docs, 5, 80).collect()}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in found.values() if c is not None})
    assert ids.count(None) == 3
    assert kept.columns == odd_docs.columns


def test_routing_links_do_not_grow_with_the_buckets(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base[: k % 390], f"x{k}", *base[k % 390 + 1 :]])) for k in range(300)]
    sig = J.signatures(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80)
    plain, counts = J.key_links, []

    def counted(sig, n_buckets):
        links = plain(sig, n_buckets).persist()
        counts.append((n_buckets, links.count()))
        return links

    monkeypatch.setattr(J, "key_links", counted)
    roots = []
    for per_bucket in (10**6, 400):
        monkeypatch.setattr(J, "BUCKET_KEYS", per_bucket)
        roots.append(sorted(map(tuple, J._roots(spark, sig).collect())))
    assert roots[0] == roots[1] == [(k, 0) for k in range(300)]
    (b1, one), (b2, two), (b3, early), (b4, rest) = counts
    assert (b1, b2, one) == (1, 1, 299) and b4 > 50 and two < 30 and rest < 60
    assert early <= 3 * J.EARLY * 300
    assert plain(sig, b4).count() > 5 * (early + rest)  # all keys at once: a link a bucket
    spark.catalog.clearCache()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest(links):
    a, b = (np.array([e[k] for e in links], np.int64) for k in (0, 1))
    up = dict(zip(*(x.tolist() for x in J._forest(a, b)), strict=True))
    parent = {x: x for e in links for x in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for x, y in links:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    assert up == {x: find(x) for x in parent if find(x) != x}
