"""Links per document against brute force: every link between different texts of a group counts."""

import pytest

from quiver.llm import jaccard_tree as J
from tests.llm.test_jaccard_tree import brute_components, brute_sets


@pytest.mark.parametrize("block", [None, 150])
def test_links_against_brute_force(spark, odd_dir, monkeypatch, block):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")
    base = [f"w{i}" for i in range(120)]
    near = [(1000 + k, " ".join([*base[:k], f"other{k}", *base[k + 1 :]])) for k in range(0, 120, 17)]
    docs = docs.unionByName(spark.createDataFrame([*near, (2000, near[0][1]), (2001, near[0][1]), (2001, near[0][1]), (None, near[0][1])], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = dict(zip(rows, brute_sets(rows.values(), 3), strict=True))
    linked = lambda a, b: len(a & b) > 0 and 100 * len(a & b) >= 90 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    roots = brute_components(list(sets), list(sets.values()), 90)
    if block:
        monkeypatch.setattr(J, "BLOCK", block)
    got = J.jaccard_links(spark, docs, 3, 90).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_links, r.component_id) == ((want[r.doc_id], roots[r.doc_id]) if r.doc_id is not None else (0, None))
    assert want[1000] == len(near) + 1
