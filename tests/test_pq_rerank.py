"""Re-ranked PQ search: the candidates are the nearest by table distance of a whole list, however its rows lie in files and tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import ivf, pq
from quiver.schema import queries_from
from tests.test_expand import rows_of, table

K, RR = 4, 3


def expected(index, v, fits=lambda i: True):
    """The rows by brute force: of each list that a query probes the K * RR nearest by table distance, these ranked exactly."""
    CB, probes = index.codebook_array(), {}
    cids, C = index.coarse.centroid_matrix()
    for r in index.coarse.probes(queries_from(v)).collect():
        probes.setdefault(r["qid"], []).append(r["list_id"])
    rows, vecs, out = {}, {r["id"]: np.array(r["embed"], float) for r in v.collect()}, []
    for r in index.codes.collect():
        if fits(r):
            rows.setdefault(r["list_id"], []).append((r["id"], r["codes"]))
    for qid, lists in probes.items():
        Q, found = vecs[qid][None], []
        for lid in lists:
            ids, codes = np.array([i for i, _ in rows.get(lid, [])]), np.array([c for _, c in rows.get(lid, [])])
            if len(ids):
                D = pq.table_distances(index.metric, Q, C[list(cids).index(lid)].astype(float), codes, CB)[0]
                for i in ids[np.lexsort((ids, np.round(D, 9)))[: K * RR]]:
                    found.append((pq.exact(index.metric, Q, vecs[i][None, None])[0, 0], i))
        out += [(qid, rk, i, round(float(d), 5)) for rk, (d, i) in enumerate(sorted(found)[:K], 1)]
    return sorted(out)


def ranked(df):
    return sorted((r["qid"], r["rk"], r["id"], round(r["d"], 5)) for r in df.collect())


@pytest.mark.parametrize("metric,lists", [("l2", 1), ("cosine", 3)])
def test_candidates_are_a_whole_lists(spark, metric, lists):
    v = table(spark, n=150).where("id <> 7").repartition(3, "id")
    index = pq.build_ivfpq(v, 2, 8, lists=lists, bits=3, metric=metric, train_percent=100, n_probes=min(2, lists), rerank=RR, keep_vectors=True)
    half = index.codes.where("id % 2 = 0")  # the index as appending leaves it: a list's rows in several files
    coarse = ivf.with_appended(ivf.IvfIndex(index.coarse.centroids, index.codes.where("id % 2 = 1"), index.coarse.list_sizes, metric, index.coarse.n_probes, "embed",
                                            index.coarse.path, index.coarse.meta, _cen=index.coarse._cen), half)
    index = pq.IvfPqIndex(coarse, index.codebook, 2, metric, RR)
    want = expected(index, v)
    assert len(want) == 149 * K
    for budget in (None, 8_000, 1):  # rows held by every task, scanned by blocks of queries, cut into cells
        assert ranked(index.search(queries_from(v), K, broadcast_bytes=budget)) == want


def test_filtered_and_flagged(spark):
    v = table(spark, n=150)
    index = pq.build_ivfpq(v, 2, 8, lists=1, bits=3, train_percent=100, rerank=RR)
    want = expected(index, v, lambda r: r["i32v"] < 50)
    assert ranked(index.search(queries_from(v), K, where=F.col("i32v") < 50)) == want
    fits = {r["id"] for r in v.where("i32v < 50").collect()}
    for budget in (None, 1):
        flagged = index.search(queries_from(v), K, flag=F.col("i32v") < 50, broadcast_bytes=budget).collect()
        assert sorted((r["qid"], r["rk"], r["id"], round(r["d"], 5)) for r in flagged) == expected(index, v)
        assert all(r["ok"] == (r["id"] in fits) for r in flagged)


def test_repeated_query_ids_raise(spark):
    v = table(spark, n=100)
    index = pq.build_ivfpq(v, 2, 8, lists=1, bits=3, train_percent=100, rerank=2)
    with pytest.raises(ValueError, match="query ids repeat"):
        index.search(queries_from(v.unionByName(v)), K).count()
    assert rows_of(index.search(queries_from(v.limit(0)), K)) == []
