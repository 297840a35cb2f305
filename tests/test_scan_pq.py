"""PQ scans: one product with the decoded rows, on all cores."""

import numpy as np
import pytest

from quiver.operators import knn, pq
from quiver.operators.topk_kernel import TopK, distinct_rows
from quiver.schema import queries_from
from tests.test_expand import rows_of, table


@pytest.mark.parametrize("metric", ["l2", "l2sq", "ip", "cosine"])
def test_pq_scan_ranks_as_the_tables_do(metric):
    rng = np.random.default_rng(3)
    CB, cen = rng.normal(size=(4, 8, 4)), rng.normal(size=16)
    code = rng.integers(0, 8, (300, 4))
    code[100:] = code[:20].repeat(10, axis=0)  # large groups of one code
    ids, Q = rng.permutation(300), rng.normal(size=(7, 16))
    own = distinct_rows(ids, code.astype(np.int16), 5)
    assert len(own) < 200
    R = pq.decoded(code[own], CB)
    unit = Q / np.sqrt((Q * Q).sum(1))[:, None] if metric == "cosine" else Q
    top = TopK(np.arange(7), unit, 5, "ip" if metric == "cosine" else metric)
    top.add(ids[own], cen + R, score=pq.coded_distances(top.metric, top.Q, cen, R, 4), norms=np.sqrt((R * R).sum(1)) + np.sqrt(cen @ cen))
    D = pq.table_distances(metric, Q, cen, code, CB)
    order = np.lexsort((np.broadcast_to(ids, D.shape), np.round(D, 9)), axis=1)[:, :5]
    assert np.array_equal(top.best_i, ids[order])


def test_pq_and_ivf_scans_use_all_cores(spark):
    v = table(spark, n=400).coalesce(1)
    index = pq.build_ivfpq(v, 4, len(v.first()["embed"]), lists=1, bits=4, train_percent=100)
    assert len(index.codes.inputFiles()) == 1
    cores = spark.sparkContext.defaultParallelism
    assert knn.spread(index.codes).rdd.getNumPartitions() == cores
    q = queries_from(v)
    flat = pq.build_ivfpq(v, 4, len(v.first()["embed"]), lists=3, bits=4, train_percent=100, n_probes=3, rerank=400)
    assert rows_of(flat.search(q, 6)) == rows_of(knn.knn(v, q, 6))
    assert index.search(q, 6).count() == 2400
