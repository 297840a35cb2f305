"""A scan holds the top-k of a group of the queries, however many there are."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quiver.operators import ivf


def test_scan_holds_a_group_of_the_queries(monkeypatch):
    rng = np.random.default_rng(0)
    Q, X = rng.normal(size=(40_000, 8)).astype(np.float32), rng.normal(size=(200, 8))
    rb = pa.RecordBatch.from_arrays([pa.array(np.zeros(200, np.int32)), pa.array(np.arange(200)), pa.array(list(X.astype(np.float32)))], ["list_id", "id", "v"])
    plan = type("B", (), {"value": (np.arange(40_000), Q, np.array([0]), np.array([0, 40_000]), np.arange(40_000))})

    def peak(group):
        monkeypatch.setattr(ivf, "QUERY_GROUP", group)
        tracemalloc.start()
        n = sum(out.num_rows for out in ivf._flat_scan_kernel(plan, 50, "l2", False)(iter([rb])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 40_000 * 50
        return most

    assert peak(2_000) < peak(40_000) / 2
