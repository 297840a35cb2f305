"""A scan holds its rows and queries once, in the precision they are stored in."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quiver.operators import ivf
from quiver.operators.topk_kernel import CHUNK_BYTES, TopK, row_chunks, vectors_from_arrow

DIM = 64


def rows(n, seed=0):
    X = np.random.default_rng(seed).normal(size=(n, DIM)).astype(np.float32)
    values = pc.add(pa.array(X.ravel()), pa.scalar(0, pa.float32()))  # in Arrow's own memory
    v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * DIM + 1, DIM, dtype=np.int32)), values)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32) % 2), pa.array(np.arange(n)), v], ["list_id", "id", "v"])


def test_scan_takes_no_copy_in_doubles():
    n, nq = 60_000, 40_000
    Q = np.random.default_rng(1).normal(size=(nq, DIM)).astype(np.float32)
    # Few queries probe a list, so that the run is short; the state is that of all.
    plan = type("B", (), {"value": (np.arange(nq), Q, np.array([0, 1]), np.array([0, 30, 60]), np.r_[:30, :30])})
    batch = rows(n)
    tracemalloc.start()
    found = sum(out.num_rows for out in ivf._flat_scan_kernel(plan, 5, "l2", False)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 30 * 5
    assert most < 2 * n * DIM * 4  # the sorted rows are half of that; in doubles rows and queries took five times as much


def test_chunks_drop_their_batches():
    per = CHUNK_BYTES // (4 * DIM) // 4
    start = pa.total_allocated_bytes()
    sizes = []
    for t in row_chunks((rows(per) for _ in range(8)), DIM):
        sizes.append(t.num_rows)
        del t
        assert pa.total_allocated_bytes() - start < CHUNK_BYTES / 2 + (1 << 20)  # the newest batch alone
    assert sizes == [4 * per, 4 * per]


@pytest.mark.parametrize("metric", ["l2", "l2sq", "ip", "cosine"])
def test_single_precision_input_ranks_as_its_doubles(metric):
    batch = rows(3000, 2)
    X, ids = vectors_from_arrow(batch.column(2), stored=True), batch.column(1).to_numpy()
    assert X.dtype == np.float32 and vectors_from_arrow(batch.column(2)).dtype == np.float64
    assert vectors_from_arrow(batch.column(2).cast(pa.list_(pa.float64())), stored=True).dtype == np.float64
    one, two = TopK(ids[:700], X[:700], 9, metric), TopK(ids[:700], X[:700].astype(np.float64), 9, metric)
    one.add(ids, X)
    two.add(ids, X.astype(np.float64))
    assert np.array_equal(one.best_i, two.best_i) and np.array_equal(one.best_d, two.best_d)
