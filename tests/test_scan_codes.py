"""A coded scan takes distances of few rows and loses none that ranks."""

import numpy as np
import pytest

from quiver.operators import codes
from quiver.operators.topk_kernel import exact


@pytest.mark.parametrize("metric", ["l2", "l2sq", "ip", "cosine"])
def test_coded_scan_leaves_out_nothing_that_ranks(metric):
    rng = np.random.default_rng(5)
    X, Q = rng.normal(size=(500, 8)), rng.normal(size=(9, 8))
    X[7], Q[3] = 0, 0
    codec = codes.Codec("int8", float(X.min()), float(X.max() - X.min()) / codes.STEPS)
    back = codec.decode(codec.encode(X).view(np.uint8).ravel()).reshape(X.shape)
    err = np.sqrt(((X - back) ** 2).sum(1))
    blocks = [(a, codes.Columns(metric, back[a : a + 90])) for a in range(0, 500, 90)]
    row, col, *_ = codes._inside(metric, Q, blocks, err, 4, True)
    true = exact(metric, Q, np.broadcast_to(X, (9, *X.shape)))
    for q in range(9):
        if np.isfinite(true[q]).any():
            assert set(np.argsort(true[q])[:4]) <= set(col[row == q])
    if metric in ("l2", "l2sq"):
        assert len(row) < 9 * 100
