"""NN-descent moves ids, not vectors, where the vectors fit."""

import numpy as np

from quiver.operators import descent
from tests.test_expand import table


def test_descent_members_travel_as_ids(spark):
    v = table(spark, n=300).select("id", "embed")
    seen = []
    keep, descent._compare = descent._compare, lambda m, igd, held=None: seen.append(held is not None) or keep(m, igd, held)
    try:
        small = {tuple(r) for r in descent.nn_descent(v, 6).collect()}
        spark.conf.set("quiver.knn.broadcastBytes", "5000")
        assert {tuple(r) for r in descent.nn_descent(v, 6).collect()} == small
    finally:
        spark.conf.unset("quiver.knn.broadcastBytes")
        descent._compare = keep
    assert seen[0] and not seen[-1]
    src, dst, d = np.array([1, 1, 1, 1, 2]), np.array([9, 8, 9, 7, 1]), np.array([0.5, 0.1, 0.5, 0.9, 3.0])
    assert sorted(zip(src[(p := descent.best_updates(src, dst, d, 2))].tolist(), dst[p].tolist(), strict=True)) == [(1, 8), (1, 9), (2, 1)]
