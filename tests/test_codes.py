"""Stored codes: smaller, and no neighbour lost."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.operators import codes
from quiver.operators.knn import knn
from quiver.operators.topk_kernel import exact
from quiver.schema import queries_from
from tests.test_expand import rows_of, table


@pytest.mark.parametrize("metric", ["l2", "l2sq", "ip", "cosine"])
@pytest.mark.parametrize("qtype", ["fp16", "int8", "uint8"])
def test_same_as_exact(spark, metric, qtype):
    v = table(spark, n=250).repartition(5, "id")
    q = queries_from(v.where("id < 40"))
    index = codes.build_coded(v, qtype, metric)
    assert rows_of(index.search(q, 6)) == rows_of(knn(v, q, 6, metric))
    few = F.col("i32v") < 20
    if metric == "l2":
        assert rows_of(index.search(q, 6, where=few)) == rows_of(knn(v, q, 6, metric, where=few))
        assert rows_of(index.search(q, 6, broadcast_bytes=2_000)) == rows_of(knn(v, q, 6, metric))
        flagged = index.search(q, 6, flag=few)
        assert flagged.count() == 240 and flagged.where("ok").count() == knn(v, q, 6, flag=few).where("ok").count()
        assert index.search(q, 400).count() == 40 * 250


def test_codes_alone_and_bytes_on_disk(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 64)).astype(np.float32))], "id long, embed array<float>").coalesce(1)
    size = {}
    for qtype in ("fp16", "int8"):
        codes.build_coded(v, qtype, path=f"{tmp_path}/{qtype}")
        for part in ("codes", "vectors"):
            folder = f"{tmp_path}/{qtype}/{part}"
            size[qtype, part] = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
    assert size["fp16", "codes"] < 0.56 * size["fp16", "vectors"] and size["int8", "codes"] < 0.31 * size["int8", "vectors"]
    alone = codes.build_coded(v, "int8", keep_vectors=False, path=f"{tmp_path}/alone")
    assert alone.vectors is None and not os.path.exists(f"{tmp_path}/alone/vectors")
    q = queries_from(v.where("id < 20"))
    got, want = ({(r[0], r[2]) for r in rows_of(x)} for x in (alone.search(q, 10), knn(v, q, 10)))
    assert len(got & want) > 0.9 * len(want)
    assert codes.build_coded(v.limit(0), "int8").search(q, 3).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["l2", "l2sq", "ip", "cosine"]), st.sampled_from(["fp16", "int8", "uint8"]), st.integers(0, 10**6))
def test_true_distances_lie_within_the_bounds(metric, kind, seed):
    rng = np.random.default_rng(seed)
    X, Q = rng.normal(size=(20, 6)) * rng.choice([0.1, 1, 30]), rng.normal(size=(4, 6))
    X[0], X[1] = 0, X[1] * 1e-3
    codec = codes.Codec(kind, float(X.min()), float(X.max() - X.min()) / codes.STEPS)
    back = codec.decode(codec.encode(X).view(np.uint8).ravel()).reshape(X.shape)
    err = np.sqrt(((X - back) ** 2).sum(1))
    true, coded = (exact(metric, Q, np.repeat(y[None], 4, axis=0)) for y in (X, back))
    low, high = codes.error_bound(metric, Q, coded, back, err)
    fine = np.isfinite(true)
    assert (low[fine] <= true[fine] + 1e-9).all() and (true[fine] <= high[fine] + 1e-9).all()
