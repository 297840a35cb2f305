"""Chunks into an index that is built or not yet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import ivf, knn
from quiver.operators.chunks import ChunkedIvf
from quiver.schema import queries_from, vectors
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted((r["qid"], r["rk"], r["id"], round(r["d"], 9)) for r in df.collect())


def test_chunks_equal_one_build_and_read_no_earlier_chunk(spark, tmp_dir):
    v = vectors(spark, SF_SMALL)
    cen, third = ivf.centroids_from_labels(v), lambda r: v.where(F.pmod("id", F.lit(3)) == r)
    one = ivf.build_ivf(v, metric="l2", centroids=cen, n_probes=2)
    c = ChunkedIvf(spark, f"{tmp_dir}/c")
    c.add("a", third(0))
    c.add("a", third(0))  # a retry
    c.add("none", v.limit(0))
    c.build(n_probes=2, centroids=cen)
    with pytest.raises(ValueError):
        c.build()
    assert not c.chunks("staged") and not c.chunks("sample")
    again = ChunkedIvf(spark, f"{tmp_dir}/c", metric="cosine")  # what the index holds is taken
    again.add("b", third(1))
    again.add("c", third(2))
    again.add("c", third(2))
    again.add("late-none", v.limit(0))
    index = again.index()
    q = queries_from(v)
    assert index.metric == "l2" and index.lists.count() == v.count()
    assert _rows(index.search(q, 10)) == _rows(one.search(q, 10))
    few = F.col("i32v") < 50
    assert _rows(index.search(q, 10, where=few)) == _rows(one.search(q, 10, where=few))
    np.testing.assert_allclose(index.radii(), one.radii())


def test_sample_is_the_same_however_rows_are_dealt(spark, tmp_dir):
    v = vectors(spark, SF_SMALL)
    samples = []
    for n in (1, 4):
        c = ChunkedIvf(spark, f"{tmp_dir}/s{n}", sample_rows=20)
        for r in range(n):
            c.add(f"c{r}", v.where(F.pmod("id", F.lit(n)) == r))
        samples.append(sorted(r["id"] for r in c.sample().collect()))
    assert samples[0] == samples[1] and len(set(samples[0])) == 20
    index = c.build(lists=4, n_probes=4)  # trained on the sample; all lists probed: exact
    assert _rows(index.search(queries_from(v), 5)) == _rows(knn.knn(v, queries_from(v), 5))


def test_names_and_empty(spark, tmp_dir):
    c = ChunkedIvf(spark, f"{tmp_dir}/n")
    with pytest.raises(ValueError):
        c.build()
    with pytest.raises(ValueError):
        c.add("a/b", spark.range(1))
    v = vectors(spark, SF_SMALL)
    c.add("e", v.limit(0))
    index = c.build(centroids=ivf.centroids_from_labels(v))
    assert index.search(queries_from(v), 3).count() == 0
