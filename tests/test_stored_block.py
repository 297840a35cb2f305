"""A graph searched as one block: tasks write and read it, the driver holds the ids alone."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import graph, graph_block, packed
from tests.test_graph_block import queries, rows_of, table


def test_driver_collects_neither_vectors_nor_edges(spark, monkeypatch):
    v = table(spark, n=80)
    g = graph.build_graph(v, 4, 8, itopk=12, n_seeds=5)
    q, kinds, keep = queries(v), [], type(v).toArrow

    def watched(df):
        kinds.extend(f.dataType.simpleString() for f in df.schema.fields)
        return keep(df)

    monkeypatch.setattr(type(v), "toArrow", watched)
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or send(x))
    found = g.search(q, 3, where=F.col("tag") < 5)
    assert found.count() > 0 and kinds and "array<float>" not in kinds and kinds.count("bigint") <= 2  # ids, and the filter's marks
    assert not [x for s in sent for x in (s if isinstance(s, tuple) else (s,)) if isinstance(x, graph_block.Block)]
    path = g._block.path.removeprefix("file:")
    assert os.path.exists(path)
    g.release()
    assert not os.path.exists(path)


def test_block_is_the_tables(spark, monkeypatch):
    monkeypatch.setattr(packed, "FILE_BYTES", 700)  # several files
    v = table(spark, n=120).repartition(5)
    ids = sorted(r["id"] for r in v.collect())
    edges = [(s, ids[(i * 7 + r * 11) % 120], r) for i, s in enumerate(ids) for r in range(1, i % 4 + 1)] + [(ids[0], 10**6, 1)]  # none to three a node; one that leads nowhere
    e = spark.createDataFrame(edges, "src long, dst long, rank int").repartition(4)
    block = graph_block.StoredBlock.write(v, e, [ids[5], ids[2]], 120 * 40).load()
    assert len(os.listdir(graph_block.StoredBlock.write(v, e, [], 120 * 40).path.removeprefix("file:"))) > 6
    vecs = {r["id"]: r["embed"] for r in v.collect()}
    assert block.ids.tolist() == ids and block.seeds.tolist() == [2, 5] and np.array_equal(block.X, np.array([vecs[i] for i in ids], np.float32))
    want = {s: [d if d in vecs else None for _, d in sorted((r, d) for x, d, r in edges if x == s)] for s in ids}
    assert block.edges.shape == (120, 3)
    for i, s in enumerate(ids):
        got = [ids[d] if d >= 0 else None for d in block.edges[i]]
        assert got == want[s] + [None] * (3 - len(want[s]))


def test_searches_after_release_and_null_vectors(spark):
    v = table(spark, n=60)
    g = graph.build_graph(v, 4, 8, itopk=12, n_seeds=5)
    before = rows_of(g.search(queries(v), 3))
    g.release()
    assert rows_of(g.search(queries(v), 3)) == before
    null = graph.GraphIndex(v.withColumn("embed", F.when(F.col("id") > 4, F.col("embed"))).select("id", "embed"), g.edges)
    with pytest.raises(Exception, match="NULL vector"):
        null.search(queries(v), 3).count()
