"""NN-descent against the exact neighbour lists."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import descent, graph
from quiver.operators.knn import knn
from quiver.schema import vectors
from tests.test_graph_block import rows_of, table


def test_recall_on_the_drivers_vectors(spark, monkeypatch):
    monkeypatch.setattr(descent, "CELL_ROWS", 200)  # many cells, as at scale
    v = vectors(spark, "/root/testdata/sf0.1")
    truth = graph.knn_edges(v, 16).checkpoint()
    edges = descent.nn_descent(v, 16).checkpoint()
    assert edges.count() == 16 * v.count() and edges.where("src = dst").count() == 0
    assert edges.groupBy("src", "dst").count().where("count > 1").count() == 0
    assert descent.edge_recall(descent.start_lists(v, 16, "l2", 42), truth) < 0.6
    assert descent.edge_recall(edges, truth) >= 0.95


def test_a_graph_of_it_finds_neighbours(spark, monkeypatch):
    monkeypatch.setattr(descent, "CELL_ROWS", 60)
    v = table(spark, n=300, seed=8)
    q = v.where("id < 100").select(F.col("id").alias("qid"), "embed")
    want = {(r[0], r[2]) for r in rows_of(knn(v, q, 5))}
    got = graph.build_graph(v, 8, 16, neighbours="descent", itopk=32).search(q, 5)
    assert len({(r[0], r[2]) for r in rows_of(got)} & want) > 0.9 * len(want)


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_few_rows_are_exact(spark, metric):
    v = table(spark, n=40, seed=9).where("id <> 16")
    got, want = (sorted(map(tuple, e.select("src", "dst", "rank").collect())) for e in (descent.nn_descent(v, 5, metric), graph.knn_edges(v, 5, metric)))
    assert got == want


def test_one_row_has_no_neighbours(spark):
    assert descent.nn_descent(table(spark, n=1), 5).count() == 0
