"""Few blocks are walked by several tasks, each for a share of the queries."""

from pyspark.sql import functions as F

from quiver.operators import graph_block
from quiver.schema import queries_from
from tests.test_expand import rows_of, table


def test_few_blocks_are_walked_by_several_tasks(spark, monkeypatch):
    v = table(spark, n=200)
    index = graph_block.build_shards(v, 4, 8, shards=2, shard=F.pmod("id", F.lit(2)), n_seeds=4)
    used, keep = [], graph_block._shard_kernel
    monkeypatch.setattr(graph_block, "_shard_kernel", lambda bc, args, only, flagged, shares=1: used.append(shares) or keep(bc, args, only, flagged, shares))
    got = rows_of(index.search(queries_from(v), 5, where=F.col("i32v") < 50))
    assert used == [max(1, spark.sparkContext.defaultParallelism // 2)]
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 1))
    assert rows_of(index.search(queries_from(v), 5, where=F.col("i32v") < 50)) == got and used[-1] == 1
