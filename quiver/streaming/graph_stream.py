"""I14 for graph indexes: a kNN graph that takes inserts and deletes from a stream.

The graph is a folder of append-only tables, a sub-folder per micro-batch::

    vectors/batch=N     id, embed and attributes of inserted rows (the latest batch of an id holds)
    edges/batch=N       src, dst, rank: the whole list of every node the batch touched (likewise)
    tombstones/batch=N  ids deleted by the batch
    commits/N           written last; a batch without it is not read, a replayed one is overwritten

Insert: the new vectors are searched in the graph as it stands (their candidates), and among themselves;
each keeps the ``degree`` candidates with fewest detours (a detour s -> z -> d has both legs shorter than s -> d).
Nodes that thereby get reversed edges, and no others, are pruned again with them; a new node's ``SURE`` nearest neighbours keep
an edge to it, so it can be reached. Delete: a tombstone, through which walks still pass. ``compact`` writes
one clean batch: superseded rows go, and nodes that pointed at deleted ones get those nodes' neighbours as candidates instead.

Work per batch follows the batch and the nodes it touches, not the graph; a hub's reversed edges are cut to ``degree``
by a partial ``row_number`` before the shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vector import resolve_metric
from quiver.operators import graph, ivf
from quiver.operators.knn import knn, rank_partials
from quiver.operators.topk_kernel import exact, vectors_from_arrow
from quiver.session import ensure_checkpoint_dir, scratch_dir

SURE = 2


class LiveGraph(graph.GraphIndex):
    """A graph with tombstones: walks pass deleted nodes, results leave them out."""

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None, **kw) -> DataFrame:
        live = ~F.col("deleted")
        if flag is None or where is not None:
            return super().search(queries, k, where=live if where is None else live & where, **kw)
        out = super().search(queries, k, where=live, **kw)
        return out.join(self.marks(flag), "id").select("qid", "id", "d", "rk", "ok")


def _prune_kernel(degree: int, metric: str):
    def kernel(batches):
        import pyarrow as pa

        for rb in batches:
            out = [[], [], []]
            for src, own, members in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2), strict=True):
                m = members.values
                ids, sure = m.field("dst").to_numpy(), m.field("sure").to_numpy(zero_copy_only=False).astype(bool)
                X = vectors_from_arrow(m.field("embed"))
                d = exact(metric, own.values.to_numpy(zero_copy_only=False).astype(np.float64)[None], X[None])[0]
                order = np.lexsort((ids, np.where(np.isnan(d), np.inf, d)))
                ids, sure, X, d = ids[order], sure[order], X[order], d[order]
                D = exact(metric, X, np.broadcast_to(X, (len(X), *X.shape)))
                detours = ((d[:, None] < d[None, :]) & (D < d[None, :])).sum(axis=0)
                first = sure & (np.cumsum(sure) <= max(1, degree // 2))
                keep = np.lexsort((np.arange(len(ids)), detours, ~first))[:degree]
                out[0].append(np.full(len(keep), src))
                out[1].append(ids[keep])
                out[2].append(np.arange(1, len(keep) + 1))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t), k) for x, t, k in zip(out, ("i8", "i8", "i4"), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["src", "dst", "rank"])

    return kernel


def pruned(candidates: DataFrame, vectors: DataFrame, degree: int, metric: str) -> DataFrame:
    """``(src, dst, rank)`` from ``candidates(src, dst, sure)``, bounded per node; ``vectors(id, embed)``."""
    one = candidates.where("src <> dst").groupBy("src", "dst").agg(F.max("sure").alias("sure"))
    near = one.join(vectors.select(F.col("id").alias("dst"), "embed"), "dst")
    lists = near.groupBy("src").agg(F.collect_list(F.struct("dst", "embed", "sure")).alias("members"))
    rows = lists.join(vectors.select(F.col("id").alias("src"), F.col("embed").alias("own")), "src")
    return rows.select("src", "own", "members").mapInArrow(_prune_kernel(degree, metric), "src long, dst long, rank int")


@dataclass
class GraphStore:
    """The folder; ``create`` starts one, every other call reads what is committed."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, *, graph_degree: int = 64, candidates: int = 128, metric: str = "l2",
               itopk: int = 128, search_width: int = 4, n_seeds: int = 16, max_iter: int = 32, seed: int = 42) -> GraphStore:
        """An empty graph over rows of ``schema`` (id, embed and attributes)."""
        meta = {"degree": graph_degree, "candidates": candidates, "metric": resolve_metric(metric), "schema": schema.jsonValue(), "first": 0,
                "search": {"itopk": itopk, "search_width": search_width, "n_seeds": n_seeds, "max_iter": max_iter, "seed": seed}}
        ivf._write_text(spark, f"{path.rstrip('/')}/meta.json", json.dumps(meta))
        return cls(spark, path.rstrip("/"))

    @property
    def meta(self) -> dict:
        return json.loads(ivf._read_text(self.spark, f"{self.path}/meta.json"))

    def commits(self) -> list[int]:
        """The committed batches in force, in order."""
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [int(s.getPath().getName()) for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        return sorted(n for n in names if n >= self.meta["first"])

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """All rows of the committed batches, with their ``batch``."""
        at = [n for n in self.commits() if ivf.exists(self.spark, f"{self.path}/{name}/batch={n}/_SUCCESS")]
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not at:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/batch={n}" for n in at))

    def _latest(self, rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("batch"))
        return rows.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")

    def _write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={batch}")

    def _commit(self, batch: int) -> None:
        ivf._write_text(self.spark, f"{self.path}/commits/{batch}", "")

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows (with ``batch`` and ``deleted``), edges and tombstones as they hold now."""
        meta = self.meta
        rows = self._latest(self._read("vectors", T.StructType.fromJson(meta["schema"])), "id")
        edges = self._latest(self._read("edges", T._parse_datatype_string("src long, dst long, rank int")), "src")
        gone = self._read("tombstones", T._parse_datatype_string("id long")).groupBy("id").agg(F.max("batch").alias("gone"))
        rows = rows.join(gone, "id", "left").withColumn("deleted", F.coalesce(F.col("gone") > F.col("batch"), F.lit(False)))
        return rows.drop("gone"), edges.drop("batch"), gone

    def load(self) -> LiveGraph:
        """The graph as it is committed now."""
        rows, edges, _ = self._tables()
        return LiveGraph(rows.select("id", "embed"), edges, self.meta["metric"], attributes=rows.drop("embed", "batch"), **self.meta["search"])

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Adds ``rows`` (ids unique; an id that is there gets its new vector) as micro-batch ``batch``."""
        ensure_checkpoint_dir(self.spark)
        meta, commits = self.meta, self.commits()
        if batch in commits:
            return
        metric, degree, n_near = meta["metric"], meta["degree"], meta["candidates"]
        rows = self._write(rows.select(*[f["name"] for f in meta["schema"]["fields"]]), "vectors", batch)
        new = rows.select("id", "embed")
        if new.isEmpty():
            self._commit(batch)
            return
        q = new.select(F.col("id").alias("qid"), "embed")
        near = knn(new, q, n_near + 1, metric).select("qid", "id", "d")
        vectors, edges, held_graph, kept = new, None, None, scratch_dir(self.spark, "graph-near")
        if commits:
            held, edges, _ = self._tables()
            old = held.select("id", "embed").join(new.select("id"), "id", "left_anti")
            vectors = old.unionByName(new)
            held_graph = self.load()
            found = graph.GraphIndex.search(held_graph, q, n_near).select("qid", "id", "d")
            near = near.unionByName(found.join(new.select("id"), "id", "left_anti").select("qid", "id", "d"))
        near = rank_partials(near.where("qid <> id"), n_near)
        near.write.parquet(kept)  # the searches run once, and their graph goes
        near = self.spark.read.schema(near.schema).parquet(kept)
        if held_graph is not None:
            held_graph.release()
        forward = pruned(near.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.lit(False).alias("sure")), vectors, degree, metric)
        forward = forward.checkpoint(eager=True)
        back = forward.join(near.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "d", "rk"), ["src", "dst"])
        w = Window.partitionBy("dst").orderBy(F.col("d").asc_nulls_last(), "src")
        back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree)
        back = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("rk") <= SURE).alias("sure")).checkpoint(eager=True)
        touched = back.select("src").distinct()
        own = forward.select("src", "dst")
        if edges is not None:
            own = own.unionByName(edges.join(new.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
        again = own.join(touched, "src", "left_semi").select("src", "dst", F.lit(False).alias("sure")).unionByName(back)
        after = pruned(again, vectors, degree, metric).unionByName(forward.join(touched, "src", "left_anti").select("src", "dst", "rank"))
        self._write(after, "edges", batch)
        self._commit(batch)
        ivf.drop_index(self.spark, kept)

    def delete(self, ids: DataFrame, batch: int) -> None:
        """Marks ``ids(id)`` as deleted from micro-batch ``batch`` on."""
        if batch not in self.commits():
            self._write(ids.select(F.col("id").cast("long").alias("id")).distinct(), "tombstones", batch)
            self._commit(batch)

    def compact(self) -> None:
        """One clean batch in place of all committed ones: deleted nodes go, their neighbours stand in for them."""
        commits, meta = self.commits(), self.meta
        if not commits:
            return
        rows, edges, _ = self._tables()
        batch = commits[-1] + 1
        live = rows.where(~F.col("deleted")).select(*[f["name"] for f in meta["schema"]["fields"]])
        live = self._write(live, "vectors", batch)
        ensure_checkpoint_dir(self.spark)
        dead = rows.where("deleted").select(F.col("id").alias("dst")).checkpoint(eager=True)
        edges = edges.checkpoint(eager=True)  # read several times below
        kept = edges.join(live.select(F.col("id").alias("src")), "src", "left_semi")
        broken = kept.join(dead, "dst", "left_semi").select("src", F.col("dst").alias("via")).checkpoint(eager=True)
        around = broken.join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")  # degree x degree a node at most
        sound = kept.join(dead, "dst", "left_anti")
        mended = sound.select("src", "dst").unionByName(around.join(live.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        mended = mended.join(broken.select("src").distinct(), "src", "left_semi").withColumn("sure", F.lit(False))
        whole = sound.join(broken.select("src").distinct(), "src", "left_anti").select("src", "dst", "rank")
        self._write(whole.unionByName(pruned(mended, live, meta["degree"], meta["metric"])), "edges", batch)
        self._commit(batch)
        ivf._write_text(self.spark, f"{self.path}/meta.json", json.dumps(meta | {"first": batch}))  # from here on the old batches are not read
        for n in commits:
            for name in ("vectors", "edges", "tombstones", "commits"):
                ivf.drop_index(self.spark, f"{self.path}/{name}/{n}" if name == "commits" else f"{self.path}/{name}/batch={n}")


def maintain_graph(stream: DataFrame, store: GraphStore, checkpoint: str, available_now: bool = True):
    """Every micro-batch of the stream is inserted; a batch that is replayed after a failure changes nothing.

    A batch's number in the store follows the last one committed there before the stream began, plus its id.
    """
    meta = store.meta
    if "stream_base" not in meta:
        meta["stream_base"] = max(store.commits(), default=-1) + 1
        ivf._write_text(store.spark, f"{store.path}/meta.json", json.dumps(meta))
    ws = stream.writeStream.foreachBatch(lambda rows, n: store.insert(rows, meta["stream_base"] + n)).option("checkpointLocation", checkpoint)
    return (ws.trigger(availableNow=True) if available_now else ws).start()
