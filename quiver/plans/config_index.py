"""Build the index a JSON run configuration describes (``index.type``, ``op_type``,
``lists`` / ``n_lists``, ``m``, ``bits_per_code``, graph degrees, ``quantization``
or top-level ``qtype``, ``env.probe_limit``, ``env.kmeans_train_percent``).

Every index returned has ``.search(queries, k, where=..., flag=...)`` returning
``(qid, id, d, rk)``; ``bruteforce`` is the table itself (exact search).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.vector import dequantize, quantize
from quiver.operators import codes, graph, graph_block, ivf, knn, pq
from quiver.schema import Config


@dataclass
class ExactIndex:
    """Brute-force "index": exact search over the table."""

    table: DataFrame
    metric: str = "l2"
    distribution: str = "sharded"

    def search(self, queries: DataFrame, k: int, where: Column | None = None, flag: Column | None = None, **kw):
        return knn.knn(self.table, queries, k, self.metric, where=where, flag=flag, distribution=self.distribution, **kw)


def quantize_vectors(df: DataFrame, quantization: str | None, vec_col: str = "embed") -> DataFrame:
    """Stored-vector precision of a config: fp32 as is, fp16 rounded to half, int8/uint8 affine round trip."""
    qt = (quantization or "float32").lower()
    if qt in ("float32", "fp32", "float"):
        return df
    if qt in ("float16", "fp16", "half"):
        return df.withColumn(vec_col, quantize(vec_col, F.lit(0.0), F.lit(0.0), "fp16"))
    if qt in ("int8", "uint8"):
        r = df.agg(F.min(F.array_min(vec_col)).alias("lo"), F.max(F.array_max(vec_col)).alias("hi")).first()
        lo, hi = F.lit(float(r["lo"])), F.lit(float(r["hi"]))
        return df.withColumn(vec_col, dequantize(quantize(vec_col, lo, hi, qt), lo, hi, qt))
    raise ValueError(f"unknown quantization {quantization!r}")


def load_config(text_or_dict) -> tuple[Config, dict]:
    raw = json.loads(text_or_dict) if isinstance(text_or_dict, str) else dict(text_or_dict)
    return Config.from_json(json.dumps(raw)), raw


def build_from_config(df: DataFrame, config, *, path: str | None = None, seed: int = 42, shards: int = 4):
    """Build the configured index over ``df`` (``id, embed`` and metadata columns).

    ``distribution_mode`` (K8): ``sharded`` builds ``shards`` independent sub-indexes (for graphs more, where blocks need it)
    whose results are merged; ``single`` and ``replicated`` build one, which a search sends to every task where it
    fits the broadcast budget (graph) or scans where it lies.
    """
    cfg, raw = load_config(config)
    idx_raw = raw.get("index", {}) if isinstance(raw.get("index"), dict) else {}
    kind = cfg.index.type.lower()
    metric = cfg.metric
    quant = idx_raw.get("quantization") or raw.get("qtype")
    data = quantize_vectors(df, quant)
    given = idx_raw.get("distribution_mode") or raw.get("mode")
    dist = (given or "sharded").lower()
    if dist not in ("single", "sharded", "replicated"):
        raise ValueError(f"unknown distribution mode {dist!r}")
    split = shards if given and dist == "sharded" else 1
    if kind in ("bruteforce", "brute_force", "flat"):
        if (quant or "").lower() in codes.NAMES:  # kept as codes of that precision
            return codes.build_coded(df, quant, metric, keep_vectors=False, path=path)
        return ExactIndex(data, metric, "sharded" if dist == "single" else dist)
    if kind == "ivfflat":
        n = cfg.dataset_size or df.count()
        return ivf.build_ivf(data, cfg.index.lists or ivf.lists_rule(n), metric, train_percent=cfg.kmeans_train_percent,
                             n_probes=cfg.probes, seed=seed, path=path, shards=split)
    if kind == "ivfpq":
        n = cfg.dataset_size or df.count()
        dim = cfg.dimension or int(df.select(F.size("embed")).first()[0])
        index = pq.build_ivfpq(data, cfg.index.m or 4, dim, lists=cfg.index.lists or ivf.lists_rule(n),
                               bits=cfg.index.bits_per_code, metric=metric, train_percent=cfg.kmeans_train_percent,
                               n_probes=cfg.probes, seed=seed, shards=split)
        return pq.save_ivfpq(index, path) if path else index
    if kind in ("cagra", "hnsw"):
        if kind == "hnsw":
            p = graph.hnsw_params(idx_raw.get("m", 100), idx_raw.get("ef_construction", 400), idx_raw.get("ef_search", 200))
        else:
            p = {"graph_degree": cfg.index.graph_degree, "intermediate_graph_degree": cfg.index.intermediate_graph_degree,
                 "itopk": cfg.index.itopk_size}
        width = {"search_width": cfg.index.search_width} if cfg.index.search_width else {}
        if split > 1:
            n, dim = knn._vector_stats(data, "embed")
            need = -(-n * (dim * 4 + p["graph_degree"] * 4 + 8) // graph_block.BLOCK_BYTES)
            return graph_block.build_shards(data, p["graph_degree"], p["intermediate_graph_degree"], metric, shards=max(split, need),
                                            path=path, itopk=p["itopk"], **width)
        g = graph.build_graph(data, p["graph_degree"], p["intermediate_graph_degree"], metric, itopk=p["itopk"], **width)
        return graph.save_graph(g, path) if path else g
    raise ValueError(f"unknown index type {cfg.index.type!r}")
