"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect). Every
query is first run once at sf0.001 to warm code paths and Python workers, so
the figures are steady-state times. ``index_vs_exact`` reports, for the full
run, build + search time and recall@10 of IVF, PQ and the kNN graph against
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "knn_l2",            # K2: exact top-10 of every vector (self-queries), Arrow kernel + partial top-k
    "knn_cosine",
    "knn_normal_filtered",
    "knn_post",
    "ivf_search",        # I3: probe 3 lists, exact rank inside
    "pq_search",         # I5: table-lookup distances over PQ codes
    "graph_search",      # I7: beam search over the pruned graph
    "graph_build_exact",  # I6
    "recall_by_mode",    # R9
    "recall_gt_k",       # R2 through IVF
    "mix_batch",         # T10
    "gen_fast",          # S7
    "log_throughput",    # M1 over the run log
]


def index_vs_exact(spark, sf_dir: str) -> dict:
    """Time (build + search, seconds) and recall@10 against exact search of IVF (I3), PQ (I5), graph."""
    from pyspark.sql import functions as F  # noqa: F401

    from quiver.operators import knn, recall
    from quiver.plans import catalog as C
    from quiver.schema import queries_from, vectors

    v = vectors(spark, sf_dir).cache()
    qs = queries_from(v)
    out = {}
    t0 = time.perf_counter()
    exact = knn.knn(v, qs, C.K, "l2").cache()
    exact.count()
    out["exact"] = {"sec": round(time.perf_counter() - t0, 3), "recall": 1.0}
    gt = recall.gt_from_results(exact)
    runs = {
        "ivf_probe3": lambda: C.label_index(v).search(qs, C.K),
        "pq_m8": lambda: C._pq_index(v).search(qs, C.K),
        "graph": lambda: C._graph_index(v).search(qs, C.K),
    }
    for name, fn in runs.items():
        t0 = time.perf_counter()
        res = fn().cache()
        res.count()
        sec = time.perf_counter() - t0
        r = recall.gt_recall(res, gt, C.K, qs.select("qid")).first()["recall_rate"]
        out[name] = {"sec": round(sec, 3), "recall": round(float(r), 4)}
        res.unpersist()
    exact.unpersist()
    v.unpersist()
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from quiver.plans.catalog import QUERIES
    from quiver.session import get_session

    spark = get_session()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # Warm-up on the smallest scale: JVM code paths, ML classes and the
    # Python workers of every kernel type, so timings are steady state.
    for n in names:
        QUERIES[n](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)

    recall = {}
    for n in ("recall_gt_k", "recall_by_mode"):
        if n in QUERIES:
            rows = QUERIES[n](spark, sf_dir).collect()
            recall[n] = [r.asDict() for r in rows]

    versus = index_vs_exact(spark, sf_dir) if not sys.argv[1:] else {}

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": os.environ.get("BENCH_CPUS", "8"),
        "recall": recall,
        "index_vs_exact": versus,
    }, default=str))


if __name__ == "__main__":
    main()
