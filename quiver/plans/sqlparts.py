"""DuckDB twins of the fixture views and search plans, for the oracle checks."""

from __future__ import annotations

from quiver.schema import VECTORS_SQL

V = f"v AS ({VECTORS_SQL})"

DIST_SQL = {
    "l2": "list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))",
    "l2sq": "power(list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 2)",
    "cosine": "list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))",
    "ip": "list_negative_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))",
}


def dist(metric: str, a: str, b: str) -> str:
    return DIST_SQL[metric].format(a=a, b=b)


def knn_cte(name: str, k: int, metric: str = "l2", corpus_filter: str | None = None, queries: str = "v",
            corpus: str = "v") -> str:
    """CTE ``name(qid, id, d, rk)``: exact top-k of every query row."""
    w = f"WHERE {corpus_filter}" if corpus_filter else ""
    d = dist(metric, "q.embed", "c.embed")
    return (
        f"{name} AS (SELECT qid, id, d, rk FROM (SELECT q.id AS qid, c.id AS id, {d} AS d, "
        f"row_number() OVER (PARTITION BY q.id ORDER BY {d} NULLS LAST, c.id) AS rk "
        f"FROM {queries} q CROSS JOIN (SELECT * FROM {corpus} c {w}) c) WHERE rk <= {k})"
    )


def ranked_select(src: str) -> str:
    return f"SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM {src}"


def label_centroids_cte(name: str = "cen") -> str:
    return (
        f"{name} AS (SELECT list_id, list(CAST(x AS FLOAT) ORDER BY pos) AS centroid FROM ("
        "SELECT list_id, pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM ("
        "SELECT label AS list_id, unnest(range(len(embed))) AS pos, unnest(embed) AS x FROM v) "
        "GROUP BY list_id, pos) GROUP BY list_id)"
    )


def assign_cte(name: str = "asg", cen: str = "cen", src: str = "v") -> str:
    d = dist("l2", "r.embed", "c.centroid")
    return (
        f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT r.*, c.list_id, "
        f"row_number() OVER (PARTITION BY r.id ORDER BY {d}, c.list_id) AS rn FROM {src} r CROSS JOIN {cen} c) WHERE rn = 1)"
    )


def probes_cte(name: str, n_probes: int, cen: str = "cen", queries: str = "v") -> str:
    d = dist("l2", "q.embed", "c.centroid")
    return (
        f"{name} AS (SELECT qid, list_id FROM (SELECT q.id AS qid, c.list_id, "
        f"row_number() OVER (PARTITION BY q.id ORDER BY {d}, c.list_id) AS pr FROM {queries} q CROSS JOIN {cen} c) "
        f"WHERE pr <= {n_probes})"
    )


def ivf_search_cte(name: str, k: int, n_probes: int, corpus_filter: str | None = None, metric: str = "l2", queries: str = "v") -> str:
    """IVF search over label centroids; needs ``cen`` and ``asg`` CTEs."""
    w = f"AND {corpus_filter}" if corpus_filter else ""
    d = dist(metric, "q.embed", "c.embed")
    return (
        probes_cte(f"{name}_pr", n_probes, queries=queries)
        + f", {name} AS (SELECT qid, id, d, rk FROM (SELECT q.id AS qid, c.id AS id, {d} AS d, "
        f"row_number() OVER (PARTITION BY q.id ORDER BY {d} NULLS LAST, c.id) AS rk "
        f"FROM {queries} q JOIN {name}_pr p ON p.qid = q.id JOIN asg c ON c.list_id = p.list_id WHERE TRUE {w}) WHERE rk <= {k})"
    )
