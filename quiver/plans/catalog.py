"""Registered queries: each is a Spark plan over the driver tables plus, where SQL can
express it, a DuckDB twin over the same parquet tables.

Every query reads whole tables (self-queries: every stored vector is a query).
Computed columns carry the same alias on both sides; doubles are rounded to 6
digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import filters as flt
from quiver.functions import vector as vf
from quiver.operators import chunks, ivf, knn as knn_mod, recall
from quiver.plans import sqlparts as S
from quiver.schema import queries_from, vectors

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

K = 10
N_PROBES = 3
# Filters used by the reference's smoke scripts: i32v < 500 and i32v < 50.
FILTER_WIDE = 500
FILTER_NARROW = 50


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("d", 6).alias("d"), F.col("rk").cast("int").alias("rk"))


def label_index(v: DataFrame, n_probes: int = N_PROBES) -> ivf.IvfIndex:
    """IVF index over the fixture with label-mean centroids (deterministic)."""
    return ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=n_probes)


# -- V1-V4, K1, K2, I9: exact kNN per metric ------------------------------------

for _m in ("l2", "l2sq", "cosine", "ip"):

    def _q(spark, sf, _m=_m):
        v = vectors(spark, sf)
        return _ranked(knn_mod.knn(v, queries_from(v), K, _m))

    register(f"knn_{_m}", f"WITH {S.V}, {S.knn_cte('r', K, _m)} {S.ranked_select('r')}")(_q)

# -- K8: distribution modes (same result as knn_l2) ------------------------------

for _dist in ("single", "sharded", "replicated"):

    def _q(spark, sf, _dist=_dist):
        v = vectors(spark, sf)
        return _ranked(knn_mod.knn(v, queries_from(v), K, "l2", distribution=_dist))

    register(f"knn_{_dist}", f"WITH {S.V}, {S.knn_cte('r', K, 'l2')} {S.ranked_select('r')}")(_q)


@register("knn_one", f"WITH {S.V}, q AS (SELECT embed FROM v WHERE id = 7) "
          f"SELECT c.id, round({S.dist('l2', 'c.embed', 'q.embed')}, 6) AS d FROM v c, q "
          f"ORDER BY {S.dist('l2', 'c.embed', 'q.embed')}, c.id LIMIT {K}")
def _knn_one(spark, sf):
    """K1: one literal query vector (row 7 of the table), top-k by sort + limit."""
    v = vectors(spark, sf)
    qvec = v.where(F.col("id") == 7).select("embed").first()["embed"]
    return knn_mod.knn_one(v, qvec, K, "l2").select("id", F.round("d", 6).alias("d"))


# -- V5, V7, S10: vector projections ---------------------------------------------


@register("vec_norm", f"WITH {S.V} SELECT id, round(sqrt(list_inner_product(CAST(embed AS DOUBLE[]), "
          "CAST(embed AS DOUBLE[]))), 6) AS norm FROM v")
def _vec_norm(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", F.round(vf.norm("embed"), 6).alias("norm"))


@register(
    "vec_normalize",
    f"WITH {S.V}, n AS (SELECT id, embed, sqrt(list_inner_product(CAST(embed AS DOUBLE[]), CAST(embed AS DOUBLE[]))) AS nrm FROM v), "
    "u AS (SELECT id, list_transform(embed, lambda x: CAST(CAST(x AS DOUBLE) / nrm AS FLOAT)) AS u FROM n) "
    "SELECT id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, round(CAST(unnest(u) AS DOUBLE), 6) AS val FROM u",
)
def _vec_normalize(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", F.posexplode(vf.normalize("embed")).alias("pos", "val")).select(
        "id", "pos", F.round(F.col("val").cast("double"), 6).alias("val")
    )


@register(
    "vec_text_roundtrip",
    f"WITH {S.V} SELECT id, CAST(CAST(embed AS VARCHAR) AS FLOAT[]) = embed AS same, CAST(len(embed) AS INTEGER) AS dim FROM v",
)
def _vec_text(spark, sf):
    v = vectors(spark, sf)
    back = vf.parse_vector(vf.to_text("embed"))
    return v.select("id", (back == F.col("embed")).alias("same"), F.size(back).alias("dim"))


@register(
    "vec_cast",
    f"WITH {S.V}, c AS (SELECT id, list_transform(embed, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER) AS FLOAT)) AS f FROM v) "
    "SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, CAST(unnest(f) AS DOUBLE) AS val FROM c",
)
def _vec_cast(spark, sf):
    """V7: an int vector (milli-units) cast back to float32."""
    v = vectors(spark, sf)
    ints = F.transform("embed", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    return v.select("id", F.posexplode(vf.cast_vector(ints, "float")).alias("pos", "val")).select(
        "id", "pos", F.col("val").cast("double").alias("val")
    )


# -- F1-F7, S3: filters ---------------------------------------------------------

_META = "id, i32v, f32v, strv"


def _filter_query(cond_fn, sql_where):
    def q(spark, sf):
        v = vectors(spark, sf)
        return v.where(cond_fn()).select("id", "i32v", "f32v", "strv")

    return q, f"WITH {S.V} SELECT {_META} FROM v WHERE {sql_where}"


for _name, _cf, _sw in (
    ("filter_i32v", lambda: flt.where(i32v_lt=FILTER_WIDE), f"i32v < {FILTER_WIDE}"),
    ("filter_f32v", lambda: flt.where(f32v_lt=0.5), "f32v < CAST(0.5 AS FLOAT)"),
    ("filter_strv", lambda: flt.where(strv_eq="s3"), "strv = 's3'"),
    ("filter_and", lambda: flt.where(i32v_lt=FILTER_WIDE, f32v_lt=0.5, strv_eq="s3"),
     f"i32v < {FILTER_WIDE} AND f32v < CAST(0.5 AS FLOAT) AND strv = 's3'"),
):
    _fn, _sql = _filter_query(_cf, _sw)
    register(_name, _sql)(_fn)


@register("eligible_flag", f"WITH {S.V} SELECT id, (i32v < {FILTER_WIDE} AND f32v < CAST(0.5 AS FLOAT)) AS eligible FROM v")
def _eligible(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", flt.eligible(flt.where(i32v_lt=FILTER_WIDE, f32v_lt=0.5)).alias("eligible"))


@register("id_range_scan", f"WITH {S.V} SELECT {_META} FROM v WHERE id >= 100 ORDER BY id LIMIT 200")
def _id_range(spark, sf):
    """F6 + S3: ``id >= start_id``, then the first n rows in file order (the limit is the feature)."""
    from quiver.sources.text import query_set

    return query_set(vectors(spark, sf), start_id=100, n=200).select("id", "i32v", "f32v", "strv")


@register("id_in_set", f"WITH {S.V} SELECT {_META} FROM v WHERE id IN (SELECT id FROM v WHERE strv = 's5')")
def _id_in(spark, sf):
    """``id IN (subquery)`` as a semi join."""
    v = vectors(spark, sf)
    return flt.id_in(v, v.where(F.col("strv") == "s5")).select("id", "i32v", "f32v", "strv")


# -- K3-K6: search modes with filters ----------------------------------------------


def _mode_query(mode: str, cond_fn, **kw):
    def q(spark, sf):
        v = vectors(spark, sf)
        return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=cond_fn(), mode=mode, **kw))

    return q


register("knn_normal_filtered", f"WITH {S.V}, {S.knn_cte('r', K, 'l2', f'c.i32v < {FILTER_WIDE}')} {S.ranked_select('r')}")(
    _mode_query("normal", lambda: flt.where(i32v_lt=FILTER_WIDE))
)
register("knn_pre", f"WITH {S.V}, {S.knn_cte('r', K, 'l2', f'c.i32v < {FILTER_NARROW}')} {S.ranked_select('r')}")(
    _mode_query("pre", lambda: flt.where(i32v_lt=FILTER_NARROW))
)
register(
    "knn_force",
    f"WITH {S.V}, {S.knn_cte('r', K, 'l2', 'c.i32v < 500 AND c.f32v < CAST(0.5 AS FLOAT)')} {S.ranked_select('r')}",
)(_mode_query("force", lambda: flt.where(i32v_lt=FILTER_WIDE, f32v_lt=0.5)))
register(
    "knn_post",
    f"WITH {S.V}, {S.knn_cte('r0', 2 * K, 'l2')}, kept AS (SELECT r0.qid, r0.id, r0.d FROM r0 JOIN v c ON c.id = r0.id "
    f"WHERE c.i32v < {FILTER_WIDE}), r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM kept) "
    f"{S.ranked_select('r')} WHERE rk <= {K}",
)(_mode_query("post", lambda: flt.where(i32v_lt=FILTER_WIDE), oversample=2))

# -- R1-R9: recall ---------------------------------------------------------------

_RECALL_COLS = "total, eligible, correct, recall"


def _self_recall_sql(corpus_filter: str | None, elig: str) -> str:
    return (
        f"WITH {S.V}, {S.knn_cte('r', 1, 'l2', corpus_filter)} "
        f"SELECT count(*) AS total, count(*) FILTER (WHERE {elig}) AS eligible, "
        f"count(*) FILTER (WHERE {elig} AND r.id = q.id) AS correct, "
        f"CASE WHEN count(*) FILTER (WHERE {elig}) > 0 THEN CAST(count(*) FILTER (WHERE {elig} AND r.id = q.id) AS DOUBLE) "
        f"/ count(*) FILTER (WHERE {elig}) ELSE 0.0 END AS recall FROM v q LEFT JOIN r ON r.qid = q.id"
    )


def _round_recall(df: DataFrame, col: str = "recall") -> DataFrame:
    return df.withColumn(col, F.round(col, 6))


@register("recall_self", _self_recall_sql(None, "TRUE"))
def _recall_self(spark, sf):
    v = vectors(spark, sf)
    res = knn_mod.knn(v, queries_from(v), 1, "l2")
    return recall.self_recall(res, v.withColumnRenamed("id", "qid")).select("total", "eligible", "correct", "recall")


@register("recall_self_filtered", _self_recall_sql(f"c.i32v < {FILTER_WIDE}", f"q.i32v < {FILTER_WIDE}"))
def _recall_self_f(spark, sf):
    v = vectors(spark, sf)
    cond = flt.where(i32v_lt=FILTER_WIDE)
    res = knn_mod.search(v, queries_from(v), 1, "l2", where=cond, mode="normal")
    return recall.self_recall(res, v.withColumnRenamed("id", "qid"), cond).select("total", "eligible", "correct", "recall")


def _gt_sql(k: int) -> str:
    if k == 1:
        hit = "SELECT r.qid FROM r JOIN g ON g.qid = r.qid AND g.id = r.id AND g.rk = 1 WHERE r.rk = 1"
    else:
        hit = "SELECT r.qid FROM r JOIN g ON g.qid = r.qid AND g.id = r.id"
    return (
        f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.knn_cte('g', k, 'l2')}, {S.ivf_search_cte('r', k, N_PROBES)}, "
        f"h AS ({hit}) SELECT count(*) AS total_queries, CAST(coalesce(sum(c), 0) AS BIGINT) AS correct_hits, "
        f"round(CAST(coalesce(sum(c), 0) AS DOUBLE) / (count(*) * {k}), 6) AS recall_rate, {k} AS k "
        "FROM (SELECT v.id AS qid, (SELECT count(*) FROM h WHERE h.qid = v.id) AS c FROM v)"
    )


def _gt_query(k: int):
    def q(spark, sf):
        v = vectors(spark, sf)
        qs = queries_from(v)
        gt = recall.gt_from_results(knn_mod.knn(v, qs, k, "l2"))
        res = label_index(v).search(qs, k)
        return _round_recall(recall.gt_recall(res, gt, k, qs.select("qid")), "recall_rate").select(
            "total_queries", "correct_hits", "recall_rate", "k"
        )

    return q


register("recall_gt_k", _gt_sql(K))(_gt_query(K))
register("recall_gt_1", _gt_sql(1))(_gt_query(1))


@register(
    "recall_index",
    f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.ivf_search_cte('r', 1, N_PROBES)} "
    "SELECT count(*) AS total, count(*) AS eligible, count(*) FILTER (WHERE r.id = q.id) AS correct, "
    "round(CAST(count(*) FILTER (WHERE r.id = q.id) AS DOUBLE) / count(*), 6) AS recall FROM v q LEFT JOIN r ON r.qid = q.id",
)
def _recall_index(spark, sf):
    """Own id first through the IVF index, over all queries."""
    v = vectors(spark, sf)
    res = label_index(v).search(queries_from(v), 1)
    return _round_recall(recall.self_recall(res, v.withColumnRenamed("id", "qid"), check_eligible=False)).select(
        "total", "eligible", "correct", "recall"
    )


def _by_mode_sql() -> str:
    f = f"c.i32v < {FILTER_WIDE}"
    elig = f"q.i32v < {FILTER_WIDE}"
    parts = [
        S.knn_cte("r_normal", 1, "l2", f),
        S.knn_cte("r_force", 1, "l2", f),
        S.ivf_search_cte("r_pre", 1, N_PROBES, f),
        S.knn_cte("r_post0", 1, "l2"),
        f"r_post AS (SELECT r.* FROM r_post0 r JOIN v c ON c.id = r.id WHERE {f})",
    ]
    unions = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, q.id AS qid, {elig} AS el, r.id AS top_id FROM v q LEFT JOIN r_{m} r ON r.qid = q.id"
        for m in ("normal", "pre", "post", "force")
    )
    return (
        f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, " + ", ".join(parts) + f", u AS ({unions}) "
        "SELECT mode, count(*) AS total, count(*) FILTER (WHERE el) AS eligible, "
        "count(*) FILTER (WHERE el AND top_id = qid) AS correct, "
        "round(CASE WHEN count(*) FILTER (WHERE el) > 0 THEN CAST(count(*) FILTER (WHERE el AND top_id = qid) AS DOUBLE) "
        "/ count(*) FILTER (WHERE el) ELSE 0.0 END, 6) AS recall FROM u GROUP BY mode"
    )


@register("recall_by_mode", _by_mode_sql())
def _recall_by_mode(spark, sf):
    """Normal / pre (IVF) / post / force with the same queries and filter."""
    v = vectors(spark, sf)
    qs = queries_from(v)
    cond = flt.where(i32v_lt=FILTER_WIDE)
    index = label_index(v)
    results = {
        "normal": knn_mod.search(v, qs, 1, "l2", where=cond, mode="normal"),
        "pre": knn_mod.search(v, qs, 1, "l2", where=cond, mode="pre", index=index),
        "post": knn_mod.search(v, qs, 1, "l2", where=cond, mode="post"),
        "force": knn_mod.search(v, qs, 1, "l2", where=cond, mode="force", index=index),
    }
    out = recall.recall_by_mode(results, v.withColumnRenamed("id", "qid"), cond)
    return _round_recall(out).select("mode", "total", "eligible", "correct", "recall")


# -- I1-I3: IVF -----------------------------------------------------------------


@register(
    "ivf_lists_rule",
    "SELECT n, CAST(greatest(CASE WHEN n < 1000000 THEN floor(n / 1000) ELSE floor(sqrt(n)) END, 10) AS INTEGER) AS lists "
    "FROM (SELECT count(*) AS n FROM embeddings)",
)
def _lists_rule(spark, sf):
    n = vectors(spark, sf).count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(ivf.lists_rule(n)).cast("int").alias("lists"))


@register("ivf_centroids", f"WITH {S.V}, {S.label_centroids_cte()} SELECT list_id, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos, "
          "CAST(unnest(centroid) AS DOUBLE) AS x FROM cen")
def _ivf_centroids(spark, sf):
    v = vectors(spark, sf)
    return ivf.centroids_from_labels(v).select("list_id", F.posexplode("centroid").alias("pos", "x")).select(
        "list_id", "pos", F.col("x").cast("double").alias("x")
    )


@register("ivf_assign", f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()} SELECT id, list_id FROM asg")
def _ivf_assign(spark, sf):
    v = vectors(spark, sf)
    return label_index(v).lists.select("id", "list_id")


@register("ivf_search", f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.ivf_search_cte('r', K, N_PROBES)} "
          f"{S.ranked_select('r')}")
def _ivf_search(spark, sf):
    v = vectors(spark, sf)
    return _ranked(label_index(v).search(queries_from(v), K))


@register(
    "ivf_search_pre",
    f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.ivf_search_cte('r', K, N_PROBES, f'c.i32v < {FILTER_WIDE}')} "
    f"{S.ranked_select('r')}",
)
def _ivf_search_pre(spark, sf):
    """K4 through the index: filter the probed lists' rows, then rank."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="pre",
                                  index=label_index(v)))


# -- S6-S8: generation ------------------------------------------------------------

from quiver.operators import dml  # noqa: E402
from quiver.sources import generate as gen  # noqa: E402

DIM = 64
SEED = gen.DEFAULT_SEED


def _summary(df: DataFrame) -> DataFrame:
    """Row summary compared by the oracle: metadata plus the rounded vector sum."""
    vsum = F.aggregate("embed", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return df.select("id", "i32v", "f32v", "strv", F.round(vsum, 6).alias("vsum"))


def _summary_sql(rel: str) -> str:
    return f"SELECT id, i32v, f32v, strv, round(list_sum(CAST(embed AS DOUBLE[])), 6) AS vsum FROM ({rel})"


def _u_sql(seed: int) -> str:
    return gen.generate_sql_u(str(seed), "id", "0")


def _sample_sql(rel: str, n: int, seed: int) -> str:
    return f"SELECT id FROM ({rel}) ORDER BY {_u_sql(seed)}, id LIMIT {n}"


_V_COLS = "SELECT id, embed, i32v, f32v, strv FROM v"


@register("gen_md5", f"WITH {S.V} " + _summary_sql(gen.rows_sql("SELECT id FROM v", DIM, SEED)))
def _gen_md5(spark, sf):
    """S7 (md5 family): a synthetic row for every id of the table."""
    v = vectors(spark, sf)
    return _summary(gen.rows_for_ids(v.select("id"), DIM, SEED, "md5"))


@register("gen_fast", f"WITH {S.V}, {gen.rows_sql_fast('SELECT id FROM v', DIM, SEED)} "
          + _summary_sql("SELECT * FROM gen_rows"))
def _gen_fast(spark, sf):
    """S7 (xxhash64 family, JVM-side): a synthetic row for every id of the table."""
    v = vectors(spark, sf)
    return _summary(gen.rows_for_ids(v.select("id"), DIM, SEED, "fast"))


@register("gen_metadata", f"WITH {S.V}, m AS ({gen.rows_sql('SELECT id FROM v', 1, SEED)}) "
          "SELECT v.id, m.i32v, m.f32v, m.strv, round(list_sum(CAST(v.embed AS DOUBLE[])), 6) AS vsum "
          "FROM v JOIN m ON m.id = v.id")
def _gen_metadata(spark, sf):
    """Stored vectors get id = start_id + position and synthetic metadata."""
    e = vectors(spark, sf).select(F.col("id").alias("pos"), "embed")
    return _summary(gen.metadata_for(e, SEED, 0, "md5"))


# -- T3-T10: DML -------------------------------------------------------------------

_N_INS, _N_UPD, _N_DEL = 100, 80, 50


@register("sample_ids", f"WITH {S.V} " + _sample_sql("SELECT id FROM v", 50, SEED))
def _sample_ids(spark, sf):
    """Exactly n ids in hash order (sort + limit: the sample size is the feature)."""
    return dml.sample_ids(vectors(spark, sf), 50, SEED, "md5")


@register("sample_ids_ranged", f"WITH {S.V} " + _sample_sql("SELECT id FROM v", 300, SEED))
def _sample_ids_ranged(spark, sf):
    """T7, large-n path: range partitioning by hash key, boundary partition ranked."""
    return dml.sample_ids(vectors(spark, sf), 300, SEED, "md5", take_ordered_max=0)


@register("max_id", "SELECT coalesce(max(vec_id), 0) AS max_id FROM embeddings")
def _max_id(spark, sf):
    return dml.max_id(vectors(spark, sf))


def _ins_sql(base: str, n: int, seed: int) -> str:
    ids = f"SELECT (SELECT coalesce(max(id), 0) FROM ({base})) + 1 + range AS id FROM range({n})"
    return f"SELECT id, embed, i32v, f32v, strv FROM ({base}) UNION ALL {gen.rows_sql(ids, DIM, seed)}"


def _upd_sql(base: str, n: int, pick_seed: int, gen_seed: int) -> str:
    ids = _sample_sql(base, n, pick_seed)
    return (
        f"SELECT b.id, coalesce(u.embed, b.embed) AS embed, coalesce(u.i32v, b.i32v) AS i32v, b.f32v, b.strv "
        f"FROM ({base}) b LEFT JOIN ({gen.rows_sql(ids, DIM, gen_seed)}) u ON u.id = b.id"
    )


def _del_sql(base: str, n: int, seed: int) -> str:
    return f"SELECT * FROM ({base}) WHERE id NOT IN ({_sample_sql(base, n, seed)})"


@register("insert_rows", f"WITH {S.V} " + _summary_sql(_ins_sql(_V_COLS, _N_INS, SEED)))
def _insert_rows(spark, sf):
    """T5 + T6: n generated rows appended at max_id + 1; the whole table is returned."""
    return _summary(dml.insert(vectors(spark, sf), _N_INS, DIM, SEED, "md5"))


@register("update_rows", f"WITH {S.V} " + _summary_sql(_upd_sql(_V_COLS, _N_UPD, SEED + 1, SEED + 2)))
def _update_rows(spark, sf):
    v = vectors(spark, sf)
    ids = dml.sample_ids(v, _N_UPD, SEED + 1, "md5")
    return _summary(dml.update(v, ids, DIM, SEED + 2, "md5", n_hint=_N_UPD))


@register("delete_rows", f"WITH {S.V} " + _summary_sql(_del_sql(_V_COLS, _N_DEL, SEED + 3)))
def _delete_rows(spark, sf):
    v = vectors(spark, sf)
    return _summary(dml.delete(v, dml.sample_ids(v, _N_DEL, SEED + 3, "md5")))


def _mix_sql() -> str:
    ni, nu, nd = dml.mix_counts(100, (1, 8, 1))
    t1 = _ins_sql(_V_COLS, ni, SEED)
    t2 = _upd_sql("SELECT * FROM t1", nu, SEED + 1, SEED + 2)
    t3 = _del_sql("SELECT * FROM t2", nd, SEED + 3)
    return f"WITH {S.V}, t1 AS ({t1}), t2 AS ({t2}), t3 AS ({t3}) " + _summary_sql("SELECT * FROM t3")


@register("mix_batch", _mix_sql())
def _mix_batch(spark, sf):
    """One batch of 100 operations, ratios 1:8:1 (insert, update, delete in that order)."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    return _summary(dml.mix(v, 100, (1, 8, 1), 100, DIM, SEED, "md5"))


def _mix_many_sql(batches: int, size: int) -> str:
    ni, nu, nd = dml.mix_counts(size, (1, 8, 1))
    ctes, cur = [], _V_COLS
    for b in range(batches):
        s = SEED + 1000 * b
        first = f"(SELECT coalesce(max(id), 0) FROM ({_V_COLS})) + 1 + {b * ni}"
        rows = gen.rows_sql(f"SELECT {first} + range AS id FROM range({ni})", DIM, s)
        ctes += [f"i{b} AS (SELECT id, embed, i32v, f32v, strv FROM ({cur}) UNION ALL {rows})",
                 f"u{b} AS ({_upd_sql(f'SELECT * FROM i{b}', nu, s + 1, s + 2)})",
                 f"d{b} AS ({_del_sql(f'SELECT * FROM u{b}', nd, s + 3)})"]
        cur = f"SELECT * FROM d{b}"
    return f"WITH {S.V}, " + ", ".join(ctes) + " " + _summary_sql(cur)


@register("mix_many_batches", _mix_many_sql(3, 60))
def _mix_many(spark, sf):
    """T10 over three batches: ids go on from the last inserted one, the overlay is merged once."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    return _summary(dml.mix(v, 180, (1, 8, 1), 60, DIM, SEED, "md5"))


_NEAR = 400


@register("knn_l2_near_duplicates", (
    "WITH b AS (SELECT vec_id, embedding FROM embeddings), "
    f"c AS (SELECT vec_id AS id, CAST([CASE WHEN j <= 4 THEN (vec_id * 31 + j * 17) % {_NEAR} ELSE 4096 * 1024 + j END FOR j IN range(1, len(embedding) + 1)] AS DOUBLE[]) AS x FROM b) "
    "SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT q.id AS qid, c.id AS id, list_distance(q.x, c.x) AS d, "
    "row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, c.x), c.id) AS rk FROM c q CROSS JOIN c) "
    f"WHERE rk <= {K}"))
def _knn_near(spark, sf):
    """K2 on vectors that are close to each other and far from the origin: the product form cancels, the answer must not."""
    v = vectors(spark, sf)
    near = lambda x, j: F.when(j < 4, (F.col("id") * 31 + (j + 1) * 17) % _NEAR).otherwise(4096 * 1024 + j + 1).cast("float")
    near_v = v.select("id", F.transform("embed", near).alias("embed"))
    return _ranked(knn_mod.knn(near_v, queries_from(near_v), K, "l2"))


@register("distance_columns", f"WITH {S.V}, q AS (SELECT embed FROM v WHERE id = (SELECT min(id) FROM v)) SELECT v.id, " + ", ".join(
    f"round({S.dist(m, 'v.embed', 'q.embed')}, 6) AS {m}" for m in ("l2sq", "cosine", "ip")) + " FROM v, q")
def _distance_columns(spark, sf):
    """V2-V4 as Columns: every stored vector against one literal vector."""
    v = vectors(spark, sf)
    first = v.orderBy("id").select("embed").first()["embed"]
    lit = F.array(*[F.lit(float(x)) for x in first]).cast("array<float>")
    return v.select("id", *[F.round(vf.distance(m, "embed", lit), 6).alias(m) for m in ("l2sq", "cosine", "ip")])


_IVF_FILTERED = f"c.i32v < {FILTER_WIDE}"


@register("ivf_search_post", (
    f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.ivf_search_cte('r0', 2 * K, N_PROBES)}, "
    f"kept AS (SELECT r0.qid, r0.id, r0.d FROM r0 JOIN v c ON c.id = r0.id WHERE {_IVF_FILTERED}), "
    "r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM kept) "
    f"{S.ranked_select('r')} WHERE rk <= {K}"))
def _ivf_search_post(spark, sf):
    """I3 under mode ``post``: twice K nearest of the probed lists, then the filter."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="post", oversample=2,
                                  index=label_index(v)))


@register("ivf_trained_all_lists", ORACLE["knn_l2"])
def _ivf_trained(spark, sf):
    """I2 with k-means lists: probing all of them is exact search."""
    v = vectors(spark, sf)
    index = ivf.build_ivf(v, lists=12, train_percent=50, n_probes=12)
    return _ranked(index.search(queries_from(v), K))


_N_ROWS_SQL = "(SELECT count(*) FROM embeddings)"


@register("gen_partitioned", _summary_sql(gen.rows_sql(f"SELECT 1000 + range AS id FROM range({_N_ROWS_SQL})", DIM, SEED)))
def _gen_partitioned(spark, sf):
    """As many rows as the table has, over contiguous id ranges per partition."""
    n = vectors(spark, sf).count()
    return _summary(gen.generate(spark, n, DIM, SEED, 1000, 5, "md5"))


@register("table_lifecycle", f"WITH {S.V} " + _summary_sql(
    f"{_V_COLS} UNION ALL " + gen.rows_sql("SELECT id + (SELECT max(id) FROM v) + 1 AS id FROM v", DIM, SEED)))
def _table_lifecycle(spark, sf):
    """Create a table, load the stored and then generated rows, write a version, drop the first table, read back."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    base = scratch_dir(spark, "table")
    empty = dml.create_table(spark, f"{base}/empty", DIM)
    shift = int(dml.max_id(v).first()["max_id"]) + 1
    made = gen.rows_for_ids(v.select((F.col("id") + shift).alias("id")), DIM, SEED, "md5")
    path = dml.write_version(dml.bulk_load(dml.bulk_load(empty, v), made), base, 1)
    dml.drop_table(spark, f"{base}/empty")
    return _summary(spark.read.parquet(path))


@register("ivf_recreate_chunks", ORACLE["ivf_search"])
def _ivf_recreate(spark, sf):
    """A table added in chunks, indexed, the index dropped and built again."""
    v = vectors(spark, sf)
    table = ivf.add_chunks([v.where(F.pmod("id", F.lit(3)) == k) for k in range(3)])
    path = scratch_dir(spark, "ivf-again")
    cen = ivf.centroids_from_labels(v)
    ivf.build_ivf(table, metric="l2", centroids=cen, n_probes=1, path=path)
    again = ivf.recreate_index(table, path, metric="l2", centroids=cen, n_probes=N_PROBES)
    return _ranked(again.search(queries_from(v), K))


@register("ivf_add_chunks", ORACLE["ivf_search"])
def _ivf_add_chunks(spark, sf):
    """Two chunks before the build, one (added twice, as a retry would) into the built index."""
    v = vectors(spark, sf)
    part = lambda r: v.where(F.pmod("id", F.lit(3)) == r)
    chunked = chunks.ChunkedIvf(spark, scratch_dir(spark, "ivf-chunks"), "l2")
    chunked.add("a", part(0))
    chunked.add("b", part(1))
    chunked.build(n_probes=N_PROBES, centroids=ivf.centroids_from_labels(v))
    chunked.add("c", part(2))
    chunked.add("c", part(2))
    return _ranked(chunked.index().search(queries_from(v), K))


@register("append_rows", f"WITH {S.V} " + _summary_sql(
    f"{_V_COLS} UNION ALL SELECT id + 1000000 AS id, embed, i32v, f32v, strv FROM v"))
def _append_rows(spark, sf):
    """The same vectors with id + 1000000 appended (key uniqueness checked)."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    extra = v.withColumn("id", F.col("id") + 1_000_000)
    return _summary(dml.bulk_load(v, extra))


# -- M1-M4: metrics over the run log (events as a run log) ---------------------------

from quiver.operators import report  # noqa: E402
from quiver.schema import read_table  # noqa: E402

_LOG_SQL = (
    "log AS (SELECT user_id AS run_id, event_type AS test_name, event_id AS qid, ts AS started_at, "
    "CAST(value AS DOUBLE) AS seconds, CAST(1 AS BIGINT) AS rows FROM events)"
)
_M1_SQL = (
    "SELECT test_name, count(*) AS queries, "
    "CASE WHEN wall_s > 0 THEN round(count(*) / wall_s, 6) ELSE 0.0 END AS qps, "
    "round(sum(seconds) / count(*) * 1000.0, 6) AS avg_latency_ms, round(wall_s, 6) AS wall_s FROM ("
    "SELECT *, (max(epoch_us(started_at) + seconds * 1e6) OVER (PARTITION BY test_name) - "
    "min(epoch_us(started_at)) OVER (PARTITION BY test_name)) / 1e6 AS wall_s FROM log) GROUP BY test_name, wall_s"
)
_M2_SQL = (
    "SELECT test_name, CAST(sum(rows) AS BIGINT) AS rows, round(sum(seconds), 6) AS time_s, "
    "round(CASE WHEN sum(seconds) > 0 THEN sum(rows) / sum(seconds) ELSE 0.0 END, 6) AS rows_per_sec FROM log GROUP BY test_name"
)


def _log(spark, sf):
    return report.run_log_from_events(read_table(spark, sf, "events"))


def _round_all(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("log_throughput", f"WITH {_LOG_SQL} {_M1_SQL}")
def _log_throughput(spark, sf):
    """M1: qps over the wall span and mean latency per test."""
    return _round_all(report.throughput(_log(spark, sf)), ["qps", "avg_latency_ms", "wall_s"])


@register("log_rows_per_s", f"WITH {_LOG_SQL} {_M2_SQL}")
def _log_rows(spark, sf):
    """M2: rows per second per test."""
    return _round_all(report.rows_per_second(_log(spark, sf)), ["time_s", "rows_per_sec"])


@register(
    "log_cold_start",
    f"WITH {_LOG_SQL} SELECT run_id, count(*) AS n, round(arg_min(seconds, started_at), 6) AS cold_s, "
    "round(CASE WHEN count(*) > 1 THEN (sum(seconds) - arg_min(seconds, started_at)) / (count(*) - 1) END, 6) AS warm_avg_s "
    "FROM log GROUP BY run_id",
)
def _log_cold(spark, sf):
    """M3: first query of each run apart from the rest."""
    return _round_all(report.cold_start(_log(spark, sf)), ["cold_s", "warm_avg_s"])


@register("stats_union", f"WITH {_LOG_SQL}, m1 AS ({_M1_SQL}), m2 AS ({_M2_SQL}) "
          "SELECT avg_latency_ms, qps, queries, rows, rows_per_sec, test_name, time_s, wall_s "
          "FROM (SELECT * FROM m1 UNION ALL BY NAME SELECT * FROM m2)")
def _stats_union(spark, sf):
    """M4: ragged stats tables merged by name, columns sorted."""
    log = _log(spark, sf)
    m1 = _round_all(report.throughput(log), ["qps", "avg_latency_ms", "wall_s"])
    m2 = _round_all(report.rows_per_second(log), ["time_s", "rows_per_sec"])
    return report.merge_stats([m1, m2])


# -- V8: scalar quantization -------------------------------------------------------------

from quiver.operators import pq  # noqa: E402


def _quant_sql(qtype: str) -> str:
    cmin, cmax = (-128, 127) if qtype == "int8" else (0, 255)
    t = "TINYINT" if qtype == "int8" else "SMALLINT"
    return (
        f"WITH {S.V}, b AS (SELECT min(CAST(x AS DOUBLE)) AS lo, max(CAST(x AS DOUBLE)) AS hi FROM (SELECT unnest(embed) AS x FROM v)), "
        f"e AS (SELECT id, unnest(range(len(embed))) AS pos, CAST(unnest(embed) AS DOUBLE) AS x FROM v) "
        f"SELECT id, CAST(pos AS INTEGER) AS pos, CAST(CAST(least(greatest(round((x - lo) * ({cmax - cmin} / (hi - lo)) + {cmin}), {cmin}), {cmax}) AS {t}) AS INTEGER) AS code "
        "FROM e, b"
    )


for _qt in ("int8", "uint8"):

    def _q(spark, sf, _qt=_qt):
        v = vectors(spark, sf).select("id", "embed")
        return pq.quantize_table(v, _qt).select("id", F.posexplode("embed").alias("pos", "code")).select(
            "id", "pos", F.col("code").cast("int").alias("code"))

    register(f"quant_{_qt}", _quant_sql(_qt))(_q)


# -- I4-I5: product quantization (label-mean codebook, m = 8, no coarse step) ------------

PQ_M = 8


def _pq_index(v: DataFrame) -> pq.IvfPqIndex:
    cb = pq.codebook_from_labels(v, PQ_M, DIM)
    return pq.build_ivfpq(v, PQ_M, DIM, lists=1, codebook=cb, n_probes=1)


_DS = DIM // PQ_M
_PQ_SQL = (
    "cb AS (SELECT sub, code, list(CAST(x AS FLOAT) ORDER BY j) AS centroid FROM ("
    "SELECT sub, code, j, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM ("
    f"SELECT label AS code, CAST(pos // {_DS} AS INTEGER) AS sub, pos % {_DS} AS j, x FROM ("
    "SELECT label, unnest(range(len(embed))) AS pos, unnest(embed) AS x FROM v)) GROUP BY sub, code, j) GROUP BY sub, code), "
    "enc AS (SELECT id, sub, code FROM (SELECT v.id, cb.sub, cb.code, row_number() OVER (PARTITION BY v.id, cb.sub ORDER BY "
    f"list_distance(CAST(list_slice(v.embed, cb.sub * {_DS} + 1, cb.sub * {_DS} + {_DS}) AS DOUBLE[]), CAST(cb.centroid AS DOUBLE[])), cb.code) AS rn "
    "FROM v CROSS JOIN cb) WHERE rn = 1)"
)


@register("pq_encode", f"WITH {S.V}, {_PQ_SQL} SELECT id, sub, code FROM enc")
def _pq_encode(spark, sf):
    v = vectors(spark, sf)
    return _pq_index(v).codes.select("id", F.posexplode("codes").alias("sub", "code")).select(
        "id", "sub", F.col("code").cast("int").alias("code"))


@register(
    "pq_search",
    f"WITH {S.V}, {_PQ_SQL}, adc AS (SELECT q.id AS qid, e.id AS id, sum(power(list_distance("
    f"CAST(list_slice(q.embed, e.sub * {_DS} + 1, e.sub * {_DS} + {_DS}) AS DOUBLE[]), CAST(cb.centroid AS DOUBLE[])), 2)) AS d2 "
    "FROM v q CROSS JOIN enc e JOIN cb ON cb.sub = e.sub AND cb.code = e.code GROUP BY q.id, e.id), "
    "r AS (SELECT qid, id, sqrt(d2) AS d, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS rk FROM adc) "
    f"{S.ranked_select('r')} WHERE rk <= {K}",
)
def _pq_search(spark, sf):
    """Table-lookup distances over PQ codes, top-k per query."""
    v = vectors(spark, sf)
    return _ranked(_pq_index(v).search(queries_from(v), K))


# -- I6-I8: kNN graph -------------------------------------------------------------------

from quiver.operators import graph  # noqa: E402

IGD, GD = 16, 8


def _graph_sql(base: str = S.V) -> str:
    h = GD // 2
    return (
        f"WITH {base}, {S.knn_cte('r0', IGD + 1, 'l2')}, "
        "e0 AS (SELECT qid AS src, id AS dst, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM r0 WHERE id <> qid), "
        f"e AS (SELECT * FROM e0 WHERE rank <= {IGD}), "
        "tri AS (SELECT a.src AS s, b.dst AS t, count(*) AS nd FROM e a JOIN e b ON b.src = a.dst "
        "JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst AND greatest(a.rank, b.rank) < c.rank GROUP BY a.src, b.dst), "
        "sc AS (SELECT e.src, e.dst, e.rank, coalesce(tri.nd, 0) AS detours FROM e LEFT JOIN tri ON tri.s = e.src AND tri.t = e.dst), "
        "fwd AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY detours, rank) AS pos FROM sc), "
        f"kept AS (SELECT * FROM fwd WHERE pos <= {h}), "
        "rev AS (SELECT src, dst, k1, k2 FROM (SELECT dst AS src, src AS dst, rank AS k1, src AS k2, "
        f"row_number() OVER (PARTITION BY dst ORDER BY rank, src) AS rn FROM kept) WHERE rn <= {GD}), "
        "cands AS (SELECT src, dst, 0 AS prio, detours AS k1, rank AS k2 FROM kept UNION ALL "
        f"SELECT src, dst, 1 AS prio, k1, k2 FROM rev UNION ALL SELECT src, dst, 2 AS prio, detours AS k1, rank AS k2 FROM fwd WHERE pos > {h}), "
        "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY prio, k1, k2) AS u FROM cands "
        "WHERE src <> dst) WHERE u = 1), "
        "fin AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY prio, k1, k2) AS rank FROM uniq) "
        f"SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM fin WHERE rank <= {GD}"
    )


@register("graph_build_exact", _graph_sql())
def _graph_build(spark, sf):
    """Exact 16-NN graph pruned to degree 8 by detour counts, plus reverse edges."""
    v = vectors(spark, sf)
    return graph.build_graph(v, GD, IGD, "l2").edges.select("src", "dst", F.col("rank").cast("int").alias("rank"))


@register("graph_detours", f"WITH {S.V}, {S.knn_cte('r0', IGD + 1, 'l2')}, "
          "e0 AS (SELECT qid AS src, id AS dst, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM r0 WHERE id <> qid), "
          f"e AS (SELECT * FROM e0 WHERE rank <= {IGD}), "
          "tri AS (SELECT a.src AS s, b.dst AS t, count(*) AS nd FROM e a JOIN e b ON b.src = a.dst "
          "JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst AND greatest(a.rank, b.rank) < c.rank GROUP BY a.src, b.dst) "
          "SELECT e.src, e.dst, CAST(e.rank AS INTEGER) AS rank, CAST(coalesce(tri.nd, 0) AS BIGINT) AS detours "
          "FROM e LEFT JOIN tri ON tri.s = e.src AND tri.t = e.dst")
def _graph_detours(spark, sf):
    """I6 step 2: detour count of every edge of the exact 16-NN graph (array kernel)."""
    v = vectors(spark, sf)
    return graph.detours_arrays(graph.knn_edges(v, IGD, "l2")).select("src", "dst", F.col("rank").cast("int").alias("rank"),
                                                                        "detours")


G_ITOPK, G_WIDTH, G_SEEDS, G_STEPS, G_SEED = 32, 4, 9, 8, 42


def _graph_search_sql(where: str | None = None, tail: str | None = None, base: str = S.V, queries: str = "v") -> str:
    """Beam search as a recursive CTE over step-indexed beam states (one iteration = one step).

    ``where``: the beam also keeps the K nearest rows that fit it, and only those are returned. ``base``
    defines the table ``v`` that is indexed, ``queries`` names the one that is searched for.
    """
    extra = f"OR (rn2 <= {K} AND id IN (SELECT id FROM v WHERE {where}))" if where else ""
    own = f", row_number() OVER (PARTITION BY qid, id IN (SELECT id FROM v WHERE {where}) ORDER BY d, id) AS rn2" if where else ""
    only = f"AND id IN (SELECT id FROM v WHERE {where})" if where else ""
    head = _graph_sql(base).rsplit(" SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM fin WHERE rank <= ", 1)[0]
    u = gen.generate_sql_u(str(G_SEED), "id", "0")
    d = S.dist("l2", "q.embed", "c.embed")
    return (
        head.replace("WITH ", "WITH RECURSIVE ", 1)
        + f", g AS (SELECT src, dst FROM fin WHERE rank <= {GD}), "
        f"seeds AS (SELECT id FROM v ORDER BY {u}, id LIMIT {G_SEEDS}), "
        f"b0 AS (SELECT q.id AS qid, c.id AS id, {d} AS d FROM {queries} q CROSS JOIN seeds s JOIN v c ON c.id = s.id), "
        "beam(step, qid, id, d, visited) AS ("
        f"SELECT 0, qid, id, d, false FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn{own} FROM b0) "
        f"WHERE rn <= {G_ITOPK} {extra} UNION ALL SELECT step + 1, qid, id, d, visited FROM ("
        f"WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY visited, d, id) AS o FROM beam "
        f"WHERE step < {G_STEPS}), "
        f"marked AS (SELECT step, qid, id, d, (visited OR (NOT visited AND o <= {G_WIDTH})) AS visited, "
        f"(NOT visited AND o <= {G_WIDTH}) AS opened FROM ranked), "
        "nb AS (SELECT DISTINCT m.step, m.qid, g.dst AS id FROM marked m JOIN g ON g.src = m.id WHERE m.opened), "
        "nw AS (SELECT nb.* FROM nb ANTI JOIN marked m ON m.qid = nb.qid AND m.id = nb.id), "
        f"sc AS (SELECT nw.step, nw.qid, nw.id, {d} AS d, false AS visited FROM nw JOIN {queries} q ON q.id = nw.qid "
        "JOIN v c ON c.id = nw.id), "
        "un AS (SELECT step, qid, id, d, visited FROM marked UNION ALL SELECT step, qid, id, d, visited FROM sc) "
        f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn{own} FROM un) WHERE rn <= {G_ITOPK} {extra}) "
        + (tail or "SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT qid, id, d, "
           f"row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM beam WHERE step = {G_STEPS} {only}) WHERE rk <= {K}")
    )


def _graph_index(v: DataFrame) -> graph.GraphIndex:
    return graph.build_graph(v, GD, IGD, "l2", itopk=G_ITOPK, search_width=G_WIDTH, n_seeds=G_SEEDS, max_iter=G_STEPS,
                             seed=G_SEED, seed_family="md5")


@register("graph_search", _graph_search_sql())
def _graph_search(spark, sf):
    """Beam search over the pruned graph for every stored vector (md5-drawn start nodes)."""
    v = vectors(spark, sf)
    return _ranked(_graph_index(v).search(queries_from(v), K))


@register("graph_search_pre", _graph_search_sql(f"i32v < {FILTER_WIDE}"))
def _graph_search_pre(spark, sf):
    """I7 under mode ``pre``: the walk passes ineligible nodes, only eligible ones are returned."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="pre", index=_graph_index(v)))


@register("graph_search_post", _graph_search_sql(tail=(
    "SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk "
    f"FROM (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r0 FROM beam WHERE step = {G_STEPS}) "
    f"WHERE r0 <= {2 * K} AND id IN (SELECT id FROM v WHERE i32v < {FILTER_WIDE})) WHERE rk <= {K}")))
def _graph_search_post(spark, sf):
    """I7 under mode ``post``: twice K nearest of the walk, then the filter."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="post", oversample=2,
                                  index=_graph_index(v)))


@register("hnsw_search_pre", _graph_search_sql(f"i32v < {FILTER_NARROW}"))
def _hnsw_search_pre(spark, sf):
    """I8 under mode ``pre`` with a narrow filter: hnsw's m, ef_construction and ef_search mapped to the graph's degrees and beam."""
    v = vectors(spark, sf)
    p = graph.hnsw_params(GD, IGD, G_ITOPK)
    index = graph.build_graph(v, p["graph_degree"], p["intermediate_graph_degree"], "l2", itopk=p["itopk"], search_width=G_WIDTH,
                              n_seeds=G_SEEDS, max_iter=G_STEPS, seed=G_SEED, seed_family="md5")
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_NARROW), mode="pre", index=index))


def _trained_pq(v: DataFrame, rerank: int) -> pq.IvfPqIndex:
    return pq.build_ivfpq(v, 8, DIM, lists=6, bits=8, train_percent=60, n_probes=6, rerank=rerank, keep_vectors=True)


@register("pq_trained_rerank_all", ORACLE["knn_l2"])
def _pq_trained(spark, sf):
    """I4/I5 with trained lists and 8-bit residual codes: probing all lists and re-ranking all candidates is exact search."""
    v = vectors(spark, sf)
    return _ranked(_trained_pq(v, v.count() // K + 1).search(queries_from(v), K))


@register("pq_search_pre", ORACLE["knn_normal_filtered"])
def _pq_search_pre(spark, sf):
    """I5 under mode ``pre``, all lists probed and all candidates re-ranked: exact filtered search."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="pre",
                                  index=_trained_pq(v, v.count() // K + 1)))


@register("pq_search_post", ORACLE["knn_post"])
def _pq_search_post(spark, sf):
    """I5 under mode ``post``, likewise."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="post", oversample=2,
                                  index=_trained_pq(v, v.count() // K + 1)))


# -- S9, I14: streaming (file stream of the table, several files, one per trigger) -----------

from quiver.session import scratch_dir  # noqa: E402
from quiver.streaming import maintain  # noqa: E402


def _table_stream(spark, sf, files: int = 4) -> DataFrame:
    """Stream fixture: the vector table written as several Parquet files, read one file per trigger."""
    v = vectors(spark, sf)
    src = scratch_dir(spark, "stream-src")
    v.repartitionByRange(files, "id").write.parquet(src)
    return spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(src)


@register("stream_ivf", f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()} SELECT id, list_id FROM asg")
def _stream_ivf(spark, sf):
    """Rows arrive on a stream and are appended to the lists of an existing index (= batch assignment)."""
    v = vectors(spark, sf)
    index = label_index(v)
    out, ck = scratch_dir(spark, "stream-lists"), scratch_dir(spark, "stream-ck")
    q = maintain.maintain_ivf(_table_stream(spark, sf), index, out, ck)
    q.awaitTermination()
    return maintain.read_stream_lists(spark, out).select("id", "list_id")


@register("stream_gen", f"WITH {S.V} " + _summary_sql(gen.rows_sql("SELECT id FROM v", DIM, SEED)))
def _stream_gen(spark, sf):
    """The generator applied to a stream of the table's ids, written per micro-batch."""
    ids = _table_stream(spark, sf).select("id")
    out, ck = scratch_dir(spark, "stream-gen"), scratch_dir(spark, "stream-gen-ck")
    q = maintain.write_batches(maintain.generate_for_stream(ids, DIM, SEED, "md5"), out, ck)
    q.awaitTermination()
    return _summary(spark.read.parquet(out))


# -- S1-S2, W1-W3: CSV round trip; S4-S5: binary round trip ----------------------------------

from quiver.sources import text as csv_io  # noqa: E402


@register("csv_io", f"WITH {S.V} SELECT {_META}, round(list_sum(CAST(embed AS DOUBLE[])), 6) AS vsum FROM v")
def _csv_io(spark, sf):
    """W1-W3 then S1-S2: chunked gzip CSV written and read back by prefix."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    out = scratch_dir(spark, "csv")
    csv_io.write_csv(v, out, chunks=3, compress_level=1)
    back = csv_io.read_csv(spark, prefix=f"{out}/part-")
    return _summary(back)


from quiver.sources import binary as vecbin  # noqa: E402

for _suffix in (".fbin", ".fvecs"):

    def _q(spark, sf, _suffix=_suffix):
        """S4/S5 (+S6): table vectors written as binary part files, read back as a vector table."""
        v = vectors(spark, sf)
        out = scratch_dir(spark, "vecbin")
        vecbin.write_vectors(v, out, _suffix, parts=3)
        back = vecbin.read_vectors(spark, out, rows_per_partition=128)
        return back.select(F.col("pos").alias("id"), F.round(F.aggregate("embed", F.lit(0.0).cast("double"),
                                                                         lambda a, x: a + x.cast("double")), 6).alias("vsum"))

    register(f"{_suffix[1:]}_io", f"WITH {S.V} SELECT id, round(list_sum(CAST(embed AS DOUBLE[])), 6) AS vsum FROM v")(_q)


# -- I12, R8, K7, I5 re-rank ---------------------------------------------------------------


@register("ivf_save_load", ORACLE["ivf_search"])
def _ivf_save_load(spark, sf):
    """Index written to a directory, read back, then searched."""
    v = vectors(spark, sf)
    path = scratch_dir(spark, "ivf-index")
    ivf.build_ivf(v, metric="l2", centroids=ivf.centroids_from_labels(v), n_probes=N_PROBES, path=path)
    return _ranked(ivf.load_ivf(spark, path).search(queries_from(v), K))


@register("pq_save_load", ORACLE["pq_search"])
def _pq_save_load(spark, sf):
    v = vectors(spark, sf)
    path = scratch_dir(spark, "pq-index")
    pq.save_ivfpq(_pq_index(v), path)
    return _ranked(pq.load_ivfpq(spark, path).search(queries_from(v), K))


@register("recall_gt_matrix", ORACLE["recall_gt_k"])
def _recall_gt_matrix(spark, sf):
    """Ground truth as a matrix row per query (neighbors array) turned into (qid, rank, id)."""
    v = vectors(spark, sf)
    qs = queries_from(v)
    exact = knn_mod.knn(v, qs, K, "l2")
    matrix = exact.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))), lambda s: s["id"]).alias("neighbors"))
    res = label_index(v).search(qs, K)
    return _round_recall(recall.gt_recall(res, recall.gt_relation(matrix), K, qs.select("qid")), "recall_rate").select(
        "total_queries", "correct_hits", "recall_rate", "k")


@register("knn_query_prefix", f"WITH {S.V}, qp AS (SELECT * FROM v ORDER BY id LIMIT 100), "
          f"{S.knn_cte('r', K, 'l2', queries='qp')} {S.ranked_select('r')}")
def _knn_query_prefix(spark, sf):
    """K7: the first 100 queries of the query set (the prefix is the feature), whole corpus."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.knn(v, knn_mod.query_prefix(queries_from(v), 100), K, "l2"))


@register(
    "pq_search_rerank",
    f"WITH {S.V}, {_PQ_SQL}, adc AS (SELECT q.id AS qid, e.id AS id, sum(power(list_distance("
    f"CAST(list_slice(q.embed, e.sub * {_DS} + 1, e.sub * {_DS} + {_DS}) AS DOUBLE[]), CAST(cb.centroid AS DOUBLE[])), 2)) AS d2 "
    "FROM v q CROSS JOIN enc e JOIN cb ON cb.sub = e.sub AND cb.code = e.code GROUP BY q.id, e.id), "
    f"c AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS ck FROM adc) WHERE ck <= {4 * K}), "
    f"x AS (SELECT c.qid, c.id, {S.dist('l2', 'q.embed', 'r.embed')} AS d FROM c JOIN v q ON q.id = c.qid JOIN v r ON r.id = c.id), "
    "r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM x) "
    f"{S.ranked_select('r')} WHERE rk <= {K}",
)
def _pq_search_rerank(spark, sf):
    """I5 with exact re-rank of the top 4k table-lookup candidates."""
    v = vectors(spark, sf)
    cb = pq.codebook_from_labels(v, PQ_M, DIM)
    idx = pq.build_ivfpq(v, PQ_M, DIM, lists=1, codebook=cb, n_probes=1, rerank=4)
    return _ranked(idx.search(queries_from(v), K))


@register("graph_save_load", ORACLE["graph_search"])
def _graph_save_load(spark, sf):
    """I12 for the graph index: written, read back, searched (= graph_search)."""
    v = vectors(spark, sf)
    path = scratch_dir(spark, "graph-index")
    g = graph.save_graph(_graph_index(v), path)
    return _ranked(g.search(queries_from(v), K))


# -- I9 through a run configuration --------------------------------------------------------

from quiver.plans.config_index import build_from_config  # noqa: E402


@register("index_bruteforce", ORACLE["knn_l2"])
def _index_bruteforce(spark, sf):
    """The brute-force index of a config is exact search over the table."""
    v = vectors(spark, sf)
    idx = build_from_config(v, {"index": {"type": "bruteforce", "op_type": "vector_l2_ops"}, "mode": "single"})
    return _ranked(idx.search(queries_from(v), K))


# -- The reference's SQL form, through registered SQL functions ------------------------------

from quiver.functions.sql import register_sql_functions  # noqa: E402


@register("sql_knn_one", ORACLE["knn_one"])
def _sql_knn_one(spark, sf):
    """K1 as SQL text: l2_distance(embed, vec('[...]')), ordered, LIMIT k (vector text of row 7)."""
    register_sql_functions(spark)
    v = vectors(spark, sf)
    v.createOrReplaceTempView("quiver_vectors")
    text = v.where(F.col("id") == 7).select(vf.to_text("embed").alias("t")).first()["t"]
    return spark.sql(
        f"SELECT id, round(dist, 6) AS d FROM (SELECT id, l2_distance(embed, vec('{text}')) AS dist FROM quiver_vectors) "
        f"ORDER BY dist, id LIMIT {K}"
    )


@register("sql_filtered_ip",
          f"WITH {S.V}, q AS (SELECT embed FROM v WHERE id = 11) SELECT c.id, round({S.dist('ip', 'c.embed', 'q.embed')}, 6) AS d "
          f"FROM v c, q WHERE c.i32v < {FILTER_WIDE} ORDER BY {S.dist('ip', 'c.embed', 'q.embed')}, c.id LIMIT {K}")
def _sql_filtered_ip(spark, sf):
    """K3 as SQL text with a filter and the inner-product order (nearest = largest dot)."""
    register_sql_functions(spark)
    v = vectors(spark, sf)
    v.createOrReplaceTempView("quiver_vectors")
    text = v.where(F.col("id") == 11).select(vf.to_text("embed").alias("t")).first()["t"]
    return spark.sql(
        f"SELECT id, round(dist, 6) AS d FROM (SELECT id, neg_inner_product(embed, vec('{text}')) AS dist "
        f"FROM quiver_vectors WHERE i32v < {FILTER_WIDE}) ORDER BY dist, id LIMIT {K}"
    )


# -- K3, K4 through IVF and PQ: probe expansion under a selective filter -------------------

_SELECTIVE_SQL = (
    f"WITH {S.V}, {S.label_centroids_cte()}, {S.assign_cte()}, {S.ivf_search_cte('a', K, 1, f'c.i32v < {FILTER_NARROW}')}, "
    f"{S.knn_cte('x', K, 'l2', f'c.i32v < {FILTER_NARROW}')}, enough AS (SELECT qid FROM a GROUP BY qid HAVING count(*) = {K}), "
    "r AS (SELECT * FROM a WHERE qid IN (SELECT qid FROM enough) UNION ALL SELECT * FROM x WHERE qid NOT IN (SELECT qid FROM enough)) "
    + S.ranked_select("r")
)


@register("ivf_search_pre_selective", _SELECTIVE_SQL)
def _ivf_pre_selective(spark, sf):
    """One probe and a filter that few rows pass: queries left under K rows go on to the nearest of all eligible rows."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_NARROW), mode="pre",
                                  index=label_index(v, 1)))


@register("pq_search_pre_selective", _SELECTIVE_SQL)
def _pq_pre_selective(spark, sf):
    """The same through PQ codes of label lists, candidates re-ranked."""
    v = vectors(spark, sf)
    index = pq.build_ivfpq(v, PQ_M, DIM, centroids=ivf.centroids_from_labels(v), codebook=pq.codebook_from_labels(v, PQ_M, DIM),
                           n_probes=1, rerank=v.count() // K + 1)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_NARROW), mode="pre", index=index))


# -- I4, I5 under inner product and cosine -------------------------------------------------


def _pq_metric_query(metric: str):
    def q(spark, sf):
        v = vectors(spark, sf)
        index = pq.build_ivfpq(v, 8, DIM, lists=6, bits=6, metric=metric, train_percent=60, n_probes=6, rerank=v.count() // K + 1)
        return _ranked(index.search(queries_from(v), K))

    q.__doc__ = f"I4/I5 for {metric}: trained lists and residual codes, all probed and re-ranked, are exact search."
    return q


for _m in ("ip", "cosine"):
    register(f"pq_search_{_m}", ORACLE[f"knn_{_m}"])(_pq_metric_query(_m))


# -- K8 for indexes: sharded graph ---------------------------------------------------------

from quiver.operators import graph_block  # noqa: E402

SHARDS = 2


def _graph_sharded_sql(where: str | None = None) -> str:
    only = f"AND id IN (SELECT id FROM v WHERE {where})" if where else ""
    tail = f"SELECT qid, id, d FROM beam WHERE step = {G_STEPS} {only}"
    shards = []
    for s in range(SHARDS):
        base = f"vq AS ({S.VECTORS_SQL}), v AS (SELECT * FROM vq WHERE id % {SHARDS} = {s})"
        shards.append(f"SELECT * FROM ({_graph_search_sql(where, tail, base, 'vq')})")
    return ("SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk "
            f"FROM ({' UNION ALL '.join(shards)})) WHERE rk <= {K}")


def _graph_shards(v: DataFrame) -> graph_block.GraphShards:
    return graph_block.build_shards(v, GD, IGD, "l2", shards=SHARDS, shard=F.pmod("id", F.lit(SHARDS)), n_seeds=G_SEEDS, seed=G_SEED,
                                    seed_family="md5", itopk=G_ITOPK, search_width=G_WIDTH, max_iter=G_STEPS)


@register("graph_sharded", _graph_sharded_sql())
def _graph_sharded(spark, sf):
    """I6, I7 under ``sharded`` distribution: an independent graph per shard, partial top-k merged."""
    v = vectors(spark, sf)
    return _ranked(_graph_shards(v).search(queries_from(v), K))


@register("graph_sharded_pre", _graph_sharded_sql(f"i32v < {FILTER_WIDE}"))
def _graph_sharded_pre(spark, sf):
    """The same under mode ``pre``: the walks pass ineligible nodes, only eligible ones are returned."""
    v = vectors(spark, sf)
    return _ranked(knn_mod.search(v, queries_from(v), K, "l2", where=flt.where(i32v_lt=FILTER_WIDE), mode="pre", index=_graph_shards(v)))


def _ivf_sharded_sql() -> str:
    shards = []
    for s in range(SHARDS):
        shards.append(f"SELECT * FROM (WITH vq AS ({S.VECTORS_SQL}), v AS (SELECT * FROM vq WHERE id % {SHARDS} = {s}), {S.label_centroids_cte()}, {S.assign_cte()}, "
                      f"{S.ivf_search_cte('r', K, N_PROBES, queries='vq')} SELECT qid, id, d FROM r)")
    return ("SELECT qid, id, round(d, 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk "
            f"FROM ({' UNION ALL '.join(shards)})) WHERE rk <= {K}")


@register("ivf_sharded", _ivf_sharded_sql())
def _ivf_sharded(spark, sf):
    """I2, I3 under ``sharded`` distribution: lists of their own in each shard, N_PROBES probed in each, partial top-k merged."""
    v = vectors(spark, sf)
    at = F.pmod("id", F.lit(SHARDS))
    index = ivf.build_ivf(v, metric="l2", centroids=[ivf.centroids_from_labels(v.where(at == s)) for s in range(SHARDS)], n_probes=N_PROBES,
                          shards=SHARDS, shard=at)
    return _ranked(index.search(queries_from(v), K))


# -- I6 without all pairs (iterative and drawn at random: rows only; recall is tested) ------

@register("graph_descent_edges")
def _graph_descent(spark, sf):
    """NN-descent: the IGD nearest others of every vector, pruned to degree GD."""
    return graph.build_graph(vectors(spark, sf), GD, IGD, "l2", neighbours="descent").edges.select("src", "dst", F.col("rank").cast("int").alias("rank"))


# -- I14 for IVF-PQ (with compaction) and graph indexes --------------------------------------

from quiver.streaming import graph_stream  # noqa: E402


@register("stream_ivfpq", f"WITH {S.V}, {_PQ_SQL} SELECT id, sub, code FROM enc")
def _stream_ivfpq(spark, sf):
    """Rows arrive on a stream, are encoded with the frozen codebook, and the batches are compacted (= batch encoding)."""
    v = vectors(spark, sf)
    out, ck = scratch_dir(spark, "stream-codes"), scratch_dir(spark, "stream-codes-ck")
    maintain.maintain_ivfpq(_table_stream(spark, sf), _pq_index(v), out, ck).awaitTermination()
    maintain.compact_lists(spark, out)
    return maintain.read_stream_lists(spark, out).select("id", F.posexplode("codes").alias("sub", "code")).select(
        "id", "sub", F.col("code").cast("int").alias("code"))


@register("stream_graph", f"WITH {S.V} SELECT id, true AS reachable, true AS within_degree FROM v WHERE id % 5 <> 0")
def _stream_graph(spark, sf):
    """Rows arrive on a stream and are inserted into a graph, every fifth is deleted, the rest compacted: every row left finds
    itself as its own nearest, and no node has more than 2 GD edges."""
    stream = _table_stream(spark, sf)
    store = graph_stream.GraphStore.create(spark, scratch_dir(spark, "graph-store"), stream.schema, graph_degree=2 * GD, candidates=6 * GD, itopk=16 * GD, n_seeds=32, max_iter=64)
    graph_stream.maintain_graph(stream, store, scratch_dir(spark, "graph-store-ck")).awaitTermination()
    v = vectors(spark, sf)
    store.delete(v.where("id % 5 = 0").select("id"), max(store.commits()) + 1)
    store.compact()
    g = store.load()
    found = g.search(queries_from(v.where("id % 5 <> 0")), 1).where("rk = 1").select(F.col("qid").alias("id"), (F.col("id") == F.col("qid")).alias("reachable"))
    wide = g.edges.groupBy("src").agg((F.count(F.lit(1)) <= 2 * GD).alias("within_degree"))
    return g.attributes.select("id").join(found, "id", "left").join(wide.withColumnRenamed("src", "id"), "id", "left").select("id", "reachable", "within_degree")


# -- S3: query files in the order given ----------------------------------------------------

@register("query_set_files", f"WITH {S.V}, f AS (SELECT *, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ordinal FROM v) "
          f"SELECT ordinal, {_META} FROM f WHERE id >= 20 ORDER BY ordinal, id LIMIT 400")
def _query_set_files(spark, sf):
    """Two query files given as z, a: the rows of z come first, each file in its row order, 400 in all (the limit is the feature)."""
    v = vectors(spark, sf).select("id", "embed", "i32v", "f32v", "strv")
    base = scratch_dir(spark, "query-files")
    for name, third in (("a", F.col("id") % 3 == 0), ("z", F.col("id") % 3 != 0)):
        csv_io.write_csv(v.where(third), f"{base}/{name}", chunks=1)
    files = [f for name in ("z", "a") for f in csv_io.expand_paths(spark, prefix=f"{base}/{name}/part-")]
    return csv_io.query_files(spark, files, start_id=20, n=400).select("ordinal", "id", "i32v", "f32v", "strv")


# -- V8: stored codes ---------------------------------------------------------------------

from quiver.operators import codes  # noqa: E402


def _codes_query(qtype: str):
    def q(spark, sf):
        v = vectors(spark, sf)
        return _ranked(codes.build_coded(v, qtype).search(queries_from(v), K))

    q.__doc__ = f"Vectors stored as {qtype} codes, scanned with an error bound, what lies inside it re-ranked: exact search."
    return q


for _qt in ("fp16", "int8"):
    register(f"knn_codes_{_qt}", ORACLE["knn_l2"])(_codes_query(_qt))
