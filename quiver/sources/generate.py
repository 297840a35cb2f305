"""Synthetic vector tables, generated on the executors.

Every value is a counter-based hash of (seed of the column, id, element), so
the output does not depend on the partition count or on which task computes a
row, and replays after a lost executor give the same rows.

Per-column seeds: vector ``seed``, i32v ``seed+1``, f32v ``seed+2``, str
``seed+3``. Vectors are U[0,1) per element, then L2-normalised (a zero vector
would be kept as is); i32v uniform 0..999; f32v U[0,1); str 5-9 characters of
the alphanumeric alphabet.

Two hash families:

* ``fast`` (default): ``xxhash64`` JVM-side, inside whole-stage codegen.
* ``md5``: 32 bits of ``md5(seed:id:j)``; slower, but DuckDB computes the same
  values, so it is the oracle-checked form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions.vector import normalize

# The generator's defaults and string alphabet.
DEFAULT_SEED = 8888
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STR_MIN_LEN = 5
STR_MAX_LEN = 9
I32V_RANGE = 1000


def uniform(seed: int | Column, id_col: Column, j: Column | int, family: str = "fast") -> Column:
    """U[0,1) double from (seed, id, j)."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    jj = j if isinstance(j, Column) else F.lit(int(j))
    if family == "md5":
        key = F.concat_ws(":", s.cast("string"), id_col.cast("string"), jj.cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    h = F.xxhash64(s.cast("long"), id_col.cast("long"), jj.cast("long"))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _metadata(i: Column, seed: int, family: str) -> list[Column]:
    """``i32v, f32v, strv`` of an id: functions of the id alone."""
    slen = F.lit(STR_MIN_LEN) + F.floor(uniform(seed + 3, i, -1, family) * (STR_MAX_LEN - STR_MIN_LEN + 1)).cast("int")
    chars = F.transform(
        F.sequence(F.lit(0), slen - 1),
        lambda j: F.substring(F.lit(ALPHABET), (F.floor(uniform(seed + 3, i, j, family) * len(ALPHABET)) + 1).cast("int"), 1),
    )
    return [
        F.floor(uniform(seed + 1, i, 0, family) * I32V_RANGE).cast("int").alias("i32v"),
        uniform(seed + 2, i, 0, family).cast("float").alias("f32v"),
        F.array_join(chars, "").alias("strv"),
    ]


def rows_for_ids(ids: DataFrame, dim: int, seed: int = DEFAULT_SEED, family: str = "fast", id_col: str = "id") -> DataFrame:
    """A synthetic row ``(id, embed, i32v, f32v, strv)`` for every id of ``ids``."""
    i = F.col(id_col).cast("long")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: uniform(seed, i, j, family))
    return ids.select(i.alias("id"), normalize(raw).alias("embed"), *_metadata(i, seed, family))


def generate(spark: SparkSession, n: int, dim: int, seed: int = DEFAULT_SEED, start_id: int = 0,
             partitions: int | None = None, family: str = "fast") -> DataFrame:
    """N rows with ids ``start_id .. start_id+n-1`` over contiguous id ranges per partition."""
    ids = spark.range(start_id, start_id + n, 1, partitions)
    return rows_for_ids(ids, dim, seed, family)


def metadata_for(vecs: DataFrame, seed: int = DEFAULT_SEED, start_id: int = 0, family: str = "fast",
                 pos_col: str = "pos", vec_col: str = "embed") -> DataFrame:
    """Give decoded vectors ``(pos, embed)`` an id (start_id + position) and synthetic metadata."""
    i = (F.col(pos_col) + F.lit(int(start_id))).cast("long")
    return vecs.select(i.alias("id"), F.col(vec_col).cast("array<float>").alias("embed"), *_metadata(i, seed, family))


def generate_sql_u(seed_sql: str, id_sql: str, j_sql: str) -> str:
    """DuckDB twin of ``uniform(..., family='md5')``."""
    key = f"CAST({seed_sql} AS VARCHAR) || ':' || CAST({id_sql} AS VARCHAR) || ':' || CAST({j_sql} AS VARCHAR)"
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def rows_sql(ids_sql: str, dim: int, seed: int) -> str:
    """DuckDB twin of :func:`rows_for_ids` (md5 family) over a relation with column ``id``."""
    u = lambda s, j: generate_sql_u(str(s), "id", j)
    raw = f"list_transform(range({dim}), lambda j: {u(seed, 'j')})"
    slen = f"({STR_MIN_LEN} + CAST(floor({u(seed + 3, '-1')} * {STR_MAX_LEN - STR_MIN_LEN + 1}) AS INTEGER))"
    chars = (
        f"list_transform(range({slen}), lambda j: substr('{ALPHABET}', CAST(floor({u(seed + 3, 'j')} * {len(ALPHABET)}) AS INTEGER) + 1, 1))"
    )
    return (
        f"SELECT id, CASE WHEN nrm = 0 THEN list_transform(raw, lambda x: CAST(x AS FLOAT)) "
        f"ELSE list_transform(raw, lambda x: CAST(x / nrm AS FLOAT)) END AS embed, i32v, f32v, strv FROM ("
        f"SELECT id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS nrm, i32v, f32v, strv FROM ("
        f"SELECT id, {raw} AS raw, CAST(floor({u(seed + 1, '0')} * {I32V_RANGE}) AS INTEGER) AS i32v, "
        f"CAST({u(seed + 2, '0')} AS FLOAT) AS f32v, array_to_string({chars}, '') AS strv FROM ({ids_sql})))"
    )


# -- DuckDB twin of the xxhash64 family ------------------------------------------------------

# The five 64-bit primes of XXH64 and Spark's default hash seed.
XXH_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
SPARK_HASH_SEED = 42


def _xxh_long_stages(src: str, prefix: str, v_col: str, seed_col: str) -> list[tuple[str, str]]:
    """CTE stages computing XXH64 of one 8-byte value (``v_col``) with seed ``seed_col``.

    Values are UHUGEINT kept in [0, 2^64); every product of two such values
    fits in 128 bits. Each stage is its own CTE so no expression is repeated.
    """
    p1, p2, p3, p4, p5 = (f"CAST({p} AS UHUGEINT)" for p in XXH_PRIMES)
    m = "CAST(18446744073709551616 AS UHUGEINT)"
    def rotl(x, r):
        return f"(((({x}) << {r}) % {m}) | (({x}) >> {64 - r}))"
    steps = [
        f"*, ({seed_col} + {p5} + 8) % {m} AS _h, ({v_col} * {p2}) % {m} AS _k",
        f"* REPLACE (({rotl('_k', 31)} * {p1}) % {m} AS _k)",
        f"* REPLACE (xor(_h, _k) AS _h)",
        f"* REPLACE (({rotl('_h', 27)} * {p1} + {p4}) % {m} AS _h)",
        "* REPLACE (xor(_h, _h >> 33) AS _h)",
        f"* REPLACE ((_h * {p2}) % {m} AS _h)",
        "* REPLACE (xor(_h, _h >> 29) AS _h)",
        f"* REPLACE ((_h * {p3}) % {m} AS _h)",
        "* REPLACE (xor(_h, _h >> 32) AS _h)",
    ]
    out, prev = [], src
    for i, sel in enumerate(steps):
        name = f"{prefix}{i}"
        out.append((name, f"SELECT {sel} FROM {prev}"))
        prev = name
    return out


def rows_sql_fast(ids_sql: str, dim: int, seed: int) -> str:
    """DuckDB twin of :func:`rows_for_ids` (xxhash64 family) over a relation with column ``id``.

    Returns a CTE list (without WITH) ending in a relation ``gen_rows(id, embed, i32v, f32v, strv)``.
    """
    u64 = "CAST(((CAST({x} AS HUGEINT) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS UHUGEINT)"
    triples = (
        f"SELECT id, 'v' AS c, {seed} AS s, j FROM ({ids_sql}), range({dim}) t(j) "
        f"UNION ALL SELECT id, 'i', {seed + 1}, 0 FROM ({ids_sql}) "
        f"UNION ALL SELECT id, 'f', {seed + 2}, 0 FROM ({ids_sql}) "
        f"UNION ALL SELECT id, 'l', {seed + 3}, -1 FROM ({ids_sql}) "
        f"UNION ALL SELECT id, 'c', {seed + 3}, j FROM ({ids_sql}), range({STR_MAX_LEN}) t(j)"
    )
    ctes = [("xt", f"SELECT id, c, j, {u64.format(x='s')} AS vs, {u64.format(x='id')} AS vi, {u64.format(x='j')} AS vj, "
                   f"CAST({SPARK_HASH_SEED} AS UHUGEINT) AS h0 FROM ({triples})")]
    ctes += _xxh_long_stages("xt", "xa", "vs", "h0")
    ctes.append(("xa_out", "SELECT id, c, j, vi, vj, _h AS h1 FROM xa8"))
    ctes += _xxh_long_stages("xa_out", "xb", "vi", "h1")
    ctes.append(("xb_out", "SELECT id, c, j, vj, _h AS h2 FROM xb8"))
    ctes += _xxh_long_stages("xb_out", "xc", "vj", "h2")
    ctes.append(("xu", "SELECT id, c, j, CAST(_h >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM xc8"))
    ctes.append((
        "xrow",
        "SELECT id, list(u ORDER BY j) FILTER (WHERE c = 'v') AS raw, "
        f"CAST(floor(max(u) FILTER (WHERE c = 'i') * {I32V_RANGE}) AS INTEGER) AS i32v, "
        "CAST(max(u) FILTER (WHERE c = 'f') AS FLOAT) AS f32v, "
        f"{STR_MIN_LEN} + CAST(floor(max(u) FILTER (WHERE c = 'l') * {STR_MAX_LEN - STR_MIN_LEN + 1}) AS INTEGER) AS slen, "
        f"list(substr('{ALPHABET}', CAST(floor(u * {len(ALPHABET)}) AS INTEGER) + 1, 1) ORDER BY j) FILTER (WHERE c = 'c') AS chars "
        "FROM xu GROUP BY id",
    ))
    ctes.append((
        "gen_rows",
        "SELECT id, CASE WHEN nrm = 0 THEN list_transform(raw, lambda x: CAST(x AS FLOAT)) "
        "ELSE list_transform(raw, lambda x: CAST(x / nrm AS FLOAT)) END AS embed, i32v, f32v, "
        "array_to_string(list_slice(chars, 1, slen), '') AS strv FROM ("
        "SELECT *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS nrm FROM xrow)",
    ))
    return ", ".join(f"{n} AS ({q})" for n, q in ctes)
