"""The distance functions for SQL users: temporary SQL functions inlined by Catalyst.

After :func:`register_sql_functions`, queries in the reference's form run
JVM-side (higher-order functions, no Python). Spark does not accept SQL
functions inside ORDER BY itself, so the distance is a column of a subquery:

    SELECT id FROM (SELECT id, l2_distance(embed, vec('[0.1, 0.2, ...]')) AS dist
                    FROM t WHERE i32v < 500)
    ORDER BY dist, id LIMIT 10

``vec`` parses vector text (``[a,b]`` or bare ``a,b``); ``inner_product`` is the
dot product (order by ``-inner_product(...)`` or ``neg_inner_product`` for
nearest first).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SQ = "(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))"
_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (acc, v) -> acc + v)"
_NORM = "sqrt(aggregate(transform({v}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 0D, (acc, v) -> acc + v))"

FUNCTIONS = {
    "vec": ("s STRING", "ARRAY<FLOAT>",
            "from_json(concat('[', regexp_replace(trim(s), '^\\\\[|\\\\]$', ''), ']'), 'array<float>')"),
    "l2_distance_sq": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                       f"aggregate(zip_with(a, b, (x, y) -> {_SQ}), 0D, (acc, v) -> acc + v)"),
    "l2_distance": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                    f"sqrt(aggregate(zip_with(a, b, (x, y) -> {_SQ}), 0D, (acc, v) -> acc + v))"),
    "inner_product": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    "neg_inner_product": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"-({_DOT})"),
    "vector_norm": ("a ARRAY<FLOAT>", "DOUBLE", _NORM.format(v="a")),
    "cosine_distance": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                        f"CASE WHEN {_NORM.format(v='a')} * {_NORM.format(v='b')} = 0 THEN CAST(NULL AS DOUBLE) "
                        f"ELSE 1 - {_DOT} / ({_NORM.format(v='a')} * {_NORM.format(v='b')}) END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions in this session; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
