"""Vector Column functions (JVM-side higher-order functions, no Python per row).

All arithmetic is in double; inputs are ``array<float>``. A scalar computed
from a vector (its norm, a min/max) enters a lambda only through :func:`let`,
otherwise Catalyst inlines it and re-evaluates it per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Metric names accepted by every search: ours and the op-type spellings of configs.
METRICS = {
    "l2": "l2",
    "l2_distance": "l2",
    "vector_l2_ops": "l2",
    "l2sq": "l2sq",
    "l2_distance_sq": "l2sq",
    "vector_l2sq_ops": "l2sq",
    "cosine": "cosine",
    "cosine_distance": "cosine",
    "vector_cosine_ops": "cosine",
    "ip": "ip",
    "inner_product": "ip",
    "vector_ip_ops": "ip",
}


def resolve_metric(name: str) -> str:
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; expected one of {sorted(METRICS)}") from None


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    ``transform(array(v), x -> body(x))[0]`` binds the value as a lambda
    variable, so ``body`` may use it inside nested lambdas without Catalyst
    inlining (and recomputing) it per element.
    """
    return F.transform(F.array(value), body)[0]


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def inner_product(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V4: the dot product. Searches rank by ``-inner_product`` (largest first)."""
    return dot(a, b)


def l2_distance_sq(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V2: squared Euclidean distance."""
    return _sum(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V1: Euclidean distance."""
    return F.sqrt(l2_distance_sq(a, b))


def norm(a: ColumnOrName) -> Column:
    """V5: L2 norm."""
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V3: ``1 - a.b / (|a||b|)``; NULL when either vector is zero."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(1.0 - dot(a, b) / den)


def distance(metric: str, a: ColumnOrName, b: ColumnOrName) -> Column:
    """Ranking key for ``metric``: smaller is nearer (ip gives ``-dot``)."""
    m = resolve_metric(metric)
    if m == "l2":
        return l2_distance(a, b)
    if m == "l2sq":
        return l2_distance_sq(a, b)
    if m == "cosine":
        return cosine_distance(a, b)
    return -inner_product(a, b)


def normalize(a: ColumnOrName) -> Column:
    """V5: unit-length vector as ``array<float>``; a zero vector is returned unchanged."""
    a = _c(a)
    return let(
        norm(a),
        lambda n: F.when(n == 0, a.cast("array<float>")).otherwise(
            F.transform(a, lambda x: (x.cast("double") / n).cast("float"))
        ),
    )


def cast_vector(a: ColumnOrName, element_type: str = "float") -> Column:
    """V7: cast the elements of a vector (e.g. int8/uint8/half decoded) to float32."""
    return _c(a).cast(f"array<{element_type}>")


def check_dim(a: ColumnOrName, dim: int) -> Column:
    """The vector itself, or a job error when it is NULL or of another dimension."""
    a = _c(a)
    return F.when(a.isNotNull() & (F.size(a) == dim), a).otherwise(
        F.raise_error(F.concat(F.lit(f"vector dimension is not {dim}: size="), F.coalesce(F.size(a).cast("string"), F.lit("null"))))
    )


def to_text(a: ColumnOrName) -> Column:
    """``[x,y,...]`` text of a vector."""
    return F.to_json(_c(a))


def parse_vector(s: ColumnOrName) -> Column:
    """``[a,b,...]`` or bare ``a,b,...`` text to ``array<float>``."""
    s = F.trim(_c(s))
    bracketed = F.concat(F.lit("["), F.regexp_replace(s, r"^\[|\]$", ""), F.lit("]"))
    return F.from_json(bracketed, "array<float>")


def strict_vector(s: ColumnOrName) -> Column:
    """``parse_vector``, or a job error where the text is null or not a list of numbers."""
    v = parse_vector(s)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.concat(F.lit("not a vector: "), F.coalesce(F.substring(_c(s), 1, 80), F.lit("null"))))).otherwise(v)


# -- V8 scalar quantization ---------------------------------------------------

# Code ranges of the integer quantization types.
INT8_RANGE = (-128, 127)
UINT8_RANGE = (0, 255)


def quantize(a: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, qtype: str) -> Column:
    """Affine scalar quantization with global bounds ``lo``/``hi`` (doubles).

    int8 -> ``array<tinyint>``, uint8 -> ``array<smallint>``; fp16 rounds each
    element to the nearest half-precision value; fp32 is a cast.
    """
    a = _c(a)
    q = qtype.lower()
    if q in ("fp32", "float32", "float"):
        return a.cast("array<float>")
    if q in ("fp16", "float16", "half"):
        return F.transform(a, _round_half)
    if q in ("int8", "uint8"):
        cmin, cmax = INT8_RANGE if q == "int8" else UINT8_RANGE
        out_t = "tinyint" if q == "int8" else "smallint"
        lo_c, hi_c = _c(lo).cast("double"), _c(hi).cast("double")
        return let(
            F.when(hi_c > lo_c, (cmax - cmin) / (hi_c - lo_c)).otherwise(F.lit(0.0)),
            lambda scale: F.transform(
                a,
                lambda x: F.least(
                    F.greatest(F.round((x.cast("double") - lo_c) * scale + cmin), F.lit(float(cmin))), F.lit(float(cmax))
                ).cast(out_t),
            ),
        )
    raise ValueError(f"unknown quantization type {qtype!r}")


def dequantize(codes: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, qtype: str) -> Column:
    q = qtype.lower()
    cmin, cmax = INT8_RANGE if q == "int8" else UINT8_RANGE
    lo_c, hi_c = _c(lo).cast("double"), _c(hi).cast("double")
    step = (hi_c - lo_c) / (cmax - cmin)
    return F.transform(_c(codes), lambda c: ((c.cast("double") - cmin) * step + lo_c).cast("float"))


def _round_half(x: Column) -> Column:
    """Round a float to the nearest IEEE half value (round-half-even on the 10-bit mantissa).

    Normal range only; magnitudes above 65504 become +-inf, below 2^-14 are
    rounded on the subnormal grid of step 2^-24.
    """
    d = x.cast("double")
    ad = F.abs(d)
    e = F.floor(F.log2(F.when(ad > 0, ad).otherwise(F.lit(1.0))))
    e = F.greatest(e, F.lit(-14.0))
    step = F.pow(F.lit(2.0), e - 10)
    r = F.bround(d / step, 0) * step
    return F.when(ad == 0, d.cast("float")).when(F.abs(r) > 65504.0, (F.signum(d) * F.lit(float("inf"))).cast("float")).otherwise(
        r.cast("float")
    )
