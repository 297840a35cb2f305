"""Metadata predicates as Columns (literals only, never SQL text).

Built from plain comparisons so Catalyst pushes them into the Parquet scan.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(i32v_lt: int | None = None, f32v_lt: float | None = None, strv_eq: str | None = None) -> Column | None:
    """AND of the present filters; ``None`` when no filter is given."""
    conds = []
    if i32v_lt is not None:
        conds.append(F.col("i32v") < F.lit(int(i32v_lt)))
    if f32v_lt is not None:
        conds.append(F.col("f32v") < F.lit(float(f32v_lt)).cast("float"))
    if strv_eq is not None:
        conds.append(F.col("strv") == F.lit(str(strv_eq)))
    if not conds:
        return None
    return functools.reduce(operator.and_, conds)


def filters_from(d: dict | None) -> Column | None:
    """Filter dict as used by configs: keys ``i32v``, ``f32v``, ``str``/``strv``."""
    if not d:
        return None
    return where(d.get("i32v"), d.get("f32v"), d.get("strv", d.get("str")))


def eligible(cond: Column | None) -> Column:
    """whether a (query) row itself satisfies the filters; true without filters."""
    return F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))


def apply(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.where(cond)


def id_at_least(df: DataFrame, start_id: int) -> DataFrame:
    """F6."""
    return df.where(F.col("id") >= F.lit(int(start_id)))


def id_in(df: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """``id IN (ids)`` / ``NOT IN`` as semi / anti join on the ``id`` column of ``ids``."""
    return df.join(ids.select("id"), "id", "left_semi" if keep else "left_anti")
