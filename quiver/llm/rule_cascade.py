"""Operator 6: quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document by a condition over measures of its whole text. On
a sample (``SAMPLE_ROWS`` rows on average, written once) each rule is run alone:
its time above an empty pass is its cost, the share that it rejects its
selectivity. Rules then run in the order of rejections per second; a measure is computed
only for documents that no earlier rule rejected, and shared by later rules.
The order changes the cost, never the verdict. The sample serves the order alone:
every document is judged on its whole text.

Defined results: a null text is an empty one (no words, so the first base rule
rejects it); ids may be null or repeated, every row is judged by itself; columns
named like a measure are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_dir

SAMPLE_ROWS = 1_000
WINDOW = 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _windows() -> Column:
    at = F.sequence(F.lit(1), F.col("m_n_words").cast("int") - (WINDOW - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(F.col("m_words"), i, WINDOW)))
    return F.when(F.col("m_n_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _repeated() -> Column:
    """Words covered by windows that occur twice or more: equal hashes are neighbours once sorted."""
    windows, pairs = F.col("m_windows"), F.col("m_pairs")
    hash_at = lambda i: F.get(pairs, i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.coalesce(hash_at(i) == hash_at(i - 1), F.lit(False)) | F.coalesce(hash_at(i) == hash_at(i + 1), F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda i: F.get(pairs, i)["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
    covered = F.aggregate(starts, zero, step, lambda acc: acc["n"])
    return F.when(pairs.isNull(), F.lit(0)).otherwise(covered).cast("long")


def _pairs() -> Column:
    """(hash, position) sorted, where some window occurs twice; else null."""
    w = F.col("m_windows")
    return F.when(F.size(F.array_distinct(w)) < F.size(w), F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


#: measure: (measures that it is computed from, its expression)
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "words": ((), lambda: F.array_remove(F.split("m_text", r"[\x20\x09-\x0D]+"), "")),
    "n_words": (("words",), lambda: F.size("m_words").cast("long")),
    "word_chars": ((), lambda: _without(F.col("m_text"), SPACES).cast("long")),
    "n_symbols": ((), lambda: (F.length("m_text") - _without(F.col("m_text"), SYMBOLS)).cast("long")),
    "lines": ((), lambda: F.filter(F.split("m_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")),
    "n_lines": (("lines",), lambda: F.size("m_lines").cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long")),
    "n_upper": ((), lambda: (F.length("m_text") - F.length(F.translate("m_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")),
    "windows": (("words", "n_words"), _windows),
    "pairs": (("windows",), _pairs),
    "n_repeat_words": (("windows", "pairs"), _repeated),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``condition`` (SQL over the measures) holds."""

    name: str
    needs: tuple[str, ...]
    condition: str


BASE = (
    Rule("few_words", ("n_words",), "n_words < 20"),
    Rule("repeats", ("n_repeat_words", "n_words"), "100 * n_repeat_words > 30 * n_words"),
)
RULES = BASE + (
    Rule("word_length", ("word_chars", "n_words"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", ("n_symbols", "n_words"), "5 * n_symbols > n_words"),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), "n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", ("n_upper", "word_chars"), "100 * n_upper > 40 * word_chars"),
)


def _add(df: DataFrame, name: str, guard: Column | None) -> DataFrame:
    """``df`` with measure ``name`` and what it is computed from, as columns ``m_...``."""
    if f"m_{name}" in df.columns:
        return df
    inputs, expr = MEASURES[name]
    for x in inputs:
        df = _add(df, x, guard)
    return df.withColumn(f"m_{name}", expr() if guard is None else F.when(guard, expr()))


def _condition(rule: Rule) -> Column:
    names = {n: f"m_{n}" for n in rule.needs}
    return F.expr(" ".join(names.get(w, w) for w in rule.condition.split()))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] | list[Rule], wanted: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus the ``wanted`` measures of every row and ``rejected_by``: the first rule, in the given order, that rejects it.

    These replace columns of their names; all others stay.
    """
    own = [c for c in docs.columns if c not in wanted and c != "rejected_by"]
    df = docs.select(F.struct(*[docs[c] for c in own]).alias("m_row"), F.coalesce("text", F.lit("")).alias("m_text"), F.lit(None).cast("string").alias("m_by"))
    for name in wanted:
        df = _add(df, name, None)
    for rule in rules:
        for name in rule.needs:
            df = _add(df, name, F.col("m_by").isNull())
        df = df.withColumn("m_by", F.when(F.col("m_by").isNull() & _condition(rule), F.lit(rule.name)).otherwise(F.col("m_by")))
    return df.select(*[F.col("m_row")[c].alias(c) for c in own], *[F.col(f"m_{n}").alias(n) for n in wanted], F.col("m_by").alias("rejected_by"))


def measured_order(spark: SparkSession, docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``(rule, seconds, share rejected)`` by rejections per second, measured on a sample."""
    total = docs.count()
    path = scratch_dir(spark, "rules")
    docs.select("text").sample(min(1.0, sample_rows / max(total, 1)), seed=11).write.parquet(path)
    sample = spark.read.parquet(path)

    def run(some) -> tuple[float, float]:
        began = time.perf_counter()
        share = cascade(sample, some).agg(F.avg(F.col("rejected_by").isNotNull().cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    run(rules)
    empty, _ = run(())
    found = [(r, *run((r,))) for r in rules]
    found = [(r, max(s - empty, 1e-3), share) for r, s, share in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def judged(spark: SparkSession, docs: DataFrame, rules=RULES, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The cascade with its rules in measured order."""
    return cascade(docs, [r for r, _, _ in measured_order(spark, docs, rules)], wanted)


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with the base measures of every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = judged(spark, docs, RULES, base)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  row_number() OVER () AS rid FROM t),
wins AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
rep AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT 5 * n_symbols > n_words
  AND NOT (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines) AND NOT 100 * n_upper > 40 * word_chars AS kept
FROM b
"""
