"""Operator 10: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by ``md5(seed, doc_id)`` and served in that
order, ``REPEATS`` times at most. A service of a document ends at the source's
words served so far, divided by the source's weight: its virtual time (taken
at the middle of the document, so that the last one is taken when that brings the
source nearer to its target). All services are range sorted by virtual
time and the queue is cut where the total budget is used up. Sources that
run dry leave their share to the others by weight, which is what the water-filled
targets say in closed form.

Words served before a document are a sum over its (source, hash range) bucket plus
a sum over buckets, so a source with a third of all rows is spread over
as many buckets as it needs. One row per source is all that meets in one place.

Defined results: a null text has size 0; a null ``source`` is a source of its own,
ranked last; a null ``doc_id`` is shuffled like any other id; equal rows are
interchangeable; an empty table gives an empty mix. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiver.llm.ordered import running_sum
from quiver.session import scratch_dir

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
BUDGET_PERCENT = 150
REPEATS = 2
BUCKET_ROWS = 20_000  # documents of all sources per hash range, on average
RUN_ROWS = 500_000  # services per range partition of the queue


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``sizes(source, source_size)``: shares by weight, none above its cap."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * repeats)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * budget_percent / F.lit(100))
    first = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = first.rowsBetween(W.unboundedPreceding, -1)
    after = first.rowsBetween(0, W.unboundedFollowing)
    share = F.col("weight") * (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("full", F.col("cap") <= share)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    heavy = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * left / heavy))
    return t.select("source", "source_size", "weight", "target")


def fair_mix(
    spark: SparkSession, sized: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, repeats: int = REPEATS, seed: str = "mix"
) -> DataFrame:
    """``sized(doc_id, source, size, ...)`` plus ``source_size, target, copies, taken``, which replace columns of these names; every row stays.

    ``size`` must not be null. ``copies`` is how often the mix takes the document, ``taken`` its words in all.
    """
    buckets = 1 << max(0, (sized.count() // BUCKET_ROWS).bit_length())
    key = F.md5(F.concat(F.lit(seed), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    at = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken")]
    held = F.struct(*[sized[c] for c in extra]) if extra else F.lit(True)
    rows = sized.select("doc_id", "source", "size", held.alias("mix_row")).withColumn("mix_key", key).withColumn("mix_at", at)
    totals = rows.groupBy("source", "mix_at").agg(F.sum("size").alias("words"))
    path = scratch_dir(spark, "mix")
    totals.write.parquet(path)
    totals = spark.read.parquet(path)
    plan = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_percent, repeats)
    plan.write.parquet(f"{path}-plan")
    plan = spark.read.parquet(f"{path}-plan")
    ahead = W.partitionBy("source").orderBy("mix_at").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    lookup = totals.join(plan, totals["source"].eqNullSafe(plan["source"])).select(
        totals["source"].alias("mix_source"), F.col("mix_at").alias("mix_b"), "ahead", "source_size", "weight", "target")
    within = W.partitionBy("source", "mix_at").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    served = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    served = served.join(lookup, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_at") == F.col("mix_b")))
    middle = lambda c: (2 * (F.col("ahead") + F.col("inside") + c * F.col("source_size")) + F.col("size")).cast("double") / (2 * F.col("weight"))
    place = lambda c: F.struct(middle(c).alias("t"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), F.col("mix_key").alias("k"), c.alias("c"))
    queue = served.select("size", F.explode(F.array(*[place(F.lit(c)) for c in range(repeats)])).alias("place"))
    budget = (plan.agg(F.sum("source_size")).first()[0] or 0) * budget_percent
    runs = running_sum(spark, queue.select("size", "place"), ["place"], "size", -(-rows.count() * repeats // RUN_ROWS))
    last = runs.where((2 * F.col("before") + F.col("size")) * 50 <= budget).agg(F.max("place").alias("last"))
    row = last.first()["last"]
    if row is None:
        copies = F.lit(0)
    else:
        cut = F.struct(F.lit(row["t"]).alias("t"), F.lit(row["s"]).alias("s"), F.lit(row["n"]).alias("n"), F.lit(row["k"]).alias("k"), F.lit(row["c"]).alias("c"))
        copies = sum((F.when(place(F.lit(c)) <= cut, 1).otherwise(0) for c in range(repeats)), F.lit(0))
    out = served.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    own = [c for c in sized.columns if c in extra or c in ("doc_id", "source", "size")]
    return out.select(*[F.col("mix_row")[c].alias(c) if c in extra else F.col(c) for c in own], "source_size", "target", "copies", "taken")


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken row of ``docs``, once per copy, with the columns of ``docs``."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words_in().alias("size"))
    mixed = fair_mix(spark, sized, **options).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see the module for weights and budget."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_dir(spark, "sizes")
    docs.select("doc_id", "source", words_in().alias("size")).write.parquet(path)
    return fair_mix(spark, spark.read.parquet(path)).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix/' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, source_size * 2 AS cap,
    (sum(source_size) OVER ())::BIGINT * 150 / 100.0::DOUBLE AS budget FROM ranked),
shared AS (
  SELECT *, cap <= weight * (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS is_full
  FROM weighted),
plan AS (
  SELECT source, source_size, weight, CASE WHEN is_full THEN cap::DOUBLE
    ELSE weight * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)::DOUBLE)
      / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::DOUBLE END AS target FROM shared),
served AS (
  SELECT s.doc_id, s.source, s.size, s.k, p.source_size, p.weight, p.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
queue AS (
  SELECT *, (2 * (ahead + c * source_size) + size)::DOUBLE / (2 * weight) AS t FROM served, (VALUES (0), (1)) r(c)),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY t, coalesce(source, ''), source IS NULL, k, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM queue)
SELECT doc_id, size, source_size, target,
  sum(CASE WHEN (2 * before + size) * 50 <= (SELECT sum(size) FROM sized) * 150 THEN size ELSE 0 END)::BIGINT AS taken,
  sum(CASE WHEN (2 * before + size) * 50 <= (SELECT sum(size) FROM sized) * 150 THEN 1 ELSE 0 END)::INTEGER AS copies
FROM ordered GROUP BY doc_id, size, source_size, target, k
"""
