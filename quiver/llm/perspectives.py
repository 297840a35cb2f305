"""Operator 4: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and the others as named users; roles in
``CONTEXT_ROLES`` are rendered as themselves in every perspective and are no participants.
The loss mask covers the assistant's words and end marks.

    <|im_start|>user name=bob\\nhello<|im_end|>\\n
    <|im_start|>assistant\\nhi<|im_end|>\\n          (loss on ``hi<|im_end|>``)

A rendering comes in chunks of ``CHUNK`` turns, whose concatenation in order is
the dialogue, so a conversation with a third of all rows never meets in one
task: turns are range partitioned by (conversation, turn, ...), numbered inside their range, and
each conversation's numbers continue from range to range by a sum over one
row per range. Mask spans are character positions in the chunk.

Defined results: turns are ordered by ``turn`` (null first), then role, then a hash of
the text; repeated turns all stay. A null role is the participant ``unknown``; a null text
is empty. A null ``conv_id`` is a conversation like any other. A conversation with no participant gives no rows. ``<|`` in a text
or name becomes ``< |``, so no text can forge a mark; white space in a name becomes ``_``. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiver.session import scratch_dir

CHUNK = 64
RANGE_ROWS = 100_000
CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``(conv_id, n, speaker, body)``: ``n`` counts a conversation's turns from 0."""
    order = ["conv_id", "turn", "role", "h"]
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.md5("text")).withColumn("i", F.monotonically_increasing_id())
    path = scratch_dir(spark, "turns")
    # Equal turns are dealt out by their place in the input: which of them comes first cannot be seen.
    laid = rows.repartitionByRange(max(1, -(-turns.count() // RANGE_ROWS)), *order, "i")
    laid.withColumn("part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.parquet(path)
    local = F.row_number().over(W.partitionBy("part", "conv_id").orderBy("turn", "role", "h", "i")) - 1
    counts = laid.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("c"))
    ahead = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("part").alias("p"), F.col("conv_id").alias("conv"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    out = laid.withColumn("local", local).join(offsets, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("conv")))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    speaker = F.regexp_replace(safe(F.coalesce("role", F.lit("unknown"))), r"[\x09-\x0D\x20]", "_")
    return out.select("conv_id", (F.col("local") + F.col("ahead")).alias("n"), speaker.alias("speaker"), safe(F.col("text")).alias("body"))


def rotated(spark: SparkSession, turns: DataFrame, chunk: int = CHUNK, context_roles=CONTEXT_ROLES) -> DataFrame:
    """``(conv_id, perspective, chunk, n_turns, rendered, loss_spans, n_loss_chars)``; ``loss_spans`` is an array of (start, end)."""
    path = scratch_dir(spark, "numbered")
    numbered_turns(spark, turns).write.parquet(path)
    t = spark.read.parquet(path)
    chunks = t.groupBy("conv_id", F.floor(F.col("n") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "body"))).alias("turns"))
    people = t.where(~F.col("speaker").isin(list(context_roles))).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    both = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("conv")))
    me = F.col("perspective")

    def piece(x):
        role = F.when(x["speaker"] == me, F.lit("assistant")).when(x["speaker"].isin(list(context_roles)), x["speaker"]).otherwise(F.concat(F.lit("user name="), x["speaker"]))
        head = F.concat(F.lit(START), role, F.lit("\n"))
        return F.struct(head.alias("head"), F.concat(x["body"], F.lit(END)).alias("body"), (x["speaker"] == me).alias("loss"))

    both = both.withColumn("pieces", F.transform("turns", piece))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", zero, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    loss = F.aggregate("loss_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    out = both.withColumn("loss_spans", spans).withColumn("rendered", text).withColumn("n_loss_chars", loss.cast("long"))
    return out.select("conv_id", "perspective", F.col("chunk").cast("long"), F.size("turns").cast("long").alias("n_turns"), "rendered", "loss_spans", "n_loss_chars")


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``; spans as ``start-end`` joined by commas."""
    out = rotated(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    text = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("loss_spans", text)


ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) - 1 AS n,
    regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\x09-\\x0D\\x20]', '_', 'g') AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT conv_id, perspective, n // {CHUNK} AS chunk, n, speaker = perspective AS loss, length(body) + {len(END)} AS body_len,
  '{START}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head,
  body || '{END}' AS body FROM t JOIN p ON conv_id IS NOT DISTINCT FROM conv),
s AS (SELECT *, coalesce(sum(length(head) + body_len + 1) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + length(head) AS start FROM r)
SELECT conv_id, perspective, chunk::BIGINT AS chunk, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(start::BIGINT || '-' || (start + body_len)::BIGINT, ',' ORDER BY n) FILTER (loss), '') AS loss_spans,
  coalesce(sum(body_len) FILTER (loss), 0)::BIGINT AS n_loss_chars
FROM s GROUP BY conv_id, perspective, chunk
"""
