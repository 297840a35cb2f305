"""Operator 3: benchmark decontamination by template windows, in DataFrame functions only.

A text becomes a template: lower-cased words, with numbers, names (capitalised
inside a sentence; words all in capitals are ordinary words) and units (a unit word after a number) replaced by typed
placeholders; the words that were replaced are its slots. Every window of ``WINDOW``
template tokens with at least ``LITERALS`` plain words is a key; so is its case-blind form, with numbers
and units replaced but no names, so a verbatim passage is found whatever its case or surroundings. A window that is
poor in plain words even so, and an item under ``SHORTEST`` tokens, is keyed by its words as they are, so every item
with a word has a key. Items shorter than a window are one window of their own length.

1. *Candidates.* Window hashes of all documents, in the forms that the items' keys have, meet the items' distinct
   hashes; only (id, hash) leave the projection, and only documents with a
   hit go on. A token is hashed once per form, a window from its tokens' hashes. The items' windows are broadcast when
   their measured bytes are within ``BROADCAST_BYTES`` and their rows within ``BROADCAST_ROWS``, else both sides are shuffled by hash.
2. *Verification.* For the candidates alone, windows carry their key and
   words and join the items' on hash and key. Hits of one item at one
   alignment (document position less item position) are compared slot by slot: a slot conflicts when it
   differs from the item's and its value is not the most frequent (or as frequent) for that
   item value there. Only windows with a conflicting slot count as inconsistent.
3. *Dropping.* ``leaks`` reports every item found; ``clean`` drops a document for a share of an item's windows or a long
   verbatim run, so a stock phrase of one window is not enough.

``op3_template_decontam`` returns the rows of ``leaks``, which ``ORACLE`` defines in SQL; the pipeline runs ``clean``.

Defined results: null and empty texts have no windows, and empty tables give no rows (``clean`` then keeps all); long texts
are searched whole; rows with a null ``doc_id`` are
not judged (``clean`` keeps them); rows that repeat a ``doc_id`` are judged together; repeated items
count once per ``item_id``; a null ``item_id`` is searched like any other; of alignments that tie, the earliest and then the
longest is reported; no other column is read, so none clashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm.selection import without
from quiver.session import scratch_dir

WINDOW = 8
LITERALS = 4
SHORTEST = 4
BROADCAST_BYTES = 64 << 20  # of item windows, by their measured text
BROADCAST_ROWS = 1_000_000  # of item windows
SHARE = 50  # per cent of an item's windows that drop a document
RUN = 13  # words of a verbatim run that do so
RAW, BLIND, TEMPLATE = range(3)  # forms of a key: no placeholder; numbers and units; names too

# Unit words that make a unit placeholder after a number.
UNITS = (
    "mm cm m km inch inches feet foot yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents"
).split()
NAME, NUMBER, UNIT = "<name>", "<num>", "<unit>"
_MARK = "\x01"


def tokens(text: Column, fold=F.lower) -> Column:
    """Words, lower-cased; a name keeps a mark in front."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\x09-\x0D\x20.!?:;])([\x09-\x0D\x20]+)(\p{Lu}\p{Ll})", f"$1 {_MARK}$3")
    t = F.regexp_replace(fold(t), r"([0-9])[.,]([0-9])", "$1$2")
    t = F.regexp_replace(t, r"([0-9])(\p{L})", "$1 $2")
    return F.array_remove(F.split(t, r"[^\x01\p{L}\p{M}\p{N}]+"), "")


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def template(words: Column) -> Column:
    def one(w: Column, i: Column) -> Column:
        unit = w.isin(UNITS) & F.coalesce(_is_number(F.get(words, i - 1)), F.lit(False))
        return F.when(w < "\x02", F.lit(NAME)).when(_is_number(w), F.lit(NUMBER)).when(unit, F.lit(UNIT)).otherwise(w)

    return F.transform(words, one)


def _slices(of: str, size: int, make) -> Column:
    at = F.sequence(F.lit(1), F.size(of) - (size - 1))
    return F.when(F.size(of) >= size, F.transform(at, make))


def _plain(window: Column) -> Column:
    return F.size(F.filter(window, lambda t: ~t.startswith("<")))


def _least(size: int) -> int:
    return min(LITERALS, size // 2)


def _folded(df: DataFrame, key: str) -> DataFrame:
    """``(key, n, raw, nums, blind, tmpl)``: words whatever their case, with numbers, with numbers and units, with all placeholders."""
    df = df.select(key, tokens(F.col("text"), lambda t: F.lower(F.upper(t))).alias("words"))
    df = df.withColumn("raw", F.transform("words", lambda w: F.translate(w, _MARK, "")))
    nums = F.transform("raw", lambda w: F.when(_is_number(w), F.lit(NUMBER)).otherwise(w))
    return df.select(key, F.size("raw").alias("n"), "raw", nums.alias("nums"), template(F.col("raw")).alias("blind"), template(F.col("words")).alias("tmpl"))


def _form(form: int, size: int):
    """The window at a position in one form. What precedes a window doesn't change its case-blind form, so no unit leads it."""
    if form == BLIND:
        return lambda i: F.concat(F.slice("nums", i, 1), F.slice("blind", i + 1, size - 1))
    return lambda i: F.slice("raw" if form == RAW else "tmpl", i, size)


def _token_hashes(tokens: Column | str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _hash_of(form: int, size: int):
    """A window's hash, over columns that hold their tokens' hashes; ``_key_hash`` gives the same for a window's tokens."""
    return lambda i: F.xxhash64(_form(form, size)(i))


def _key_hash(tokens: Column | str) -> Column:
    return F.xxhash64(_token_hashes(tokens))


def _window_of(form: int, size: int):
    return lambda i: F.struct(i.alias("pos"), _key_hash(_form(form, size)(i)).alias("hash"), F.array_join(_form(form, size)(i), " ").alias("window"), F.slice("raw", i, size).alias("words"))


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    """``(item_id, n, item_pos, size, rich, slots, form, hash, window)``: the keys of every window of one size."""
    make = lambda i: F.struct(i.alias("item_pos"), *(_form(f, size)(i).alias(c) for f, c in ((RAW, "r"), (BLIND, "b"), (TEMPLATE, "t"))))
    rows = items.select("item_id", "n", F.explode(_slices("raw", size, make)).alias("z")).select("item_id", "n", "z.*")
    enough = lambda w: (_plain(F.col(w)) >= _least(size)) & (F.col("n") >= SHORTEST)
    slots = F.filter(F.transform("t", lambda t, k: F.struct(k.alias("k"), F.get("r", k).alias("b"), t.alias("t"))), lambda z: z["t"].startswith("<"))
    keys = F.array_distinct(F.array_compact(F.array(F.when(enough("t"), F.col("t")), F.when(enough("b"), F.col("b")), F.when(~enough("b"), F.col("r")))))
    rows = rows.select("item_id", "n", "item_pos", F.lit(size).alias("size"), enough("b").alias("rich"), slots.alias("slots"), F.explode(keys).alias("key"))
    named = F.exists("key", lambda t: t == NAME) | (F.get("key", F.lit(0)) == UNIT)
    form = F.when(named, F.lit(TEMPLATE)).when(F.exists("key", lambda t: t.startswith("<")), F.lit(BLIND)).otherwise(F.lit(RAW))
    return rows.select("*", form.alias("form"), _key_hash("key").alias("hash"), F.array_join("key", " ").alias("window")).drop("key").distinct()


def _alignments(hits: DataFrame) -> DataFrame:
    """One row per document, item and shift: matched windows, those without a conflicting slot, longest verbatim run."""
    at = ["doc_id", "item_id", "shift"]
    pair = F.transform("slots", lambda s: F.struct((F.col("pos") + s["k"]).alias("q"), s["b"].alias("b"), F.get("words", s["k"]).alias("d")))
    hits = hits.withColumn("pairs", pair).withColumn("same", F.forall("pairs", lambda p: p["b"] == p["d"]) & F.col("rich"))
    hits = hits.select(*at, "pos", "size", "n", "n_doc", "same", F.explode_outer("pairs").alias("p")).select("*", "p.*").repartition(*at)
    votes = F.size(F.collect_set("q").over(Window.partitionBy(*at, "b", "d")))
    hits = hits.withColumn("votes", votes).withColumn("top", F.max("votes").over(Window.partitionBy(*at, "b")))
    conflict = (F.col("d") != F.col("b")) & (F.col("votes") < F.col("top"))
    rows = hits.groupBy(*at).agg(
        F.collect_set("pos").alias("all"), F.collect_set(F.when(conflict, F.col("pos"))).alias("bad"), F.collect_set(F.when(F.col("same"), F.col("pos"))).alias("verbatim"),
        F.size(F.collect_set(F.when(F.col("p").isNotNull(), F.struct("b", "d")))).alias("n_slots"), F.max("size").alias("size"), F.max("n").alias("n"), F.max("n_doc").alias("n_doc"))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def longer(acc: Column, p: Column) -> Column:
        run = F.when(p == acc["at"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("at"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    run = F.aggregate(F.array_sort("verbatim"), start, longer)["most"]
    return rows.select(
        "doc_id", "item_id", "n", "n_doc", (F.col("n") - F.col("size") + 1).alias("n_item"), F.size("all").alias("n_windows"), F.size(F.array_except("all", "bad")).alias("n_consistent"),
        "n_slots", F.when(run > 0, run + F.col("size") - 1).otherwise(F.lit(0)).alias("n_verbatim"),
        F.array_min("all").alias("first_pos"), (F.array_max("all") + F.col("size")).alias("end_pos"))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_consistent, n_item, n_slots, n_verbatim, leaked, first_word, last_word)``: each item found in a document.

    Windows matched at the item's best alignment, those of them without a conflicting slot, all windows of the item, distinct
    slot pairs, words of the longest verbatim run, whether that is
    enough to drop the document, and the span of tokens (from 0) that the matched windows cover.

    Enough is, at one alignment: ``SHARE`` per cent of the item's windows (all of them where it has no more than ``window``), or a
    verbatim run of ``RUN`` words, each window of it with enough plain words. An item under ``SHORTEST`` tokens must be the whole text.
    """
    items = _folded(benchmark, "item_id").where("n > 0")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 values
    keyed = None
    for size in [*short, window]:
        part = _item_windows(items.where(F.col("n") == size) if size < window else items.where(F.col("n") >= window), size)
        keyed = part if keyed is None else keyed.unionByName(part)
    path = scratch_dir(spark, "item_windows")
    keyed.write.parquet(path)
    keyed = spark.read.parquet(path)
    keys = keyed.select("hash").distinct()
    n, held = keyed.agg(F.count(F.lit(1)), F.sum(2 * F.octet_length("window") + 200)).first()  # a row's slots are words of its window
    fit = F.broadcast if n <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else (lambda d: d)
    used = sorted(tuple(r) for r in keyed.select("form", "size").distinct().collect())  # a document's windows in other forms meet no key

    known = docs.where("doc_id is not null").select("doc_id", "text")
    none = F.array().cast("array<bigint>")
    hashes = [none, *(F.coalesce(_slices("raw", size, _hash_of(form, size)), none) for form, size in used)]
    hashed = _folded(known, "doc_id").select("doc_id", *(_token_hashes(c).alias(c) for c in ("raw", "nums", "blind", "tmpl")))
    found = hashed.select("doc_id", F.explode(F.concat(*hashes)).alias("hash")).join(fit(keys), "hash", "left_semi")

    again = _folded(known.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    mine = []
    for form, size in used:
        mine.append(again.select("doc_id", F.col("n").alias("n_doc"), F.lit(size).alias("size"), F.lit(form).alias("form"), F.explode(_slices("raw", size, _window_of(form, size))).alias("z")).select("doc_id", "n_doc", "size", "form", "z.*"))
    if not mine:
        mine = [again.select("doc_id", F.col("n").alias("n_doc"), F.lit(0).alias("size"), F.lit(0).alias("form"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("window"), F.col("raw").alias("words"))]
    met = reduce(DataFrame.unionByName, mine).join(fit(keyed), ["hash", "window", "size", "form"])
    rows = _alignments(met.withColumn("shift", F.col("pos") - F.col("item_pos")))
    share = F.when(F.col("n_item") > window, F.col("n_consistent") * 100 >= F.col("n_item") * SHARE).otherwise(F.col("n_consistent") == F.col("n_item"))
    whole = (F.col("n") >= SHORTEST) | (F.col("n_doc") == F.col("n"))
    rows = rows.withColumn("leaked", whole & (share | (F.col("n_verbatim") >= RUN)))
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("leaked", "n_consistent", "n_windows", -F.col("first_pos"), "end_pos", "n_item", "n_slots", "n_verbatim")).alias("m"))
    count = lambda c: F.col(f"m.{c}").cast("long").alias(c)
    return best.select("doc_id", "item_id", *(count(c) for c in ("n_windows", "n_consistent", "n_item", "n_slots", "n_verbatim")), "m.leaked",
                       (-F.col("m.col4") - 1).cast("long").alias("first_word"), (F.col("m.end_pos") - 2).cast("long").alias("last_word"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without enough of any item; ``leaks`` tells what is enough."""
    return without(spark, docs, leaks(spark, docs, benchmark, window).where("leaked"))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``: ``leaks``."""
    return leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)


def _template_sql(words: str, name: str) -> str:
    return f"""list_transform({words}, lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN '<name>' WHEN w >= '0' AND w < ':' THEN '<num>'
    WHEN w IN ({_UNIT_LIST}) AND i > 1 AND {words}[i - 1] >= '0' AND {words}[i - 1] < ':' THEN '<unit>' ELSE w END) AS {name}"""


_FOLDED = f"""
  SELECT *, len(raw) AS n, list_transform(raw, lambda w: CASE WHEN w >= '0' AND w < ':' THEN '<num>' ELSE w END) AS nums, {_template_sql('raw', 'blind')}, {_template_sql('words', 'tmpl')}
  FROM (SELECT *, list_transform(words, lambda w: replace(w, chr(1), '')) AS raw
    FROM (SELECT key, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(upper(regexp_replace(coalesce(text, ''),
      '([^\\x09-\\x0D\\x20.!?:;])([\\x09-\\x0D\\x20]+)(\\p{{Lu}}\\p{{Ll}})', '\\1 ' || chr(1) || '\\3', 'g'))),
      '([0-9])[.,]([0-9])', '\\1\\2', 'g'), '([0-9])(\\p{{L}})', '\\1 \\2', 'g'), '[^\\x01\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM %s))"""
_FORMS = """
  SELECT key, n, pos, k AS size, raw[pos:pos + k - 1] AS r, list_concat(nums[pos:pos], blind[pos + 1:pos + k - 1]) AS b, tmpl[pos:pos + k - 1] AS t
  FROM %s, unnest(range(1, n - k + 2)) AS u(pos)"""
_ENOUGH = "(len(list_filter({0}, lambda x: NOT starts_with(x, '<'))) >= least({1}, size // 2) AND n >= {2})"
ORACLE = f"""
WITH items AS (SELECT * FROM ({_FOLDED % '(SELECT item_id AS key, text FROM benchmark)'}) WHERE n > 0),
sizes AS (SELECT DISTINCT least(n, {WINDOW}) AS k FROM items),
docs AS ({_FOLDED % '(SELECT doc_id AS key, text FROM documents WHERE doc_id IS NOT NULL)'}),
iw AS (SELECT *, {_ENOUGH.format('t', LITERALS, SHORTEST)} AS et, {_ENOUGH.format('b', LITERALS, SHORTEST)} AS eb
  FROM ({_FORMS % f'(SELECT *, least(n, {WINDOW}) AS k FROM items)'})),
keys AS (SELECT DISTINCT key, n, pos, size, eb AS rich, list_filter(list_transform(t, lambda x, i: CASE WHEN starts_with(x, '<') THEN {{'i': i, 'b': r[i]}} END), lambda s: s IS NOT NULL) AS slots,
    unnest(list_filter([CASE WHEN et THEN t END, CASE WHEN eb THEN b END, CASE WHEN NOT eb THEN r END], lambda x: x IS NOT NULL)) AS w FROM iw),
theirs AS (SELECT *, array_to_string(w, ' ') AS win,
    CASE WHEN list_contains(w, '{NAME}') OR w[1] = '{UNIT}' THEN {TEMPLATE} WHEN len(list_filter(w, lambda x: starts_with(x, '<'))) > 0 THEN {BLIND} ELSE {RAW} END AS form FROM keys),
forms AS ({_FORMS % 'docs, sizes'}),
mine AS (SELECT key, n, pos, size, r, {RAW} AS form, array_to_string(r, ' ') AS win FROM forms
  UNION ALL SELECT key, n, pos, size, r, {BLIND}, array_to_string(b, ' ') FROM forms
  UNION ALL SELECT key, n, pos, size, r, {TEMPLATE}, array_to_string(t, ' ') FROM forms),
met AS (SELECT m.key AS doc_id, i.key AS item_id, m.pos - i.pos AS shift, m.pos, m.size, i.n, m.n AS n_doc,
    i.rich AND len(list_filter(i.slots, lambda s: s.b <> m.r[s.i])) = 0 AS same,
    list_transform(i.slots, lambda s: {{'q': m.pos + s.i, 'b': s.b, 'd': m.r[s.i]}}) AS pairs
  FROM mine m JOIN theirs i ON m.win = i.win AND m.size = i.size AND m.form = i.form),
one AS (SELECT * EXCLUDE (pairs), unnest(CASE WHEN len(pairs) = 0 THEN [NULL] ELSE pairs END) AS p FROM met),
voted AS (SELECT *, p.b AS b, p.d AS d, count(DISTINCT p.q) OVER (PARTITION BY doc_id, item_id, shift, p.b, p.d) AS votes FROM one),
topped AS (SELECT *, max(votes) OVER (PARTITION BY doc_id, item_id, shift, b) AS top FROM voted),
aligned AS (SELECT doc_id, item_id, shift, count(DISTINCT pos) AS n_windows, count(DISTINCT pos) - count(DISTINCT CASE WHEN d <> b AND votes < top THEN pos END) AS n_consistent,
    list_transform(list_sort(list(DISTINCT pos) FILTER (WHERE same)), lambda x, i: x - i) AS runs, count(DISTINCT b || chr(0) || d) AS n_slots,
    max(size) AS size, max(n) AS n, max(n_doc) AS n_doc, min(pos) AS lo, max(pos) + max(size) AS hi FROM topped GROUP BY doc_id, item_id, shift),
measured AS (SELECT *, n - size + 1 AS n_item,
    CASE WHEN len(runs) > 0 THEN list_max(list_transform(list_distinct(runs), lambda x: len(list_filter(runs, lambda y: y = x)))) + size - 1 ELSE 0 END AS n_verbatim FROM aligned),
judged AS (SELECT *, (n >= {SHORTEST} OR n_doc = n)
    AND (CASE WHEN n_item > {WINDOW} THEN n_consistent * 100 >= n_item * {SHARE} ELSE n_consistent = n_item END OR n_verbatim >= {RUN}) AS leaked FROM measured)
SELECT doc_id, item_id, n_windows::BIGINT AS n_windows, n_consistent::BIGINT AS n_consistent, n_item::BIGINT AS n_item, n_slots::BIGINT AS n_slots,
  n_verbatim::BIGINT AS n_verbatim, leaked, (lo - 1)::BIGINT AS first_word, (hi - 2)::BIGINT AS last_word FROM judged
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY leaked DESC, n_consistent DESC, n_windows DESC, lo, hi DESC, n_item DESC, n_slots DESC, n_verbatim DESC) = 1
"""
