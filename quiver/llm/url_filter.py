"""Operator 1: URL filters: rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions. Host and path each give their 3- and 4-character
n-grams (the host with its limits marked), hashed by md5 into ``BUCKETS`` buckets, with values count /
sqrt(n-grams). The model is trained on a small labelled URL table
(``LABELLED`` or any ``(url, blocked)`` DataFrame within ``MAX_LABELLED`` rows): the weights are a
combination of the training rows, so gradient descent with weight decay runs
on their Gram matrix, as one folded array expression; the weights (``BUCKETS`` + 1
numbers) come back as a literal. Scoring is a projection: no join, no shuffle,
one pass over ``url``.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no rule and gets the model's verdict on no n-grams; every row is judged by itself; no
other column is read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096  # three hex digits of md5
MAX_LABELLED = 2_000
MAX_RULES = 1_000  # rules are part of the projection
STEPS = 400
RATE = 2.0
DECAY = 0.0002
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host suffix with path prefix, and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A small labelled URL table, in natural order.
BLOCKED_URLS = """
http://cheap-pills.example.com/buy/now
http://www.best-pills-online.shop/order/cheap
https://discount-pharmacy.example.org/pills/12
http://viagra-cheap.example.com/en/44
http://free-bets.example.com/sport/7
https://www.free-casino-bets.win/bonus
http://m.betting-tips.example.org/free/spins
https://casino-jackpot.example.com/slots/9
http://poker-bonus.example.org/de/31
https://www.free-slots.example.com/en/8
http://spam-farm.example.org/en/100
http://www.link-farm.example.com/links/5
https://seo-spam.example.com/backlinks
https://content-farm.example.org/fr/310
http://ads-track.example.org/click?id=9
https://ads-server.example.com/banner/728
http://track-ads.example.com/pixel.gif
https://www.popup-ads.example.org/track/1
http://click-tracker.example.com/redirect/3
https://adult-cams.example.com/live/22
http://www.hot-singles.example.org/chat/4
https://xxx-videos.example.com/watch/6
http://free-porn.example.com/tube/7
https://payday-loans.example.com/apply/now
http://quick-cash-loans.example.org/en/3
https://crypto-doubler.example.com/invest/1
http://get-rich-fast.example.com/money/2
https://free-iphone-winner.example.com/claim
http://www.replica-watches.example.com/cheap/rolex
https://cracked-software.example.org/keygen/11
http://torrent-warez.example.com/download/8
https://free-followers.example.com/likes/5
""".split()
ALLOWED_URLS = """
https://www.example.com/en/1
http://blog.example.org/de/20
https://m.example.com/fr/300
https://news.example.com/en/2024/05/story
http://www.citynews.example.org/es/18
https://university.example.com/research/papers/7
http://library.example.org/catalogue/41
https://docs.example.com/guide/install.html
https://wiki.example.org/en/history_of_science
http://museum.example.com/exhibitions/12
https://www.weather.example.com/today
http://recipes.example.org/en/bread/5
https://travel.example.com/de/berlin/museums
http://forum.example.org/thread/812
https://health.example.com/en/nutrition/3
http://www.parliament.example.org/debates/9
https://school.example.com/en/maths/algebra
http://books.example.org/fr/roman/77
https://music.example.com/es/guitarra/2
http://garden.example.com/plants/roses
https://www.theatre.example.org/fr/144.html
http://m.hither.example.com/en/9
https://blog.thorend.example.org/es/533
http://nation.example.com/de/503#top
https://www.inthere.example.com/en/773
http://thesent.example.org/fr/10
https://blog.estion.example.com/en/676
http://www.eration.example.com/en/460?page=2
https://handen.example.org/en/233
http://m.onther.example.com/fr/825
https://repo.example.com/project/issues/14
http://maps.example.org/en/route/6
https://journal.example.com/article/1999/4
http://www.archive.example.org/en/1905
https://science.example.com/physics/quantum
http://sports.example.org/en/football/results
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def ngrams(tag: str, text: Column) -> Column:
    """Tagged 3- and 4-character n-grams."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    some = lambda n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.concat(F.lit(tag), F.array_join(F.slice(chars, i, n), "")))).otherwise(F.array().cast("array<string>"))
    return F.concat(some(3), some(4))


def buckets(host: Column, path: Column) -> Column:
    grams = F.concat(ngrams("h:", F.when(host == "", host).otherwise(F.concat(F.lit("^"), host, F.lit("$")))), ngrams("p:", path))
    return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 3), 16, 10).cast("int"))


def train(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    """``(bucket, weight)`` from ``labelled(url, blocked)``; bucket ``BUCKETS`` is the bias."""
    n = labelled.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; this trainer's Gram matrix takes {MAX_LABELLED}")
    rows = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("y"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("b", buckets(host, path))
    x = rows.select("url", "y", F.size("b").alias("n"), F.explode_outer("b").alias("bucket")).groupBy("url", "y", "n", "bucket").agg(F.count("bucket").alias("c"))
    x = x.where("bucket is not null").select("url", "y", "bucket", (F.col("c") / F.sqrt("n")).alias("x"))
    x = x.unionByName(rows.select("url", "y", F.lit(BUCKETS).alias("bucket"), F.lit(1.0).alias("x")))
    other = x.select(F.col("url").alias("url2"), "bucket", F.col("x").alias("x2"))
    gram = x.join(other, "bucket").groupBy("url", "y", "url2").agg(F.sum(F.col("x") * F.col("x2")).alias("k"))
    lines = gram.groupBy("url", "y").agg(F.array_sort(F.collect_list(F.struct("url2", "k"))).alias("line"))
    one = lines.agg(F.array_sort(F.collect_list(F.struct("url", "y", F.col("line.k").alias("k")))).alias("t"))
    size = F.size("t")
    dot = lambda k, a: F.aggregate(F.zip_with(k, a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    step = lambda a, _: F.transform("t", lambda r, i: F.get(a, i) * (1 - RATE * DECAY) + RATE / size * (r["y"] - 1 / (1 + F.exp(-dot(r["k"], a)))))
    alphas = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("t", lambda r: F.lit(0.0)), step)
    alphas = one.select(F.explode(F.arrays_zip(F.col("t.url").alias("url"), alphas.alias("alpha"))).alias("z")).select("z.url", "z.alpha")
    return x.join(alphas, "url").groupBy("bucket").agg(F.sum(F.col("alpha") * F.col("x")).alias("weight"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, True) for u in BLOCKED_URLS] + [(u, False) for u in ALLOWED_URLS], "url string, blocked boolean")


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        suffix, slash, rest = text.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judged_urls(spark: SparkSession, pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` plus ``host, path, rule, block_score, verdict``, which replace columns of these names; all others stay."""
    model = {r["bucket"]: r["weight"] for r in train(spark, labelled_urls(spark) if labelled is None else labelled).collect()}  # BUCKETS + 1 rows at most
    weights = F.from_json(F.lit(json.dumps([model.get(b, 0.0) for b in range(BUCKETS)])), "array<double>")
    host, path = host_and_path(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "block_score", "verdict")]
    out = pages.select(F.struct(*[pages[c] for c in own]).alias("row"), host.alias("host"), path.alias("path"))
    out = out.withColumn("url_b", buckets(F.col("host"), F.col("path")))
    total = F.aggregate("url_b", F.lit(0.0), lambda s, b: s + F.get(weights, b)) / F.sqrt(F.greatest(F.size("url_b"), F.lit(1)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("block_score", 1 / (1 + F.exp(-(total + F.lit(model.get(BUCKETS, 0.0))))))
    out = out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
    return out.select(*[F.col("row")[c].alias(c) for c in own], "host", "path", "rule", "block_score", "verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged_urls(spark, pages).select("page_id", "host", "path", "rule", "verdict")


def _twin() -> str:
    label_rows = ", ".join(f"('{u}', {y})" for some, y in ((BLOCKED_URLS, 1), (ALLOWED_URLS, 0)) for u in some)
    parts = """
  SELECT *, CASE WHEN pos > 0 THEN substr(u, pos + 3) ELSE '' END AS rest FROM (SELECT *, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS pos FROM {0})"""
    split = """
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), '{1}', '{2}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ({0})"""
    grams = """
  SELECT {1}, ('0x' || substr(md5(g), 1, 3))::INTEGER AS bucket FROM (
    SELECT {1}, unnest(list_concat(
      list_transform(range(1, len(h) - 1), lambda i: 'h:' || substr(h, i, 3)), list_transform(range(1, len(h) - 2), lambda i: 'h:' || substr(h, i, 4)),
      list_transform(range(1, len(path) - 1), lambda i: 'p:' || substr(path, i, 3)), list_transform(range(1, len(path) - 2), lambda i: 'p:' || substr(path, i, 4)))) AS g
    FROM (SELECT *, CASE WHEN host = '' THEN '' ELSE '^' || host || '$' END AS h FROM {0}))"""
    split_of = lambda t: split.format(parts.format(t), UPPER, LOWER)
    cases = "".join(
        f" WHEN (host = '{s}' OR ends_with(host, '.{s}')) AND starts_with(path, '{sl}{r}') THEN {{{k}}}"
        for k, (s, sl, r) in enumerate(t.partition("/") for t, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))))
    texts = [f"'{t}'" for t, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))]
    verdicts = [f"'{v}'" for _, v in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))]
    return f"""
WITH RECURSIVE lab AS ({split_of(f'(SELECT * FROM (VALUES {label_rows}) v(url, y))')}),
lx AS (SELECT url, y, bucket, count(*) / sqrt(sum(count(*)) OVER (PARTITION BY url)) AS x FROM ({grams.format('lab', 'url, y')}) GROUP BY url, y, bucket
  UNION ALL SELECT url, y, {BUCKETS}, 1.0 FROM lab),
gram AS (SELECT a.url, a.y, b.url AS url2, sum(a.x * b.x) AS k FROM lx a JOIN lx b USING (bucket) GROUP BY ALL),
one AS (SELECT list(url ORDER BY url) AS urls, list(y::DOUBLE ORDER BY url) AS ys, list(line ORDER BY url) AS k
  FROM (SELECT url, y, list(k ORDER BY url2) AS line FROM gram GROUP BY url, y)),
gd AS (SELECT 0 AS step, list_transform(ys, lambda v: 0.0::DOUBLE) AS a FROM one
  UNION ALL SELECT step + 1, list_transform(range(1, len(ys) + 1), lambda i: a[i] * {1 - RATE * DECAY} + {RATE} / len(ys) * (ys[i] - 1 / (1 + exp(-list_dot_product(k[i], a)))))
  FROM gd, one WHERE step < {STEPS}),
alpha AS (SELECT unnest(urls) AS url, unnest(a) AS alpha FROM gd, one WHERE step = {STEPS}),
w AS (SELECT bucket, sum(alpha * x) AS weight FROM lx JOIN alpha USING (url) GROUP BY bucket),
p AS (SELECT row_number() OVER () AS rid, * FROM ({split_of('(SELECT page_id, url FROM pages)')})),
scored AS (SELECT rid, sum(coalesce(weight, 0)) / sqrt(count(*)) AS s FROM ({grams.format('p', 'rid')}) g LEFT JOIN w USING (bucket) GROUP BY rid),
r AS (SELECT page_id, host, path, CASE{cases.format(*texts)} END AS rule, CASE{cases.format(*verdicts)} END AS v,
  coalesce(s, 0) + (SELECT weight FROM w WHERE bucket = {BUCKETS}) AS s FROM p LEFT JOIN scored USING (rid))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN s >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


ORACLE = _twin()
