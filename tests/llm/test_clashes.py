"""Extra columns named like the operators' own ones: kept, and of no effect."""

from pyspark.sql import functions as F

from quiver.llm import fair_mix as M
from quiver.llm import rule_cascade as R
from quiver.llm import url_filter as U

plain = lambda d, columns: sorted(map(str, d.select(*columns).collect()))


def test_url_filter(spark, odd_dir):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet").select("page_id", "url")
    odd = pages.withColumns({c: F.lit("clash") for c in ("url_b", "row", "verdict", "weight", "bucket")})
    got, columns = U.judged_urls(spark, odd), ["page_id", "url", "host", "path", "rule", "verdict"]
    assert plain(got, columns) == plain(U.judged_urls(spark, pages), columns)
    assert got.where("url_b = 'clash' and row = 'clash' and weight = 'clash' and bucket = 'clash'").count() == pages.count()


def test_rule_cascade(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    odd = docs.withColumns({c: F.lit("clash") for c in ("m_text", "m_row", "m_n_words", "m_by", "n_words", "rejected_by")})
    got, columns = R.cascade(odd, R.RULES, ("n_words",)), ["doc_id", "text", "n_words", "rejected_by"]
    assert plain(got, columns) == plain(R.cascade(docs, R.RULES, ("n_words",)), columns)
    assert got.where("m_text = 'clash' and m_row = 'clash' and m_n_words = 'clash' and m_by = 'clash'").count() == docs.count()


def test_fair_mix(spark, odd_docs):
    sized = odd_docs.select("doc_id", "source", M.words_in().alias("size"))
    odd = sized.withColumns({c: F.lit("clash") for c in ("weight", "target", "inside", "ahead", "mix_row", "mix_key", "copies", "row", "rank")})
    got, columns = M.fair_mix(spark, odd), ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    assert plain(got, columns) == plain(M.fair_mix(spark, sized), columns)
    assert got.where("weight = 'clash' and inside = 'clash' and ahead = 'clash' and mix_row = 'clash' and mix_key = 'clash'").count() == sized.count()
