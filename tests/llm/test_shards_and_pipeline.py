import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.llm import fair_mix as M
from quiver.llm import rule_cascade as R
from quiver.llm import template_decontam as T
from quiver.llm import token_shards as S
from quiver.llm import url_filter as U


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 4096, 5000])
def test_feistel_is_a_keyed_permutation(n):
    f = S.Feistel(n, 5)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.sequence(slots) == np.arange(n)).all()
    assert n < 100 or (slots != S.Feistel(n, 6).slot(np.arange(n))).any()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab  \n\t\r'sZ1.é漢\x1c\xa0\u2003"), max_size=30))
def test_the_pattern_without_look_ahead_gives_the_same_ids(text):
    both = S.encodings(S.TOKENIZER)
    assert S.encode(both, text) == both[0].encode_ordinary(text)


def test_round_trip_and_resume(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame(odd_docs.select("doc_id", "text").collect(), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = S.write_shards(spark, docs, path, length=64, per_shard=10).collect()
    m = S.manifest(path)
    assert sorted(r.slot for r in rows) == list(range(m["sequences"]))
    slots = dict(S.read_slots(path))
    order = S.Feistel(m["sequences"], m["key"])
    stream = np.concatenate([slots[int(order.slot([i])[0])] for i in range(m["sequences"])])[: m["ids"]]
    enc = S.encodings(S.TOKENIZER)[0]
    ends = np.flatnonzero(stream == S.END_ID)
    texts = [enc.decode(stream[a:b].tolist()) for a, b in zip([0, *(ends + 1)], ends, strict=False)]
    assert sorted(texts) == sorted(r.text or "" for r in docs.collect())
    again = list(S.read_slots(path, m["sequences"] - 3))
    assert [s for s, _ in again] == list(range(m["sequences"] - 3, m["sequences"]))
    assert all((ids == slots[s]).all() for s, ids in again)
    second = S.write_shards(spark, docs, f"{tmp_path}/again", length=64, per_shard=10).collect()
    assert sorted((r.slot, r.sha256) for r in rows) == sorted((r.slot, r.sha256) for r in second)


def test_mix_targets_and_repeats(spark, odd_docs):
    sized = odd_docs.select("doc_id", "source", M.words_in().alias("size"))
    got = M.fair_mix(spark, sized)
    assert got.count() == odd_docs.count()
    again = M.fair_mix(spark, sized)
    key = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert key(got) == key(again)
    total = sum(r["size"] for r in got.collect())
    for r in got.groupBy("source").agg(F.first("source_size").alias("s"), F.sum("size").alias("own"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.max("size").alias("most"), F.max("copies").alias("c")).collect():
        assert r.s == r.own and r.c <= 2 and r.t <= 2 * r.s + 1e-9
        assert abs(r.taken - r.t) <= 20_000
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    mixed = M.mixed_documents(spark, odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]


def test_buckets_do_not_change_the_mix(spark, odd_docs, monkeypatch):
    sized = odd_docs.select("doc_id", "source", M.words_in().alias("size"))
    want = sorted(str(tuple(r)) for r in M.fair_mix(spark, sized).collect())
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    monkeypatch.setattr(M, "RUN_ROWS", 7)
    assert sorted(str(tuple(r)) for r in M.fair_mix(spark, sized).collect()) == want


def test_rule_order_does_not_change_verdicts(spark, odd_docs):
    order = [r for r, _, _ in R.measured_order(spark, odd_docs)]
    assert sorted(r.name for r in order) == sorted(r.name for r in R.RULES)
    verdict = lambda rules: sorted(str((r.doc_id, r.rejected_by is None)) for r in R.cascade(odd_docs, rules).collect())
    assert verdict(R.RULES) == verdict(R.RULES[::-1]) == verdict(order)


def test_leaks_with_other_slots_and_fallback_join(spark, odd_docs, odd_dir, monkeypatch):
    bench = spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    want = sorted(map(tuple, T.leaks(spark, odd_docs, bench).collect()))
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None}
    found = {(d, i) for d, i, *_ in want}
    by = lambda part: next(d for d, t in texts.items() if part in t)
    assert (by("Before it."), 0) in found and (by("Bruno had 17"), 1) in found and (by("x short one"), 6) in found and (by("LOUD "), 3) in found
    assert all(n_windows < 20 for d, i, n_windows, *_ in want if d == by("Not this"))
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, T.leaks(spark, odd_docs, bench).collect())) == want
    kept = T.clean(spark, odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id is null").count() == 3


def test_url_rules(spark):
    urls = {"http://a.net/": "net/", "http://x.example.net/en/1": "example.net/en/", "http://notorg/fr/": None, "http://org/fr/2": "org/fr/", "http://a.net": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert {r.url: r.rule for r in U.judged_urls(spark, pages).collect()} == urls


def test_pipeline(spark, odd_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    seen = []
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, odd_dir)
        assert after.columns == docs.columns, name
        seen.append(after.count())
        docs = after
    assert seen[1] < seen[0] and seen[2] < seen[1]
    out = P.run(spark, odd_dir)
    ids = {d for r in out.collect() for d in r.doc_ids}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
