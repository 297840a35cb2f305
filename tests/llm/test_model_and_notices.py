import itertools
import time

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.llm import notice_search as N
from quiver.llm import quality_model as Q
from quiver.llm import textkernel as K


def test_pooled_is_monotone_and_exact_on_sorted_means():
    x, y = Q.pooled(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(y) > 0).all() and np.allclose(y, [0, 0.5, 2 / 3])
    assert np.allclose(x, [0, 1.5, 4])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op2_quality_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, right, kept = got.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert n > 500 and right > 0.97 and kept > 0.98


def test_scores_of_odd_rows(spark, odd_docs, odd_dir):
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet")
    got = Q.quality_scores(spark, odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = Q.quality_scores(spark, odd_docs, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    again = Q.quality_scores(spark, odd_docs, labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Q.accepted(spark, odd_docs, labels).columns == odd_docs.columns


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "A b.\nA b.\n", "x" * 3000, "é é é é", "a b c a b c", " "]
    raw = [t.encode() for t in texts]
    together = Q.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, r in enumerate(raw):
        assert np.allclose(Q.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)])), together[i])


def test_word_hashes_are_those_of_the_words():
    texts = ["Ab c\tAB", "ab", "", "x\x0by\x1cz " + "long" * 700_000 + " c"]
    raw = [t.encode() for t in texts]
    buffer, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, first = K.word_spans(buffer, offsets)
    words = [w for r in raw for w in r.split()]
    assert [buffer[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == words
    assert first.tolist() == np.cumsum([0, *(len(r.split()) for r in raw)]).tolist()
    by = {}
    for w, h in zip(words, K.word_hashes(buffer, starts, ends).tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    low = K.word_hashes(buffer, starts, ends, lower=True)
    assert low[0] == low[2] == low[3]


def brute_places(text, phrase):
    w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    p = phrase.split()
    return len(w), [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_base_places_and_spans(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = N.notice_spans(odd_docs).collect()
    want = sorted(str((r.doc_id, brute_places(r.text, "")[0], sorted((label, p) for phrase, label in N.PHRASES for p in brute_places(r.text, phrase)[1]))) for r in rows)
    assert sorted(str((r.doc_id, r.n_words, sorted((e.label, e.first) for e in r.exact))) for r in got) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_spans(words, notice):
    """Edits of every run of words within a notice's edits, by (first, end)."""
    n = len(notice.phrase.split())
    runs = ((i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + n + notice.edits) + 1))
    runs = ((i, j) for i, j in runs if abs(len(" ".join(words[i:j])) - len(notice.phrase)) <= notice.edits)
    return {(i, j): e for i, j in runs if (e := edits(" ".join(words[i:j]), notice.phrase)) <= notice.edits}


def check_spans(text, notice):
    near = near_spans(text.split(), notice)
    spans = N.fuzzy_spans(text, notice, regex.compile(notice.pattern()))
    got = {(text.count(" ", 0, a), text.count(" ", 0, b) + 1): e for a, b, e in spans}
    assert len(got) == len(spans) and got.items() <= near.items()
    for (i, j), e in near.items():  # each is reported, or something with as few edits that overlaps it
        assert any(x < j and y > i and k <= e for (x, y), k in got.items()), (text, notice, i, j)
    return got


def test_fuzzy_spans_against_all_word_spans():
    texts = ["relaesed under the mit licence today", "licensed under the gnu genral public licence version 3 or later", "redistribution and usage in source or binary forms",
             "in the public domain dedicated to thee public domains", "nothing of the sort here", "", "a", "under", "the mit license", "license license license"]
    exact, near, bad = "under the mit license", "under teh mit license", "undr the mti license"
    texts += [" ".join(p) for n in (1, 2, 3) for p in itertools.product((exact, near, bad, "x"), repeat=n)]
    texts += ["un" + exact, exact + "s", "xx " + exact + "x under the", exact.replace(" ", " the "), "cc by nc cc by nc by nc"]
    for text in texts:
        for notice in N.catalogue():
            check_spans(text, notice)
    mit = N.catalogue()[0]
    assert set(check_spans(f"{near} {exact}", mit).values()) == {0, 2}
    assert len(check_spans(f"{bad[:-1]}e {near} {exact} {near}", mit)) >= 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("under the teh mit mi t license licenses lic ense cc by nc x".split()), max_size=14))
def test_fuzzy_spans_of_jumbled_words(words):
    for notice in N.catalogue()[:4]:
        check_spans(" ".join(words), notice)


def test_a_long_text_takes_time_in_proportion():
    mit = N.catalogue()[0]
    pattern, took = regex.compile(mit.pattern()), []
    for n in (2_000, 16_000):
        text = " ".join(["under teh mit license"] * n)
        began = time.process_time()
        spans = N.fuzzy_spans(text, mit, pattern)
        took.append(time.process_time() - began)
        assert len(spans) == n and {e for *_, e in spans} == {2}
    assert took[1] < 25 * took[0]


def test_the_query_against_brute_force(spark, odd_dir):
    rows = {r.doc_id: r for r in N.op7_license_notices(spark, odd_dir).collect()}
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        base = sorted((p, label) for phrase, label in N.PHRASES for p in brute_places(text, phrase)[1])
        r = rows[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        if len(words) > 20 and not any(w in words for w in ("license", "licence", "public", "redistribution")):
            assert (r.labels, r.score) == ("", 0.0)
            continue
        near = [(notice, e) for notice in N.catalogue() for e in near_spans(words, notice).values()]
        assert r.labels == ",".join(sorted({label for _, label in base} | {n.label for n, _ in near}))
        assert r.score == pytest.approx(1.0 if base else max((1 - e / len(n.phrase) for n, e in near), default=0.0))
    assert {"", "mit", "gpl-3"} <= {r.labels for r in rows.values() if r.n_base == 0}
