"""What leaks() finds and clean() drops, and the query's SQL twin on planted names, arithmetic, capitals and look-alikes."""

import pytest

from quiver.llm import template_decontam as T
from tests.oracle_check import compare, duck


def run(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in T.leaks(spark, docs, bench).collect()}
    return found, {r.doc_id for r in T.clean(spark, docs, bench).collect()}


PROBLEM = ("A farmer sells his apples at the market for 2 pounds each and buys seed for 2 pounds a bag, then he walks home "
           "along the river and counts what is left in his purse before the evening meal with all of his family")


def test_one_changed_value_does_not_hide_a_passage(spark):
    two = PROBLEM.replace("for 2 pounds each", "for 4 pounds each").replace("for 2 pounds a", "for 3 pounds a")
    three = PROBLEM + " and 2 dogs that sleep there by the stove"
    found, kept = run(spark, [PROBLEM.replace("2 pounds a", "3 pounds a"), two, three.replace("2 pounds a", "3 pounds a")], [PROBLEM, three])
    for d, i in ((0, 0), (1, 0), (2, 1)):
        assert found[d, i].n_windows == found[d, i].n_item
    assert found[0, 0].n_consistent == found[0, 0].n_item and found[1, 0].n_consistent == found[1, 0].n_item
    assert found[2, 1].n_consistent == found[2, 1].n_item - 8  # the windows over the 3, which two unchanged values outvote
    assert kept == set()


def test_items_of_numbers_or_names_are_searched(spark):
    items = ["Compute 12 + 7 - 3 * (8 + 15) / 2 - 41 + 6 * 9.", "Present: Anna, Bruno, Clara, Dieter, Emil, Frida, Georg, Hanna, Ivan, Julia.", "17 + 25", "Tiny", "", None]
    texts = ["Now do this. " + items[0], "Now do this. Compute 13 + 7 - 4 * (8 + 16) / 2 - 40 + 6 * 8.", "At the table. " + items[1], "17 + 25", "a tiny word", "17 + 26"]
    found, kept = run(spark, texts, items)
    assert set(found) == {(0, 0), (2, 1), (3, 2), (4, 3)}
    assert all(r.n_windows == r.n_item for r in found.values())
    assert kept == {1, 4, 5}  # an item of three words or fewer must be the whole text


def test_verbatim_text_is_found_in_any_case_and_place(spark):
    item = "Yesterday the old Anna met young Bruno near big Hamburg where small Clara sold red Tulips to poor Dieter at home"
    ask, walk = "What is the capital city of France?", "Days went by and nobody came home"
    texts = [item, item.upper(), item.lower(), item.title(), "Geography\n" + ask, "- " + ask, "then we asked them " + ask, "THEN " + ask.upper(), "after 5 " + walk]
    found, kept = run(spark, texts, [item, ask, walk])
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2)}
    assert all(r.n_windows == r.n_consistent == r.n_item for r in found.values())
    assert kept == set()


def test_stock_phrases_do_not_drop_clean_documents(spark):
    one = "We know that the chemist Marie Curie was born in 1867 in Warsaw and later shared a prize with her husband"
    two = "The painter Clara Blau was born in Ulm. She moved in 1901 to Paris to study the colours of old glass windows there"
    texts = ["The physicist Albert Einstein was born in 1879 in Ulm and then left", "In short Emma Roth was born in Bonn. She moved in 1950 to Rome to study law",
             "Before. " + one, "We know that the chemist Lise Meitner was born in 1878 in Vienna and later shared a prize with her husband", "He said that " + " ".join((one + " " + two).split()[14:28])]
    found, kept = run(spark, texts, [one, two, one + " " + two + " " + PROBLEM])
    assert 0 < found[0, 0].n_consistent < found[0, 0].n_item / 2 and 0 < found[1, 1].n_consistent < found[1, 1].n_item / 2
    assert kept == {0, 1}
    assert found[4, 2].leaked and found[4, 2].n_consistent * 2 < found[4, 2].n_item  # a verbatim run of a long item


ASK = "What is the capital city of France?"
SUM = "Compute 12 + 7 - 3 * (8 + 15) / 2 - 41 + 6 * 9."
NAMES = "Present: Anna, Bruno, Clara, Dieter, Emil, Frida, Georg, Hanna, Ivan, Julia."
ITEMS = [PROBLEM, PROBLEM, PROBLEM + " and 2 dogs that sleep there by the stove", SUM, NAMES, ASK, "17 + 25", "Tiny", "", None, "The physicist was born in 1867 in Warsaw and later ran 5 km each day of 3 weeks"]


@pytest.mark.parametrize("broadcast", [T.BROADCAST_BYTES, 0])
def test_twin_on_planted_cases(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(T, "BROADCAST_BYTES", broadcast)
    values = [PROBLEM.replace("2 pounds a", "3 pounds a"), PROBLEM.replace("for 2 pounds each", "for 4 pounds each").replace("for 2 pounds a", "for 3 pounds a"), PROBLEM.upper(), PROBLEM.title()]
    texts = [*(t for t in ITEMS if t), *values, *(ITEMS[2].replace("2", n) for n in "378"), "So: " + SUM, SUM.replace("12", "13"), "At table. " + NAMES.upper(), NAMES.replace("Emil", "Otto"),
             "THEN " + ASK.upper(), "- " + ASK + " " + ASK, "17 + 26", "a tiny word", " ".join([PROBLEM] * 3), "The chemist was born in 1901 in Ulm and later ran 7 km each day of 9 weeks",
             "the physicist was born in 1867 in Warsaw and later ran", "5 km and 3 weeks, 5 km and 3 weeks", "", None, "été à Zürich " + PROBLEM]
    docs = [*enumerate(texts), (None, PROBLEM), (3, PROBLEM), (0, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (0, SUM), (None, NAMES)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = compare(spark, str(tmp_path), "op3", T.op3_template_decontam, T.ORACLE, duck(str(tmp_path)))
    assert got["status"] == "ok" and got["rows"] > 40
