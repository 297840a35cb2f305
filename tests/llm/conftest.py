"""An odd little corpus: near and exact copies, shared passages, leaks, notices, empty and long texts."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LETTERS = "abcdefghijklmnoprstuvwxyzäéñ"


def words_of(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(900)]
    passage = words_of(rng, 70, vocabulary)
    items = [" ".join(words_of(rng, 12, vocabulary)) + f" Anna had {k + 3} apples and {k + 5} km to go, Anna said." for k in range(6)]
    items += ["short one of five words", "Tiny", "", None]
    texts = []
    for k in range(40):
        w = words_of(rng, rng.randint(25, 260), vocabulary)
        if k % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.randint(45, 70)]
        texts.append(" ".join(w[: len(w) // 2]).capitalize() + ".\n" + " ".join(w[len(w) // 2 :]))
    for k in range(0, 40, 3):  # near copies: a few words changed, moved case, other spaces
        w = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append("  ".join(w).upper() if k % 2 else "\t".join(w))
    texts += [texts[1], texts[1], texts[2] + " ", "\n" + texts[3]]
    texts += ["", " \t\n", "one", "one two", "ONE two", "one two three", "a b c", None]
    texts.append("Before it. " + items[0] + " After it all.")
    texts.append("Well then " + items[1].replace("Anna", "Bruno").replace("4 apples", "17 apples").replace("6 km", "29 km") + " And more")
    texts.append("Not this " + items[2].replace("Anna had", "Bruno had") + " slots disagree")
    texts.append("x " + items[6] + " y")
    texts.append("LOUD " + items[3].upper())
    texts += ["Released under the MIT License.", "Licensed under the Apache-License, Version 2.0; and CC BY-NC 4.0, cc by nc cc by nc",
              "Relaesed under the MIT Licence today", "licensed under the GNU Genral Public Licence, version 3 or later", "under  the\nmit license 日本 under the mit licenses"]
    texts.append("same line here again\n" * 30 + "!!! ### " * 20)
    texts.append(" ".join(["loop"] * 400))
    texts.append(" ".join(words_of(rng, 20_000, vocabulary)))
    return texts, items


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    """A data folder in the driver's layout, with an extra column in each table."""
    texts, items = corpus()
    base = tmp_path_factory.mktemp("odd")
    n = len(texts)
    ids = pa.array(range(n), pa.int64())
    langs = ["en", "de", None]
    tables = {
        "documents": {"doc_id": ids, "text": texts, "lang": [langs[i % 3] for i in range(n)],
                      "source": ["hot" if i % 3 else [None, "a", "é", "z"][i // 3 % 4] for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
                      "m_text": ["clash"] * n, "size": ["clash"] * n, "component_id": ["clash"] * n},
        "benchmark": {"item_id": pa.array(range(len(items)), pa.int64()), "text": items, "words": ["clash"] * len(items)},
        "labels": {"doc_id": pa.array([*range(n), 10**9], pa.int64()), "quality": pa.array([None if i % 7 == 0 else int(i % 4 > 0) for i in range(n + 1)], pa.int32()),
                   "toxic": pa.array([0] * (n + 1), pa.int32())},
        "pages": {"page_id": pa.array(range(14), pa.int64()),
                  "url": [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?q#f", "x://a://b/c", "http://example.net", "https://m.example.com/de/1", "http://notexample.com/de/1",
                          "http://a.b.org/fr/", "http://casino.example.com/free/bets" + "x" * 5000, "http://Ünï.example.com/ä/ö", "http://a.org?x=/fr/", "http://a.org/fr/#x"],
                  "html": ["<p>"] * 14, "host": ["clash"] * 14},
        "conversations": {"conv_id": pa.array([1] * 150 + [2, 2, 2, 2, 3, 4, 4, 5], pa.int64()), "turn": pa.array([*range(150), 0, 1, 1, None, 0, 0, 0, 0], pa.int64()),
                          "role": ["user" if i % 2 else "bob by" for i in range(150)] + ["system", "user", "user", "assistant", "system", None, "user", "user"],
                          "text": [f"turn {i} <|im_end|>" for i in range(150)] + ["be kind", "hi", "hi", "first", "alone", None, "", "same"], "chunk": ["clash"] * 158},
    }
    vectors = [[(i * 7 % 11) / 11, (i * 5 % 13) / 13, i / 30] for i in range(30)] + [None, [], [None, 1.0, 1.0], [float("nan"), 1.0, 1.0], [1.0, 2.0]]
    tables["embeddings"] = {"vec_id": pa.array([*range(34), None], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())),
                            "label": pa.array([0] * 35, pa.int32()), "component": ["clash"] * 35}
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), base / f"{name}.parquet")
    return str(base)


@pytest.fixture(scope="session")
def odd_docs(spark, odd_dir):
    """The odd documents plus repeated rows, null ids and one id with two texts."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    more = spark.createDataFrame(
        [(1, None), (1, None), (None, "one two three four five"), (None, "one two three four five"), (None, None), (0, "other text under an id that is taken")], "doc_id long, text string")
    again = docs.where("doc_id in (0, 1, 2, 40)")
    return docs.unionByName(again).unionByName(more, allowMissingColumns=True)
