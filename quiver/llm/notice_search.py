"""Operator 7: license notices, exact and with a bounded number of edits.

Text is folded to its words (A-Z lower-cased; ASCII letters and digits and every
other character make words, the rest separates them) joined by one space. A notice of the catalogue may
differ by at most ``edits`` insertions, deletions or substitutions of characters.
By the pigeonhole principle, one of its ``edits + 1`` consecutive pieces then stands
unchanged in the text, so exact search for the pieces yields every place where a notice can begin: the word starts
within ``edits`` characters of where the piece puts it. From each of them the ``regex`` library's bounded-error matching decides,
once, on a window of the notice's length and the edits, so the work is linear in the text.
Of overlapping matches the one with the fewest edits is reported as a span of words (then the first, then the shortest).
Documents are independent: one pass, no shuffle, one Arrow batch in memory.

Defined results: a null text is an empty one; every row is scanned by itself, whatever its id, so repeated rows give
repeated results; long texts are scanned whole; an empty table gives no rows; no other column is read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.batches import bound_batches

# Phrase and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = PHRASES + (
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("dedicated to the public domain", "public-domain"),
)
EDIT_SHARE = 0.1  # edits allowed per character of a notice, rounded down

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SPAN = "array<struct<label:string,first:long,last:long,edits:int,score:double>>"


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int

    def pattern(self) -> str:
        """For the ``regex`` library: the best match within the edits that ends at a word's end."""
        phrase = re.sub(r"([^\w ])", r"\\\1", self.phrase)
        return rf"(?b)(?:{phrase}){{e<={self.edits}}}(?<! )(?![^ ])"

    def pieces(self) -> list[tuple[int, str]]:
        n, k = len(self.phrase), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def catalogue(notices=NOTICES, share: float = EDIT_SHARE) -> list[Notice]:
    return [Notice(p, label, int(len(p) * share)) for p, label in notices]


def folded(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_FOLD).split()).decode()


def _everywhere(text: str, piece: str):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def exact_places(text: str, phrase: str) -> list[int]:
    """Word positions at which the phrase's words stand in a folded text."""
    whole, wanted = f" {text} ", f" {phrase} "
    starts = list(_everywhere(whole, wanted))
    out, words, at = [], 0, 0
    for s in starts:
        words += whole.count(" ", at, s)
        at = s
        out.append(words)
    return out


def fuzzy_spans(text: str, notice: Notice, pattern) -> list[tuple[int, int, int]]:
    """``(start, end, edits)`` of the matches that none with fewer edits overlaps, in characters of a folded text, at word limits."""
    slack, n = notice.edits, len(notice.phrase)
    starts = set()
    for offset, piece in notice.pieces():
        for hit in _everywhere(text, piece):
            at = max(0, hit - offset - slack)
            at = 0 if not at else text.find(" ", at - 1) + 1 or len(text)
            while at <= hit - offset + slack and at < len(text):
                starts.add(at)
                at = text.find(" ", at) + 1 or len(text)
    found = []
    for at in starts:
        end = text.find(" ", min(len(text), at + n + slack))
        if m := pattern.match(text, at, len(text) if end < 0 else end):
            found.append((sum(m.fuzzy_counts), *m.span()))
    best: list[tuple[int, int, int]] = []
    for e, a, b in sorted(found):
        at = bisect_left(best, (a, b, e))
        if (at == 0 or best[at - 1][1] <= a) and (at == len(best) or best[at][0] >= b):
            best.insert(at, (a, b, e))
    return best


def notice_spans(docs: DataFrame, notices=NOTICES, share: float = EDIT_SHARE, phrases=PHRASES) -> DataFrame:
    """``(doc_id, n_words, exact, spans)`` of every row.

    ``exact``: ``(label, first word)`` of each exact place of ``phrases``; ``spans``: label, first
    and last word, edits and score (1 less edits per character) of each notice found.
    """

    def scan(batches):
        import regex

        wanted = [(n, regex.compile(n.pattern())) for n in catalogue(notices, share)]
        for batch in batches:
            n_words, exact, spans = [], [], []
            for raw in batch.column(1):
                text = folded(raw.as_py())
                n_words.append(text.count(" ") + 1 if text else 0)
                exact.append([{"label": label, "first": p} for phrase, label in phrases for p in exact_places(text, phrase)])
                rows = []
                for notice, pattern in wanted:
                    if any(piece in text for _, piece in notice.pieces()):
                        first = at = 0
                        for a, b, e in fuzzy_spans(text, notice, pattern):
                            first, at = first + text.count(" ", at, a), a
                            rows.append({"label": notice.label, "first": first, "last": first + text.count(" ", a, b), "edits": e,
                                         "score": 1 - e / len(notice.phrase)})
                spans.append(rows)
            place = pa.struct([("label", pa.string()), ("first", pa.int64())])
            span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(exact, pa.list_(place)), pa.array(spans, pa.list_(span))],
                ["doc_id", "n_words", "exact", "spans"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, n_words long, exact array<struct<label:string,first:long>>, spans {SPAN}")


def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: the base phrases' places and the labels of every notice found."""
    found = notice_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, more = F.col("exact.label"), F.col("spans.label")
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max("spans.score"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.first").alias("first_word"), F.array_max("exact.first").alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, more)).alias("labels"),
        F.when(F.size("exact") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["last"], s["edits"])).cast("string").alias("spans"),
    )
