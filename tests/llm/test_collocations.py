"""Collocations against a plain version: nulls, long texts, ties, repeated rows, clashing columns, forced collisions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import collocations

SCHEMA = "doc_id long, text string, lang string, key string, print int, phrase string, words string, n string"


def phrase_counts(rows, longest):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            mine = counts["und" if lang is None else lang]
            mine[()] += len(w)
            for m in range(1, longest + 1):
                mine.update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    return counts


def plain(rows, longest, least, top):
    out = []
    for lang, f in phrase_counts(rows, longest).items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and b >= a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in often.items())
            if not inside:
                score, k = min((1000 * a * f[()] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, f[()], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcAé") for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(n))

    fixed = "New York city hall stands here"
    out = [(rng.choice(["en", "en", "fr", None, ""]), prose(rng.randint(1, 80)) + fixed + rng.choice([" ", "!"]) + prose(9)) for _ in range(60)]
    out += [("en", None), (None, None), ("fr", ""), ("fr", " .,;\t"), ("en", "x" * 5000), ("en", prose(20_000)), ("fr", fixed.upper())]
    return out + [out[3]] * 25


def test_against_plain_counts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(k, t, lang, "k", 1, "p", "w", "n") for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(6)
    for longest, least, top in ((5, 4, 2000), (3, 2, 7), (2, 30, 50)):
        got = sorted(map(tuple, collocations.collocations(df, longest=longest, least=least, top=top).collect()))
        assert got == plain(rows, longest, least, top) and got


def test_empty_tables_and_texts(spark):
    for data in ([], [(None, None, None, None, None, None, None, None)], [(1, "a b", "en", None, None, None, None, None)]):
        assert collocations.collocations(spark.createDataFrame(data, SCHEMA)).collect() == []


def test_long_texts_are_cut_between_pieces():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "c", "déf"]) + rng.choice([" ", " ", ". "]) for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["en", "en"]), pa.array([text, "ab c"])], ["key", "lang", "text"])
    for size in (1 << 20, 64, 1):
        prints, places = [], []
        for part in collocations.slices(batch, size):
            for words in (1, 2, 3):
                found, rows, at = collocations._pointers(part, np.flatnonzero(part.left >= words), words)
                prints += found.tolist()
                places += list(zip(rows.tolist(), at.tolist(), strict=True))
        if size == 1 << 20:
            want = sorted(zip(prints, places, strict=True))
        assert sorted(zip(prints, places, strict=True)) == want


class Fake:
    """A table in which every fingerprint has one text."""

    def __init__(self, phrase: str):
        self.value, self.phrase = self, np.frombuffer(phrase.encode(), np.uint8)

    def texts(self, prints):
        return np.ones(len(prints), bool), np.tile(self.phrase, len(prints)), np.arange(len(prints) + 1) * len(self.phrase)


def test_colliding_texts_are_told_apart():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["en", "fr"]), pa.array(["one two, one", "two one"])], ["key", "lang", "text"])
    found = Counter((r["lang"], r["phrase"]) for b in collocations._differing(Fake("one"), 2)(iter([batch])) for r in b.to_pylist())
    assert found == {("en", "two"): 1, ("en", "one two"): 1, ("fr", "two"): 1, ("fr", "two one"): 1}
    assert not list(collocations._differing(Fake("one"), 1)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array(["One one; ONE"])], ["key", "lang", "text"])])))


def test_scores_are_exact(spark):
    """Scores use exact whole numbers beyond 64 bits."""
    big = 4_000_000_000_000_003
    rows = [("en", "", 0, big * 2), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    got = collocations.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, words long, n long")).collect()
    assert [r.score for r in got] == [1000 * (big - 2) * big * 2 // (big * (big - 1))]
