"""Phrases against a plain count in Python; the query against its SQL is in test_llm.py."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from rillet.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, inside=100, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = tuple(x for x in re.split("[ \t]", piece) if x)
            n[lang] += len(w)
            counts.update((lang, w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {g: a for g, a in counts.items() if a >= least}
    out = []
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        around = [b for (other, v), b in frequent.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= inside * a for b in around):
            continue
        cuts = [(1000 * a * n[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, frequent[lang, w[:k]], frequent[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[-1], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return ranked


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("words", [phrases.WORDS, 50])
@pytest.mark.parametrize("inside", [100, 70])
def test_against_a_plain_count(spark, monkeypatch, words, inside):
    monkeypatch.setattr(phrases, "WORDS", words)
    rng = random.Random(words + inside)
    vocabulary = ["a", "B", "b", "ÄÖ", "äö", "über", "x" * 300, "日本", "-", "'", "1", " "]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", "\x0b", ";", " : "]) for _ in range(rng.randint(0, 40)))
    rows = [(make(), rng.choice(["en", "EN", "und", None])) for _ in range(150)] + [(None, "en"), ("", "fr"), (" .,\n", "fr"), ("new york city hall", "en")]
    rows += [("new york city hall", "en")] * 30 + [("b", "en"), ("a", "en")] * 20 + [("ha " * 400, "de")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = told(phrases.strongest(phrases.phrases(df, least=5), top=25, inside=inside))
    want = sorted(r for r in plainly(rows, 5, inside, 25))
    assert got == want and len(got) > 20


def test_texts_next_to_each_other_stay_apart():
    words, start, each = phrases.words_of(pa.array(["one Two", "", "three", ",", " four\tfive.Six ", "x"])[1:])
    assert [w.as_py().decode() for w in words] == ["three", "four", "five", "six", "x"]
    assert start.tolist() == [True, True, False, True, True] and each.tolist() == [0, 1, 0, 3, 1]


def test_large_counts_are_exact(spark):
    big = 300_000_000_000_000_000  # the products have 38 digits
    df = spark.createDataFrame([(big - 1, big, big - 3, big - 5), (100, big, 100, 101), (7, 9, 5, 3)], "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases._score(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in [(big - 1, big, big - 3, big - 5), (100, big, 100, 101), (7, 9, 5, 3)]]


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([("a b", "en", 1, 2, "x", 3)] * 6, "text string, lang string, block int, idx int, word string, a int")
    assert [r[2:] for r in told(phrases.strongest(phrases.phrases(df, least=6)))] == [("a b", 6, 6, 6, 12, 2000)]
    assert told(phrases.strongest(phrases.phrases(df.limit(0)))) == [] == told(phrases.strongest(phrases.phrases(df, least=7)))
