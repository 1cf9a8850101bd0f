"""Phrase collocations against a plain count; the perfect hash by itself."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from echograph.llm import phrases

SCHEMA = "text string, lang string"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        longer = [b for (g, v), b in cands.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, cut = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]], n[lang]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return rows


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made(seed, n=150):
    rng = random.Random(seed)
    stock = ["new", "York", "city", "the", "of", "é", "ÉA", "a\x0bb", "x" * 40, "wi\x1cre", "ß", "New", "hall", " "]
    rows = [(" ".join(rng.choice(stock) + rng.choice(["", "", "", ".", ",", "\n", "\t", "?!", "\x0c"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [("new york city hall " * 30, "en"), (None, "en"), ("", None), (" \t", "fr"), ("...", "fr"), ("der der der der der der", "de")] + [("in the end of the day", "en")] * 12


@pytest.mark.parametrize(("block", "window", "held", "piece"), [(1 << 21, 4 << 20, 1 << 20, 1 << 16), (40, 16, 7, 8)])
def test_phrases_as_a_plain_count_has_them(spark, monkeypatch, block, window, held, piece):
    for name, value in (("BLOCK", block), ("WINDOW", window), ("HELD", held), ("PIECE", piece), ("BRANCH", 2)):
        monkeypatch.setattr(phrases, name, value)
    rows = made(2, 150 if block > 40 else 25)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(phrases.collocations(spark, df, least=6, top=30)) == plain(rows, 6, 30)


def test_clashing_columns_and_no_phrase_at_all(spark):
    rows = [("one two three", "en", "a", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", phrase string, n int, one int")
    assert found(phrases.collocations(spark, df, least=2)) == []
    assert found(phrases.collocations(spark, df, least=1)) == plain([rows[0][:2]], 1, 2000)


def test_empty_table(spark):
    assert found(phrases.collocations(spark, spark.createDataFrame([], SCHEMA))) == []


def test_scores_beyond_64_bits(spark):
    big = 10**15
    read = spark.createDataFrame([("en", "a b", [big, big + 1, big + 2, 0, 0, 0, 0])], "lang string, phrase string, parts array<long>")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert phrases._ranked(read, totals, 5).first()["score"] == 2000000 * big // (2 * big + 3)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    one, two = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
    one[: n // 4] = 7  # first halves that collide
    mph = phrases.PerfectHash(one[:n], two[:n], np.zeros(n, np.int64))
    assert sorted(mph.slots(one[:n], two[:n]).tolist()) == list(range(n))
    assert (mph.slots(one[n:], two[n:]) == -1).all()
