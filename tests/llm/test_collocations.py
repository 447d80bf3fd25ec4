"""Dynamic itemset counting against plain counting."""

import random
import re
from collections import Counter

import pytest

from preflens.llm import collocations


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", text)) if w]


def plain(docs, low, longest=5, top=2000, percent=100):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= low:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            cand[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    dead = set()
    for (lang, p), (a, *_) in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= percent * cand[lang, p[i:i + m]][0]:
                    dead.add((lang, p[i:i + m]))
    out = []
    for lang in n:
        rows = [(-s, -a, " ".join(p).encode(), l, r) for (g, p), (a, l, r, s) in cand.items() if g == lang and (lang, p) not in dead]
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(rng):
    common = ["of", "the", "and", "Île", "x" * 50, "日本", "#"]
    phrases = ["new york city", "to be or not", "a b a b a", "one two three four five six"]
    docs = []
    for _ in range(150):
        words = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(common) + (str(rng.randint(0, 9)) if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 40))]
        docs.append(("".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", "!", " "]) for w in words), rng.choice(["en", "de", None, ""])))
    return docs


@pytest.mark.parametrize("shards,low,percent,bits", [(3, 10, 100, 1 << 27), (1, 5, 80, 1 << 27), (4, 25, 100, 1 << 15)])
def test_brute_force(spark, shards, low, percent, bits):
    docs = corpus(random.Random(shards))
    docs += [(None, "en"), ("", "en"), ("...", None), ("again and again " * 3000, "en"), ("Late late late. " * 30, "fr")]
    docs += [("same words in every row", "de")] * 60
    rows = [(t, g, 1, 2, 3) for t, g in docs]
    table = spark.createDataFrame(rows, "text string, lang string, n int, phrase int, shard int").repartition(4)
    got = collocations.mine(table, low, top=30, percent=percent, shards=shards)
    assert sorted(map(tuple, got.collect())) == plain(docs, low, top=30, percent=percent)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that lets everything through costs time only."""
    docs = corpus(random.Random(9))
    table = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "_filter_bits", lambda frequent, n_bits: _all_ones(frequent, n_bits))
    got = collocations.mine(table, 12, longest=4)
    assert sorted(map(tuple, got.collect())) == plain(docs, 12, longest=4)


def _all_ones(frequent, n_bits):
    import numpy as np

    return np.full(n_bits // 8, 255 if not frequent.isEmpty() else 0, np.uint8)


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_large_counts_stay_exact(spark):
    rows = [("en", 0, "", 10**13), ("en", 1, "a", 10**12), ("en", 1, "b", 10**12 - 1), ("en", 2, "a b", 10**12 - 1)]
    counts = spark.createDataFrame(rows, "lang string, length int, phrase string, n long")
    row = collocations.best_cuts(counts).first()
    assert row["score"] == 1000 * (10**12 - 1) * 10**13 // (10**12 * (10**12 - 1))
