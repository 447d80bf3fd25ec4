"""Base scores and class scores against plain loops; the exchange raises the likelihood; held-out gain."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from preflens.frames import ship
from preflens.llm import classlm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def make_rows():
    rng = random.Random(9)
    pools = [[f"{a}{b}{e}" for a in "bcdfg" for b in "aeiou" for e in ("x", "xx")], [f"{a}{b}zé" for a in "klmnp" for b in "aeiou"]]
    rows = [(i, " ".join(rng.choice(pools[i % 2]) if rng.random() < 0.95 else f"rare{rng.randint(0, 10**6)}x" for _ in range(rng.randint(5, 60)))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, "NEVER Seen"), (None, "bax bax"), (903, "baX " * 50_000), (1, rows[1][1]), (904, ". ,. x")]


def test_token_rows():
    texts = ["Ab, ab", None, "", "é!"]
    (lo, hi, hashes, endings, row), = classlm.token_rows(pa.array(texts))
    assert (lo, hi) == (0, 4) and row.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert [h == classlm.END for h in hashes] == [False, False, True, True, True, False, True]
    assert endings[0] == endings[1] and hashes[0] != hashes[1]


def test_exchange():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 3, 60)
    counts = rng.poisson(np.array([[9, 1, 1], [1, 1, 9], [1, 9, 1]])[kind][:, kind]).astype(float)
    counts[7] = counts[:, 7] = 0
    classes = classlm.exchange(counts, 3, 20)
    start = np.arange(60) % 3
    assert classlm.likelihood(counts, classes, 3) > classlm.likelihood(counts, start, 3)
    used = np.arange(60) != 7
    assert all(len(set(kind[used & (classes == c)])) == 1 for c in range(3))
    best = classlm.likelihood(counts, classes, 3)
    for w in range(60):  # no single move does better
        for c in range(3):
            other = classes.copy()
            other[w] = c
            assert classlm.likelihood(counts, other, 3) <= best + 1e-6


@pytest.mark.parametrize("local", [1 << 17, 20])
def test_scores(spark, frame, monkeypatch, local):
    ship(spark)
    monkeypatch.setattr(classlm, "LOCAL_WORDS", local)
    monkeypatch.setattr(classlm, "ITEM_WORDS", 30)
    monkeypatch.setattr(classlm, "CLASSES", 6)
    rows = make_rows()
    df = frame([(i, t, 0.5, 4) for i, t in rows], "doc_id long, text string, score double, _row int", 3)
    held = lambda i: i is not None and crc32(str(i).encode()) % 10 == 0
    count = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(tokens(t)), sum(w in count for w in tokens(t)), total,
                    sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t))) for i, t in rows), key=repr)
    got = sorted(map(tuple, classlm.held_out_scores(df).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and g[6] < 0 for g, w in zip(got, want, strict=True))
    tested = [g for g in got if g[1] and g[2] > 3 and g[0] < 900]
    assert sum(g[6] for g in tested) > sum(g[5] for g in tested)  # a higher likelihood than the base, so less perplexity


def test_probabilities_sum_to_one(spark, frame):
    ship(spark)
    model, _ = classlm.train(frame(make_rows()))
    assert np.allclose((10**model.transition).sum(1), 1)
    assert classlm.held_out_scores(frame([])).collect() == []
    alone = [r for r in classlm.held_out_scores(frame([(i, "a b") for i in range(40) if crc32(str(i).encode()) % 10 == 0])).collect()]
    assert alone and all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in alone)


@pytest.mark.parametrize("local", [1 << 17, 12, 0])
def test_every_word_is_clustered(spark, frame, monkeypatch, local):
    """Words beyond the items move by their own neighbours, not by their ending; the class bigrams hold all tokens."""
    ship(spark)
    monkeypatch.setattr(classlm, "LOCAL_WORDS", local)
    monkeypatch.setattr(classlm, "ITEM_WORDS", 5)
    monkeypatch.setattr(classlm, "CLASSES", 7)
    rng, made = random.Random(4), {"q": [], "z": []}
    rows = []
    for i in range(300):  # the pattern "pa <any> ba" or "ka <any> ga"; the words in the middle are rare; some of the first kind end like the second
        side = "qz"[i % 2]
        made[side] += [f"{side}{i}-{j}{'xx' if side == 'q' and i % 20 else 'yy'}" for j in range(2)]
        rows.append((i, " ".join(f"{'pa' if side == 'q' else 'ka'} {w} {'ba' if side == 'q' else 'ga'}" for w in made[side][-2:] * 2 + rng.sample(made[side], 2))))
    model, rare = classlm.train(frame(rows))
    count = Counter(t for _, text in rows for t in tokens(text))
    known = {int(w): int(c) for w, c in zip(model.local, model.local_class)} | {r["word"] % 2**64: r["class"] for r in rare.collect()}
    assert len(known) == len(count) == model.distinct
    (_, _, hashes, _, _), = classlm.token_rows(pa.array([" ".join(made["q"] + made["z"])]))
    found = [known[int(h)] for h in hashes[:-1]]
    if local:
        assert len(set(found[:300])) == 1 and len(set(found[300:])) == 1 and found[0] != found[300]
    everything = classlm.class_bigrams(frame(rows), "text", model.local, model.local_class, rare, 7)
    cls = {w: known[int(classlm.token_rows(pa.array([w])).__next__()[2][0])] for w in count if w != "<end>"} | {"<end>": known[classlm.END]}
    want = np.zeros((7, 7))
    for _, text in rows:
        path = [cls[t] for t in ["<end>", *tokens(text)]]
        for a, b in zip(path, path[1:]):
            want[a, b] += 1
    assert np.array_equal(everything, want)
    scored = {r["doc_id"]: r["score"] for r in classlm.score(frame(rows[:20]), model, rare).collect()}
    spread = model.spread
    for i, text in rows[:20]:
        path = [cls[t] for t in ["<end>", *tokens(text)]]
        mine = sum(model.transition[a, b] - spread[b] + math.log10(count[t] + 0.1) for a, b, t in zip(path, path[1:], tokens(text)))
        assert math.isclose(mine, scored[i], rel_tol=1e-9)
