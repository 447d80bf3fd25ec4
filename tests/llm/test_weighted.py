"""Collision rate against generalised Jaccard; neighbours and edits against a plain loop."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from preflens.frames import ship
from preflens.llm import weighted
from preflens.llm.words import text_bytes


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    for share in (0.1, 0.5, 0.9):
        a = [rng.choice(words) for _ in range(150)]
        b = [w if rng.random() < share else "x" + rng.choice(words) for w in a]
        data, offsets = text_bytes(pa.array([" ".join(a), " ".join(b)]))
        row, term, weight = weighted.weighted_terms(data, offsets)
        ca, cb = (Counter(dict(zip(term[row == i].tolist(), weight[row == i].tolist()))) for i in (0, 1))
        want = sum((ca & cb).values()) / sum((ca | cb).values())
        weighted.parameters.cache_clear()
        got = []
        for seed in range(6):
            tables = weighted.parameters.__wrapped__(weighted.SAMPLES, seed)
            with pytest.MonkeyPatch.context() as m:
                m.setattr(weighted, "parameters", lambda s, t=tables: t)
                s = weighted.signatures(data, offsets)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - want) < 0.08, (want, got)


def test_equal_texts_and_slices():
    texts = ["a b c", "", "c B a", "a b c", "x " * 70_000 + "y " + " ".join(f"v{i}" for i in range(40_000))]
    s = weighted.sign(texts)
    assert (s[0] == s[3]).all() and (s[0] == s[2]).all() and not s[1].any()
    assert (weighted.sign(texts[4:])[0] == s[4]).all()


def test_edits(spark, frame):
    ship(spark)
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choice("abcdé") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (None, "last"), (1002, "é" * 100_001), (7, "once more"), (8, "once more")]
    df = frame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, _id int", 4)
    texts = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)]
    want = {}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        s = weighted.sign([t, edited, after])
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *weighted.as_text(s[:2]), (s[0] == s[1]).mean(), (s[0] == s[2]).mean())
    for buckets in (None, 7):
        got = weighted.compare_with_edits(df, buckets=buckets).collect()
        assert len(got) == len(rows) and {r[0]: tuple(r)[1:] for r in got} == want
    prints = {r[0]: r[1] for r in weighted.fingerprint(df).collect()}
    assert all(prints[i] == w[2] for i, w in want.items())
    assert weighted.compare_with_edits(df.limit(0)).collect() == []
    one = weighted.compare_with_edits(frame([(5, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    twice = weighted.compare_with_edits(frame([(5, "abcd"), (5, "abcd"), (6, "zz")])).collect()
    assert len(twice) == 3


def test_collision_rate_of_long_texts():
    """Against the similarity of the real words: 120,000 distinct words, 0.5 in common."""
    a, b = ([f"word{i}" for i in range(lo, lo + 90_000)] for lo in (0, 30_000))
    data, offsets = text_bytes(pa.array([" ".join(a), " ".join(b)]))
    want = len({*a} & {*b}) / len({*a} | {*b})
    got = []
    for seed in range(6):
        functions = weighted.parameters.__wrapped__(weighted.SAMPLES, seed)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(weighted, "parameters", lambda s, f=functions: f)
            s = weighted.signatures(data, offsets)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.08, (want, got)


def test_null_and_repeated_ids_are_parted(spark, frame):
    ship(spark)
    rng = random.Random(5)
    rows = [(rng.choice([None, 7, -(1 << 62), (1 << 60) + i]), f"{i} " + " ".join(rng.choice("abcd") for _ in range(9))) for i in range(600)]
    df = frame(rows)
    sizes = Counter(r["_bucket"] for r in weighted.with_neighbours(df, "doc_id", "text", 20).filter("not _guest").collect())
    assert sum(sizes.values()) == 600 and max(sizes.values()) < 90
    texts = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    texts.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), reverse=True)
    want = []
    for r, after in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(r["text"]) // 2
        edited = r["text"][:len(r["text"]) - half] + after["text"][:half]
        want.append((repr(r["doc_id"]), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(repr(r[0]), r["edited_sha256"]) for r in weighted.compare_with_edits(df, buckets=20).collect()]
    assert sorted(got) == sorted(want)
