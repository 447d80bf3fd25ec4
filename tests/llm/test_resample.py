"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest

from preflens.llm import resample


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, target, percent=25, min_words=20, longest=2, buckets=10_000, seed=7):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    def counts(texts):
        n = [0] * buckets
        for t in texts:
            for f in features(t)[0]:
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = counts(x for _, x in docs), counts(target)
    size = [float(sum(x) + buckets) for x in (s, t)]
    gain = [math.floor(1000 * math.log(float(b + 1) * size[0] / (float(a + 1) * size[1]))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        f, words = features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    out = [(*r[:4], None) for r in rows]
    for k, r in enumerate(drawn, 1):
        out.remove((*r[:4], None))
        out.append((*r[:4], k))
    return sorted(out, key=repr)


def texts(rng, n):
    word = lambda: "".join(rng.choice("abéßñ日7") for _ in range(rng.randint(1, 3)))
    return [rng.choice([" ", "-", "_ {"]).join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_brute_force(spark, longest):
    rng = random.Random(longest)
    docs = list(enumerate(texts(rng, 80)))
    docs += [(200, None), (201, ""), (202, "... \x7f\t{"), (203, "a b " * 40_000), (None, docs[1][1]), (None, "c d " * 30), (None, "e f " * 30)]
    docs += docs[:5] + [(300 + k, "x y z " * 10) for k in range(20)]
    target = texts(rng, 10) + [None, ""]
    table = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], "doc_id long, text string, score int, id int, rank int").repartition(3)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r)[:5] for r in resample.resample(table, goal, longest=longest, percent=40).collect()]
    assert sorted(got, key=repr) == plain(docs, target, 40, longest=longest)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty).collect() == []
    some = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    assert sorted(r["weight"] for r in resample.resample(some, empty, percent=100).collect()) == sorted(r[2] for r in plain([(1, "a " * 30), (2, "b")], []))


def test_batches_of_long_texts(spark, monkeypatch):
    """Slices within a batch change nothing."""
    import pyarrow as pa

    column = pa.array(["a b c", None, "", "b c " * 5, "é é é"])
    whole = [x for _, found in resample.ngram_buckets(column, 2, 97) for x in found.tolist()]
    parts = [x for i in range(len(column)) for _, found in resample.ngram_buckets(column.slice(i, 1), 2, 97) for x in found.tolist()]
    assert sorted(whole) == sorted(parts)
