"""Statistics against plain loops, the kernel, isotonic fits, and held-out accuracy."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa

from preflens.frames import ship
from preflens.llm import fourier


def test_statistics():
    texts = ["Ab cd ab.\nAb cd", None, "", "É É é#!", "x"]
    x = dict(zip(fourier.STATISTICS, fourier.statistics(pa.array(texts)).T, strict=True))
    assert np.allclose(np.expm1(x["log_words"]), [5, 0, 0, 3, 1])
    assert np.allclose(x["distinct"], [3 / 5, 0, 0, 2 / 3, 1]) and np.allclose(x["repeats"], [0, 0, 0, 1 / 2, 0])
    assert np.allclose(x["distinct_pairs"], [3 / 4, 0, 0, 1, 0]) and np.allclose(x["upper"], [2 / 15, 0, 0, 2 / 10, 0])
    assert np.allclose(x["symbols"], [0, 0, 0, 1 / 10, 0]) and np.allclose(x["longest"], np.log1p([3, 0, 0, 4, 1]))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 14))
    z = fourier.Model(np.zeros(14), np.ones(14), waves=20_000).features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 14))).max() < 0.05


def test_isotonic():
    values, ones, counts = np.arange(6.0), np.array([0, 2, 1, 1, 3, 4]), np.array([4, 4, 4, 2, 4, 4])
    x, y = fourier.isotonic(values, ones, counts)
    assert (np.diff(y) >= 0).all()
    assert np.allclose(np.interp([1, 2, 3], x, y), [3 / 8, 3 / 8, 0.5])


def test_held_out(spark, frame):
    ship(spark)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(10, 60))]
        if bad := rng.random() < 0.3:
            words = rng.choice([[w + "$$" for w in words], [w.upper() + "!!" for w in words], words[:1] * 30])
        rows.append((i, " ".join(words), not bad))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (3, None), (4, labels[4][1])]
    rows += [(700, None, None), (701, "", None), (None, "a b c d e", None), (702, (word() + " ") * 60_000, None), (5, rows[5][1], rows[5][2])]
    df = frame([(i, t, 0.5, "x", w) for i, t, w in rows], "doc_id long, text string, score double, x string, want boolean")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = fourier.held_out_quality(df, table).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    want = {i: w for i, _, w in rows}
    tested = [r for r in got if r["held_out"] and want[r["doc_id"]] is not None]
    assert all(crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in tested) and len(tested) > 80
    assert sum((r["predicted"] == 1) == want[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    kept = fourier.keep_good(df, table)
    assert kept.columns == df.columns and 350 < kept.count() < 500
    assert fourier.held_out_quality(df.limit(0), table).collect() == []
    assert {r["score"] for r in fourier.held_out_quality(df, table.limit(0)).collect()} == {0.5}
