"""The bit-sliced filter against sets of n-grams; accuracy on held-out texts."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa

from preflens.frames import ship
from preflens.llm import language

PARTS = {"en": "the ing and tion er th on", "de": "sch ung en ge ich über ß", "es": "ción los ado que ñ ar ez", "el": "και του ση μα νο δε"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_grams(text):
    found = []
    for size in language.SIZES:
        padded = [0] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 0 for c in text] + [0]
        for i in range(len(padded) - size + 1):
            g = padded[i:i + size]
            if all(g[1:-1]) and (g[0] or g[-1]):
                found.append((size, tuple(g)))
    return found


def test_grams_are_those_of_a_plain_loop():
    texts = ["Ab, cé", "", None, "x", "日本 語", "a1b", "ΑΒ  c"]
    found = {}
    for lo, hi, letters, parts in language.grams(pa.array(texts)):
        assert letters.tolist() == [sum(c.isalpha() for c in t or "") for t in texts[lo:hi]]
        for size, keys, row in parts:
            for k, r in zip(keys.tolist(), row.tolist()):
                found.setdefault((lo + r, size), []).append(k)
    for i, t in enumerate(texts):
        for size in language.SIZES:
            want = [g for s, g in plain_grams(t or "") if s == size]
            got = found.get((i, size), [])
            assert len(got) == len(want) and len(set(got)) == len(set(want))


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    member = {i: keys[i * 50:i * 50 + 500] for i in range(70)}
    f = language.BitmaskFilter([f"l{i}" for i in range(70)], member)
    assert all(f.hits(k, i).all() for i, k in member.items())
    assert f.false.max() < 0.02


def test_held_out(spark, frame):
    ship(spark)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lang = rng.choice(list(PARTS))
        rows.append((i, text(rng, lang, rng.choice([3, 10, 60])), lang if i % 11 else None, lang))
    rows += [(400, None, "en", "und"), (401, "", "en", "und"), (402, "12 !? 34", "en", "und"), (403, text(rng, "de", 9000), None, "de"), (404, "same", "en", None), (404, "same", "en", None), (None, "the and", "en", "en")]
    df = frame([(i, t, lang, 0.5, want) for i, t, lang, want in rows], "doc_id long, text string, lang string, score double, want string")
    got = language.held_out_languages(df).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[3] for r in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    judged = [r for r in got if want[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in judged) >= 0.98 * len(judged)
    assert all((r["lang_pred"] == "und") == (want[r["doc_id"]] == "und") and 0 <= r["score"] <= 1 for r in judged)
    assert language.held_out_languages(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.held_out_languages(df.withColumn("lang", df.lang.substr(99, 1).isNull().cast("string").substr(99, 0))).collect()} >= {"und"}
