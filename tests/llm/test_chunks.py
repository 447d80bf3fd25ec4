"""Boundaries resist insertions; repeated passages go, clean texts stay."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from preflens.frames import ship
from preflens.llm import chunks
from preflens.llm.words import text_bytes


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmné") for _ in range(rng.randint(2, 9))) for _ in range(n))


def spans(text):
    data, offsets = text_bytes(pa.array([text]))
    s, e, w, _ = chunks.chunk_spans(data, offsets)
    return [text.encode()[a:b] for a, b in zip(s, e, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n", max_size=200)), max_size=6))
def test_rows_do_not_see_each_other(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    s, e, w, cut = chunks.chunk_spans(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(s[x:y], e[x:y], strict=True)] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [spans(t or "") for t in texts]
    assert all(b" ".join(b" ".join(g).split()) == b" ".join((t or "").encode().split()) for g, t in zip(got, texts, strict=True))


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(words(random.Random(1), 40).encode(), np.uint8)
    h, want = 0, []
    for i, b in enumerate(data):
        h = sum(int(chunks._GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**64
        want.append(bool(chunks.mix(np.array([h], np.uint64))[0] < np.uint64(2**64 // chunks.MARK_EVERY)))
    assert chunks.gear_marks(data, np.array([0, len(data)])).tolist() == want


def test_insertion_changes_near_chunks_only():
    rng = random.Random(2)
    text = words(rng, 400)
    a, b = spans(text), spans(text[:900] + "inserted words here " + text[900:])
    assert len(set(a) - set(b)) <= 4


def test_passages(spark, frame):
    ship(spark)
    rng = random.Random(4)
    passages = [words(rng, 52) for _ in range(6)]
    rows, shared = [], {}
    for i in range(150):
        text = words(rng, rng.randint(30, 120))
        if i % 3 == 0:
            shared[i] = rng.randrange(6)
            text += "\n" + passages[shared[i]] + " " + words(rng, 40)
        rows.append((i, text))
    first = {p: min(i for i, q in shared.items() if q == p) for p in shared.values()}
    extra = [(500, None), (501, ""), (None, rows[1][1]), (None, rows[2][1]), (502, rows[4][1]), (503, words(rng, 30_000)), (7, rows[7][1]), (504, "the same short line. " + words(rng, 50)), (505, "the same short line. " + words(rng, 50))]
    df = frame([(i, t, 1, [2]) for i, t in rows + extra], "doc_id long, text string, idx int, removed_before array<int>", 3)
    out = chunks.dedupe(df)
    assert out.columns == [*df.columns, "removed"]
    got = out.collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text in rows:
        if i in shared and first[shared[i]] != i:
            assert by[i]["removed"] and len(by[i]["text"]) < len(text) - 150
            assert text.startswith(by[i]["text"][:20])
        else:
            assert by[i]["text"] == text and by[i]["removed"] == []
    assert by[500]["text"] is None and by[501]["text"] == "" and by[502]["text"].strip() == "" and by[503]["text"] == extra[5][1]
    assert all(by[i]["removed"] == [] for i in (504, 505))
    assert [r["text"] for r in got if r["doc_id"] is None] == ["", ""]
    assert chunks.dedupe(frame([])).collect() == []


def uncopied(rows, got, n=16):
    """Removed ranges of which some word is in no n-word window that occurs earlier, by brute force."""
    seen, bad = set(), []
    for (i, text), removed in zip(rows, got, strict=True):
        w = text.split()
        starts = np.cumsum([0] + [len(x.encode()) + 1 for x in w])
        again = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            again[k:k + n] |= tuple(w[k:k + n]) in seen
            seen.add(tuple(w[k:k + n]))
        for r in removed:
            a, b = np.searchsorted(starts, [r["start"], r["end"]])
            if not again[a:b].all():
                bad.append((i, a, b))
    return bad


def test_small_vocabulary_is_not_a_copy(spark, frame):
    """Chunks of few words all occur earlier somewhere; runs of them do not occur in one passage."""
    ship(spark)
    rng = random.Random(5)
    vocabulary = words(rng, 12).split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(400)]
    passage = rows[3][1].split()[50:120]
    rows.append((400, " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + " ".join(passage) + " " + rows[9][1][:20]))
    by = {r["doc_id"]: r["removed"] for r in chunks.dedupe(frame(rows)).collect()}
    got = [by[i] for i, _ in rows]
    assert uncopied(rows, got) == []
    assert not any(got[:400]) and sum(r["end"] - r["start"] for r in got[400]) > len(" ".join(passage)) / 2


def test_chunks_have_a_maximum_and_periods_go(spark, frame):
    """Periodic passages, and passages of 51 words without a mark in most of them, lose more than half in the later document."""
    ship(spark)
    rng = random.Random(6)

    def unmarked():
        while True:
            text = words(rng, 51)
            at = np.flatnonzero(chunks.gear_marks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))
            if not len(at) or len(text.encode()[:at[0]].split()) > 20:
                return text

    passages = [unmarked() for _ in range(6)] + [" ".join([words(rng, p)] * (120 // p)) for p in (1, 2, 3, 4, 5, 7, 9, 12, 13, 17, 24)]
    rows = []
    for k, p in enumerate(passages):
        rows += [(k, words(rng, 40) + " " + p + " " + words(rng, 40)), (100 + k, words(rng, 33) + " " + p + " " + words(rng, 40))]
        _, _, n, _ = chunks.chunk_spans(*text_bytes(pa.array([rows[-1][1]])))
        assert n.max() <= chunks.MOST_WORDS
    got = {r["doc_id"]: r["text"] for r in chunks.dedupe(frame(rows)).collect()}
    for k, p in enumerate(passages):
        gone = len(dict(rows)[100 + k].split()) - len(got[100 + k].split())
        assert gone > len(p.split()) / 2, (k, gone)
    assert all(got[k] == dict(rows)[k] for k in range(6))


def test_rows_without_id_and_clashing_columns(spark, frame):
    """Texts whose 32-bit hashes are equal are still two documents; no column of the table is lost or overwritten."""
    ship(spark)
    names = ["_id", "_h", "_copies", "_none", "_id2", "removed", "digest", "idx"]
    # Two texts with the same 32-bit hash, found by trying; their lengths differ.
    rng = random.Random(9)
    made = spark.range(200_000).selectExpr("id", "concat(repeat('ab cd ', 20 + cast(id % 40 as int)), hex(id * 7919)) as t").selectExpr("id", "t", "hash(t) as h")
    pair = made.groupBy("h").agg({"t": "collect_list"}).filter("size(`collect_list(t)`) > 1").first()
    same = list(pair[1])[:2] if pair else ["x y", "z"]
    passage = words(rng, 60)
    rows = [(None, same[0]), (None, same[1]), (1, words(rng, 30) + " " + passage), (2, words(rng, 30) + " " + passage), (None, words(rng, 20) + " " + passage)]
    df = frame([(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = chunks.dedupe(df)
    assert out.columns == [*df.columns, "removed_"]
    got = {r["_id"]: r for r in out.collect()}
    assert all(got[f"_id{k}"][n] == f"{n}{k}" for k in range(len(rows)) for n in names)
    assert got["_id2"]["text"] == rows[2][1] and got["_id2"]["removed_"] == []
    assert all(got[f"_id{k}"]["removed_"] and len(got[f"_id{k}"]["text"]) < len(rows[k][1]) - 150 for k in (3, 4))
