"""Sets, trie and components against brute force."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from preflens.frames import ship
from preflens.llm import jaccard


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=12), min_size=1, max_size=9), st.sampled_from([50, 80, 90]))
def test_trie_finds_all_partners(sets, percent):
    sets = [s for s in sets if s] or [{1}]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = jaccard.Trie(arrays)
    for x, a in zip(sets, arrays, strict=True):
        want = [j for j, y in enumerate(sets) if 100 * len(x & y) >= percent * len(x | y)]
        assert sorted(trie.partners(a, percent)) == want


def test_marks_never_rule_out_a_link(spark):
    """Marks bound the overlap of prefixes; bit tables lose no number."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = rng.choice(2**40, rng.integers(20, 400), replace=False).astype(np.uint64)
        other = np.where(rng.random(len(base)) < rng.choice([0.0, 0.03, 0.1]), rng.integers(0, 2**40, len(base), dtype=np.uint64), base)
        a, b = np.unique(base), np.unique(other)
        both, marks = len(np.intersect1d(a, b)), []
        for x in (a, b):
            p = x[:len(x) - int(jaccard.least_overlap(np.array([len(x)]), 90)[0]) + 1]
            marks.append(jaccard.parity_marks(p, np.array([0, len(p)]))[0].tolist())
        rows.append((marks[0], len(a), marks[1], len(b), bool(100 * both >= 90 * (len(a) + len(b) - both))))
    df = spark.createDataFrame(rows, "a array<long>, na long, b array<long>, nb long, link boolean")
    c = jaccard.F.col
    whole = jaccard.marks_allow(c("a"), c("na"), c("b"), c("nb"), 90)
    got = df.select("link", whole.alias("whole")).collect()
    assert sum(r["link"] for r in got) > 50 and all(r["whole"] for r in got if r["link"])
    unlike = spark.createDataFrame([(jaccard.parity_marks(np.sort(rng.integers(0, 2**62, 21, dtype=np.uint64)), np.array([0, 21]))[0].tolist(), i) for i in range(60)], "m array<long>, i long")
    one, two = unlike.select(c("m").alias("a"), "i"), unlike.select(c("m").alias("b"), (c("i") + 1).alias("i"))
    assert one.join(two, "i").filter(jaccard.marks_allow(c("a"), jaccard.F.lit(200), c("b"), jaccard.F.lit(200), 90)).count() < 5
    numbers = [int(x) for x in rng.integers(-2**62, 2**62, 500)]
    bits = jaccard.bit_table(spark.createDataFrame([(x,) for x in numbers], "x long"), "x")
    assert jaccard.has_bit(bits, np.array(numbers, np.int64).view(np.uint64)).all()
    assert jaccard.has_bit(bits, rng.integers(0, 2**63, 5000, dtype=np.uint64)).mean() < 0.1


def test_set_marks(spark):
    rng = np.random.default_rng(5)

    def mark(keys):
        flat, ends = jaccard.set_marks(np.sort(keys), np.array([0, len(keys)]))
        assert ends.tolist() == [0, len(flat)] and (len(keys) == 0) == (len(flat) == 0)
        return flat.tolist(), len(keys)

    flat, ends = jaccard.set_marks(np.arange(70, dtype=np.uint64), np.array([0, 1, 1, 70]))
    assert ends.tolist() == [0, 1, 1, 3] and [flat[:1].tolist(), flat[1:].tolist()] == [mark(np.arange(1, dtype=np.uint64))[0], mark(np.arange(1, 70, dtype=np.uint64))[0]]
    rows = []
    for _ in range(300):
        shared, extra = int(rng.integers(1, 700)), int(rng.integers(0, 90))
        keys = rng.integers(0, 2**62, shared + extra, dtype=np.uint64)
        cut = int(rng.integers(0, extra + 1))
        rows.append((*mark(np.append(keys[:shared], keys[shared:shared + cut])), *mark(np.append(keys[:shared], keys[shared + cut:])), 100 * shared >= 90 * (shared + extra), 100 * shared < 75 * (shared + extra) and shared > 100))
    rows.append((*mark(np.arange(64, dtype=np.uint64)), *mark(np.arange(66, dtype=np.uint64)), True, False))  # marks of two sizes
    df = spark.createDataFrame(rows, "a array<long>, na long, b array<long>, nb long, link boolean, far boolean")
    c = jaccard.F.col
    got = df.select("link", "far", jaccard.sets_allow(c("a"), c("na"), c("b"), c("nb"), 90).alias("allow")).collect()
    assert sum(r["link"] for r in got) > 50 and all(r["allow"] for r in got if r["link"])
    far = [r["allow"] for r in got if r["far"]]
    assert far and sum(far) <= 0.1 * len(far)


def test_recurring_holds_one_buffer():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 3000):
        keys = rng.integers(0, 900, n, dtype=np.uint64)
        want, times = np.unique(keys, return_counts=True)
        got, n_got = jaccard.repeated(keys)
        assert (got == want[times > 1]).all() and (n_got == times[times > 1]).all()
    keys = rng.integers(0, 1 << 20, 1 << 20, dtype=np.uint64)
    tracemalloc.start()
    jaccard.repeated(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * keys.nbytes


def test_unlike_sets_of_a_hot_shingle_are_no_pairs(spark):
    """Sets under one shingle: only those that nearly link leave the join, though the marks of their prefixes allow all."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 200, dtype=np.uint64)
    rows = []
    for i in range(60):
        own = rng.integers(0, 2**62, 200, dtype=np.uint64)
        keys = np.sort(np.concatenate([base[:190], own[:10]]) if i < 4 else own)
        whole = jaccard.parity_marks(keys, np.array([0, len(keys)]), jaccard.WHOLE_WORDS)[0].tolist()
        rows += [(t, i, 200, 0, i, [0] * jaccard.MARK_WORDS, whole) for t in range(30)]
    df = spark.createDataFrame(rows, "token long, node long, n long, pos int, label long, marks array<long>, whole array<long>")
    got = {(r.pivot, r.node) for r in jaccard.across(df, 80, block=7).collect()}
    assert {(a, b) for a in range(4) for b in range(a + 1, 4)} <= got and len(got) < 20


def make_rows(seed, groups, members):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 5, 40, 120, 300]))]
        for _ in range(members if g == 0 else rng.choice([1, 1, 2, 3, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4]) if len(words) > 30 else rng.choice([0, 0, 1])):
                words[rng.randrange(len(words))] = word()
            rows.append((i, " ".join(words) if rng.random() < 0.8 else " ".join(words).upper()))
            i += 1
    rng.shuffle(rows)
    return rows


def test_components(spark, frame, monkeypatch):
    ship(spark)
    rows = make_rows(1, 60, 80)
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, rows[0][1]), (None, "alone"), (5003, "a b"), (5004, "A b"), (5005, "a b c"), (rows[3][0], rows[9][1]), rows[2],
             (6000, " ".join(f"w{k}" for k in range(30_000))), (6001, " ".join(f"w{k}" for k in range(30_100)))]
    df = frame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, token string", 3)
    for size, percent in ((3, 90), (5, 80)):
        got = jaccard.link(df, size=size, percent=percent).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, size, percent)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)  # many blocks: what the pivots miss is found across components
    got = jaccard.link(df, size=2, percent=70).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2, 70)


def test_keep_first_and_empty(spark, frame):
    ship(spark)
    rows = [(3, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "other words here in this text"), (None, "one two three four five six seven"), (4, None)]
    kept = jaccard.keep_first(frame(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, None]
    assert jaccard.link(frame([])).collect() == []


def test_sql():
    rows = make_rows(4, 40, 20) + [(5000, None), (5001, ""), (5002, " \n "), (5003, "a b"), (5004, "A b"), (5005, "É b c"), (5006, "é b c")]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert sorted(db.execute(jaccard.SQL).fetchall(), key=repr) == brute(rows, 3, 90)
