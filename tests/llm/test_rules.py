"""Counts against a plain loop; learned rules on separable rows; no Python in the plan."""

import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from preflens.llm import rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#<é\x0b  ", max_size=80), st.lists(st.sampled_from(["a", "b", "\n", "# x"]), max_size=60).map(" ".join)), min_size=1, max_size=20))
def test_counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rules.with_statistics(df).select("doc_id", *[f"_s.{c}" for c in rules.COUNTS]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(25, 60))]
        if bad := i % 5 == 0:
            words = [w + "$$" for w in words] if i % 2 else [w.upper() + "!" for w in words]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_list_is_learned(spark, frame):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (5002, "short"), (None, "no id " * 3), (5003, "x y z " * 9000), (3, rows[3][1])]
    df = frame([(*r, "rule", 5) for r in rows], "doc_id long, text string, rule string, n_words int")
    table = spark.createDataFrame(labels + [(None, 0), (5, None)], "doc_id long, quality int")
    out = rules.judge(df, table)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None or r["doc_id"] >= 5000:
            assert r["base_failed"] and not r["kept"]
        else:
            assert r["kept"] == (r["doc_id"] % 5 != 0), (r, {x["rule"] for x in got})
    text = {i: t for i, t in rows}
    assert all(tuple(r)[1:6] == plain(text[r["doc_id"]]) for r in got)
    kept = rules.keep_good(df, table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"]) and kept.columns == df.columns
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_covering_goes_on_after_a_failed_rule(spark, frame):
    """Kinds of bad rows that take a conjunction, next to many random labels that no rule explains."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(2400):
        upper, loud, odd = i % 4 in (0, 1), i % 4 in (0, 2), i % 2 == 1 and i % 5 == 0
        words = [word().upper() if upper else word() for _ in range(rng.randint(30, 50))]
        rows.append((i, " ".join(w + "!" if loud else w for w in words) + (" " + "# " * 10 if odd else "")))
        # Bad: upper case with exclamations. Symbols: bad by chance only.
        labels.append((i, int(not ((upper and loud) or (odd and rng.random() < 0.5)))))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = rules.judge(frame(rows), table).collect()
    both = [r for r in got if r["doc_id"] % 4 == 0]
    assert not any(r["kept"] for r in both), {r["rule"] for r in got}
    assert all(r["kept"] for r in got if r["doc_id"] % 4 in (1, 2, 3) and r["doc_id"] % 5)


def test_clashing_columns_stay(spark, frame):
    rows, labels = corpus()
    names = ["_w", "_l", "_j", "_h", "_p", "_d", "_s", "_row", "_text", "_bad", "_aside"]
    df = frame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = rules.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows if i % 5]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_no_labels_and_empty(spark, frame):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    assert all(r["kept"] for r in rules.judge(frame(rows), table.limit(0)).collect())
    assert rules.judge(frame([]), table).collect() == []
