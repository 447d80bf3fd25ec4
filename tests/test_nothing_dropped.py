"""Results that earlier versions lost: each test names what has to stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflens.operators import blocked, candidates, cooccur, diversity, features, negatives
from preflens.sources import records


def test_negative_scores_are_recommended(spark):
    aff = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "userID long, itemID long, affinity double")
    sim = spark.createDataFrame([(1, 1, 1.0), (1, 2, -0.5), (1, 3, -0.2), (2, 2, 1.0)], "i1 long, i2 long, sim double")
    got = {(r.userID, r.itemID): (r.prediction, r["rank"]) for r in cooccur.recommend_k_items(aff, sim, 5).collect()}
    assert got == {(1, 3): (-0.2, 1), (1, 2): (-0.5, 2), (2, 1): (-0.5, 1)}
    with pytest.raises(ValueError):
        cooccur.recommend_k_items(aff.union(aff), sim, 5, check=True)


def test_dense_graph_gives_all_free_pairs(spark):
    pairs = [(i, j) for i in range(9) for j in range(i)]
    known = pairs[::2]
    edges = spark.createDataFrame(known, "product1 long, product2 long")
    free = {tuple(sorted(p)) for p in pairs} - {tuple(sorted(p)) for p in known}
    for n in (1, len(free) - 2, len(free)):
        got = [tuple(r) for r in negatives.negative_edges(edges, edges, n).collect()]
        assert len(got) == n and set(got) <= free
    with pytest.raises(ValueError):
        negatives.negative_edges(edges, edges, len(free) + 1)


def test_null_fields_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a", 2.0), (2, 0, None, 3.0), (3, 1, "b", None)], "id long, y int, c string, n double")
    got = {r.id: r.value for r in features.libffm_rows(rows, ["c", "n"], "y", ["id"]).collect()}
    assert got == {1: "1 1:2:1 2:4:2.0", 2: "0 1:1:1 2:4:3.0", 3: "1 1:3:1"}


def test_ties_leave_a_block_k_times():
    ids = np.arange(300)[::-1].copy()
    got = blocked._best(np.arange(50), ids, np.zeros((50, 300)), 5, np.array([]), np.array([]), False)
    assert len(got) == 250 and set(got["right"]) == {0, 1, 2, 3, 4}
    scores = np.random.default_rng(0).integers(0, 4, (20, 30)).astype(float)
    got = blocked._best(np.arange(20), ids[:30], scores.copy(), 7, np.array([]), np.array([]), False)
    for row in range(20):
        want = sorted(zip(-scores[row], ids[:30]))[:7]
        assert sorted(zip(-got[got["left"] == row]["score"], got[got["left"] == row]["right"])) == want


def test_latest_history_by_clock_and_number(spark):
    rows = [("9", "u", "11/9/2019 11:05:58 PM", "old"), ("1", "u", "11/10/2019 9:05:58 AM", "new"), ("9", "v", "5", "old"), ("10", "v", "5", "new"), ("2", "w", "100", "new"), ("3", "w", "99", "old")]
    df = spark.createDataFrame(rows, "imp string, user string, time string, clicks string")
    assert {r.user: r.clicks for r in records.user_history(df, "p").collect()} == {"p_u": "new", "p_v": "new", "p_w": "new"}


def test_zero_scores_are_candidates(spark):
    scores = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, -1.0)], "userID long, itemID long, prediction double")
    train = scores.filter("itemID = 2")
    assert [r.itemID for r in candidates.candidates_unseen(scores, train).orderBy("rank").collect()] == [1, 3]
    assert [r.itemID for r in candidates.candidates_unseen(scores, train, zero_is_absent=True).collect()] == [3]


def test_draws_have_no_fixed_stride(spark):
    seen = spark.createDataFrame([(u, u) for u in range(5)] + [(9, i) for i in range(2000)], "userID long, itemID long")
    got = negatives.negatives_per_positive(seen.filter("userID < 5").union(spark.range(2000).selectExpr("9L", "id")), 8).filter("label = 0 and userID < 5")
    for user in range(5):
        items = sorted(r.itemID for r in got.filter(F.col("userID") == user).collect())
        gaps = {b - a for a, b in zip(items, items[1:])}
        assert len(items) == len(set(items)) == 8 and len(gaps) > 3 and user not in items


def test_overlapping_lists_raise(spark):
    train = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "userID long, itemID long")
    reco = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "userID long, itemID long")
    with pytest.raises(ValueError):
        diversity.diversity(train, reco, check=True).collect()
    with pytest.raises(ValueError):
        diversity.serendipity(train, reco, check=True).collect()
    ok = reco.filter("itemID <> 2")
    assert diversity.serendipity(train, ok, check=True).count() == 1
    sims = {(r.i1, r.i2): r.sim for r in diversity.cooccurrence_sim_of(spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "i1 long, i2 long"), train).collect()}
    assert sims == {(1, 2): pytest.approx(1 / 2**0.5), (2, 2): pytest.approx(1.0)}


@pytest.mark.parametrize("set_size", [1, 3, 2_000])
def test_similarity_of_pairs_with_hot_items(spark, set_size):
    """Packed sets, single look-ups and their mix give the similarity of the full table."""
    rng = np.random.default_rng(8)
    rows = [(int(u), int(i)) for u in range(40) for i in rng.choice(12, 4, replace=False)] + [(u, 99) for u in range(40)] + [(1, 2), (1, 2), (None, 3), (4, None)]
    train = spark.createDataFrame(rows, "userID long, itemID long")
    pairs = spark.createDataFrame([(a, b) for a in [*range(12), 99, 500] for b in [*range(12), 99, 500] if a <= b] * 2, "i1 long, i2 long")
    got = {(r.i1, r.i2): round(r.sim, 12) for r in diversity.cooccurrence_sim_of(pairs, train, set_size=set_size).collect()}
    users = {}
    for u, i in rows:
        if u is not None and i is not None:
            users.setdefault(i, set()).add(u)
    want = {(a, b): round(len(users[a] & users[b]) / (len(users[a]) * len(users[b])) ** 0.5, 12) for a in users for b in users if a <= b and users[a] & users[b]}
    assert got == want


@pytest.mark.parametrize("pool,n", [(5, 2), (7, 3)])
def test_every_set_of_negatives_is_as_likely(spark, pool, n):
    """Draws are the start of a random permutation: all sets, neighbours included, come equally often."""
    users = 4_000
    need = spark.range(users).selectExpr("id AS userID", f"{pool}L AS pool", f"{n}L AS n")
    rows = negatives._with_permutation(need, "pool", 42, ["userID"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pool") - 1)))
    rows = negatives._permuted(rows, "j", "pool", "p").select("userID", "j", "p").collect()
    sets, whole = {}, {}
    for r in rows:
        whole.setdefault(r.userID, set()).add(r.p)
        if r.j < n:
            sets.setdefault(r.userID, set()).add(r.p)
    assert all(x == set(range(pool)) for x in whole.values())
    from collections import Counter
    from math import comb

    counts = Counter(frozenset(x) for x in sets.values())
    expected = users / comb(pool, n)
    assert len(counts) == comb(pool, n) and all(0.75 * expected < c < 1.25 * expected for c in counts.values())


@pytest.mark.parametrize("pool", [1, 2, 3, 10, 97, 1_000, 123_457])
def test_permutation_of_any_pool(spark, pool):
    rows = negatives._with_permutation(spark.range(1).selectExpr("id AS userID", f"{pool}L AS pool"), "pool", 1, ["userID"])
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pool") - 1)))
    assert negatives._permuted(rows, "j", "pool", "p").agg(F.min("p"), F.max("p"), F.count_distinct("p")).first()[:] == (0, pool - 1, pool)


def test_popularity_draws_with_a_hot_item(spark):
    """One item with 99 % of the rows: every key has its n items, and the hot one comes first nearly always."""
    history = spark.createDataFrame([(0, "c0")] * 9_900 + [(i, f"c{i}") for i in range(1, 101)], "itemID long, cate string")
    positives = spark.createDataFrame([(u, 1 + u % 100) for u in range(400)] + [(999, 0)], "userID long, itemID long")
    rows = negatives.popularity_negatives(positives, history, 4).collect()
    by = {}
    for r in rows:
        by.setdefault((r.userID, r.itemID), []).append((r["rank"], r.neg))
        assert r.neg != r.itemID and r.cate == f"c{r.neg}"
    assert len(by) == 401 and all(len(x) == 4 == len({i for _, i in x}) for x in by.values())
    assert 0 not in [i for _, i in by[999, 0]]
    assert sum(min(x)[1] == 0 for k, x in by.items() if k[1]) >= 380
    few = spark.createDataFrame([(0, "a")] * 50 + [(1, "b")] * 5 + [(2, "c")], "itemID long, cate string")
    got = negatives.popularity_negatives(spark.createDataFrame([(1, 0), (1, 2)], "userID long, itemID long"), few, 2).collect()
    assert sorted((r.itemID, r.neg) for r in got) == [(0, 1), (0, 2), (2, 0), (2, 1)]
