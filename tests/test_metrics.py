"""Metrics against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from preflens.operators import cooccur, diversity, ranking, rating, vectors


def pairs(spark, rows, last="rating double"):
    return spark.createDataFrame(rows, f"userID string, itemID string, {last}")


@pytest.fixture(scope="module")
def lists(spark):
    truth = pairs(spark, [("u1", "a", 5.0), ("u1", "b", 3.0), ("u2", "c", 4.0), ("u3", "d", 2.0), ("u9", "z", 1.0)])
    listed = {"u1": "axb", "u2": "ycz", "u3": "xyz", "u8": "abc"}
    pred = pairs(spark, [(u, i, 1.0 - n / 10) for u, items in listed.items() for n, i in enumerate(items)], "prediction double")
    return truth, pred


def test_ranking(lists):
    r = ranking.ranking_report(*lists, k=3).first()
    assert r.precision == pytest.approx(1 / 3) and r.recall == pytest.approx(2 / 3) and r.mrr == pytest.approx(1 / 2)
    assert r.arhr == pytest.approx(11 / 18) and r.map == pytest.approx(4 / 9) and r.avg_precision == pytest.approx(2 / 3)
    assert r.avg_recall == r.recall and r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))
    d = [1 / math.log(1 + n) for n in (1, 2, 3)]
    assert r.ndcg == pytest.approx(((d[0] + d[2]) / (d[0] + d[1]) + d[1] / d[0] + 0) / 3)


def test_ndcg_of_ratings(lists):
    got = ranking.ndcg_at_k(*lists, score_type="raw", k=3).first().ndcg
    u1 = (5 / math.log(2) + 3 / math.log(4)) / (5 / math.log(2) + 3 / math.log(3))
    assert got == pytest.approx((u1 + math.log(2) / math.log(3) + 0) / 3)
    with pytest.raises(ValueError):
        ranking.ndcg_at_k(*lists, score_type="other")


def test_perfect_list(spark):
    truth = pairs(spark, [("u", c, 1.0) for c in "abc"])
    r = ranking.ranking_report(truth, truth.withColumnRenamed("rating", "prediction"), k=3).first()
    assert all(getattr(r, n) == pytest.approx(1) for n in ("precision", "recall", "ndcg", "map", "mrr", "f1"))


def test_methods(lists):
    truth, pred = lists
    r = ranking.ranking_report(truth, pred, ["recall"], k=3, method="by_threshold", threshold=0.95).first()
    assert r.recall == pytest.approx((1 / 2 + 0 + 0) / 3)
    with pytest.raises(ValueError):
        ranking.ranking_report(truth, pred, method="nearest")


def test_rating(spark):
    y, p = (3, 4, 5, 2), (2, 4, 6, 2)
    truth = pairs(spark, [("u", str(i), float(v)) for i, v in enumerate(y)] + [("x", "0", 1.0)])
    pred = pairs(spark, [("u", str(i), float(v)) for i, v in enumerate(p)], "prediction double")
    r = rating.rating_report(truth, pred).first()
    assert (r.mse, r.mae, r.rsquared) == (0.5, 0.5, pytest.approx(0.6))
    zero = pairs(spark, [("u", "0", 0.0), ("u", "1", 4.0)])
    assert rating.mape(zero, pred).first().mape == pytest.approx(0)


@pytest.mark.parametrize("limit", [1, 1000])
def test_auc(spark, limit):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert rating.auc(df, limit=limit).first().auc == pytest.approx(0.625)
    assert rating.auc(df.withColumn("score", F.lit(1.0))).first().auc == pytest.approx(0.5)
    assert rating.auc(df.filter("label = 1")).first().auc is None


def test_cooccurrence(spark):
    df = pairs(spark, [("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "a", 1.0), ("u2", "b", 1.0), ("u2", "c", 1.0), ("u3", "c", 1.0)])
    expected = {"cooccurrence": (2, 1), "jaccard": (1, 1 / 3), "lift": (0.5, 1 / 4), "inclusion": (1, 1 / 2), "cosine": (1, 1 / 2),
                "mutual_information": (math.log2(1.5), math.log2(0.75))}
    for kind, (ab, ac) in expected.items():
        sim = {(r.i1, r.i2): r.sim for r in cooccur.item_similarity(df, kind).collect()}
        assert sim["a", "b"] == pytest.approx(ab) and sim["a", "c"] == pytest.approx(ac)
    assert {(r.i1, r.i2) for r in cooccur.cooccurrence(df, 2).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b")}
    with pytest.raises(ValueError):
        cooccur.require_unique(df.union(df), "userID", "itemID")
    with pytest.raises(ValueError):
        cooccur.require_known_users(pairs(spark, [("u7", "a", 1.0)]), df)


def test_scores_agree(spark):
    df = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(15) if (u * 7 + i * 3) % 4 == 0],
                               "userID long, itemID long, rating double")
    aff, sim = cooccur.affinity(df), cooccur.item_similarity(df)
    top = cooccur.recommend_k_items(aff, sim, 3).collect()
    full = {(r.userID, r.itemID): r.prediction for r in cooccur.scores(aff, sim, df).collect()}
    for user in range(12):
        want = sorted(((-v, i) for (u, i), v in full.items() if u == user))[:3]
        assert [r.itemID for r in sorted((t for t in top if t.userID == user), key=lambda t: t.rank)] == [i for _, i in want]
    asked = spark.createDataFrame([(0, 1), (0, 99)], "userID long, itemID long")
    assert {r.itemID: r.prediction for r in cooccur.predict(asked, aff, sim).collect()}[99] == 0.0


def test_diversity(spark):
    train = pairs(spark, [("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "b", 1.0), ("u3", "c", 1.0)])
    reco = pairs(spark, [("u2", "a", 1.0), ("u2", "c", 1.0), ("u3", "a", 1.0), ("u3", "b", 1.0), ("u1", "c", 1.0)]).drop("rating")
    ild = {r.userID: r.user_diversity for r in diversity.user_diversity(train, reco).collect()}
    assert ild == {"u2": pytest.approx(1.0), "u3": pytest.approx(1 - 1 / math.sqrt(2))}
    assert diversity.catalog_coverage(train, reco).first()[0] == pytest.approx(1.0)
    assert diversity.distributional_coverage(reco).first()[0] == pytest.approx(-(0.8 * math.log2(0.4) + 0.2 * math.log2(0.2)))
    nov = {r.itemID: r.item_novelty for r in diversity.item_novelty(train).collect()}
    assert nov == {"a": pytest.approx(2), "b": pytest.approx(1), "c": pytest.approx(2)}
    ser = {(r.userID, r.itemID): r.user_item_serendipity for r in diversity.user_item_serendipity(train, reco).collect()}
    assert ser["u2", "a"] == pytest.approx(1 - 1 / math.sqrt(2)) and ser["u2", "c"] == pytest.approx(1)


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (4.0, 1)], "x double, y int")
    rx, ry = [1, 2.5, 2.5, 4], [3, 1, 3, 3]
    mx, my = sum(rx) / 4, sum(ry) / 4
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    want = cov / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert vectors.spearman(df, "x", "y", limit=2).first().spearman == pytest.approx(want)


def test_sampled_ranks(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.9), (1, 0, 0.1), (2, 1, 0.9)], "b int, label int, score double")
    r = ranking.sampled_rank_metrics(df, ["b"], k=1).first()
    assert (r.hr, r.ndcg) == (0.5, 0.5)
