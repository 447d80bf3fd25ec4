"""Ranking metrics: one table of ranked predictions with hit flags feeds every metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import (
    DEFAULT_K, DEFAULT_THRESHOLD, ITEM, PREDICTION, RATING, ROWS_PER_TASK, TIMESTAMP, USER,
    rank_rows, require_columns, running, top_k,
)
from preflens.operators.rating import auc


def topk_per_user(df, k=DEFAULT_K, user=USER, item=ITEM, score=PREDICTION) -> DataFrame:
    """(user, item, score, rank) of the k best items; equal scores are ordered by item."""
    return top_k(df.select(user, item, score), [user], [F.col(score).desc(), F.col(item)], k)


def relevant_by_threshold(df, threshold=DEFAULT_THRESHOLD, user=USER, item=ITEM, score=PREDICTION, limit=ROWS_PER_TASK):
    """All items scored at or above the threshold, ranked by score."""
    good = df.filter(F.col(score) >= threshold).select(user, item, score)
    return rank_rows(good, [user], [(score, False), (item, True)], "rank", limit=limit)


def relevant_by_timestamp(df, k=DEFAULT_K, user=USER, item=ITEM, timestamp=TIMESTAMP) -> DataFrame:
    """The k latest items of each user, newest first."""
    require_columns(df, timestamp)
    return top_k(df.select(user, item, timestamp), [user], [F.col(timestamp).desc(), F.col(item)], k)


def _ranked(pred, method, k, threshold, user, item, prediction, timestamp):
    if method == "top_k":
        best = pred.groupBy(user, item).agg(F.max(prediction).alias(prediction))
        return topk_per_user(best, k, user, item, prediction)
    if method == "by_threshold":
        best = pred.groupBy(user, item).agg(F.max(prediction).alias(prediction))
        return relevant_by_threshold(best, threshold, user, item, prediction)
    if method == "by_time_stamp":
        last = pred.groupBy(user, item).agg(F.max(timestamp).alias(timestamp))
        return relevant_by_timestamp(last, k, user, item, timestamp)
    raise ValueError(f"unknown relevancy method {method!r}")


def hit_table(
    truth, pred, method="top_k", k=DEFAULT_K, threshold=DEFAULT_THRESHOLD,
    user=USER, item=ITEM, prediction=PREDICTION, timestamp=TIMESTAMP,
) -> DataFrame:
    """(user, item, rank, hit, hit_no, n_actual) for the users both frames hold."""
    require_columns(truth, user, item)
    require_columns(pred, user, item)
    actual = truth.select(user, item).distinct()
    n_actual = actual.groupBy(user).agg(F.count(F.lit(1)).alias("n_actual"))
    listed = _ranked(pred, method, k, threshold, user, item, prediction, timestamp).select(user, item, "rank")
    flagged = (
        listed.join(n_actual, user)
        .join(actual.withColumn("_true", F.lit(1)), [user, item], "left")
        .withColumn("hit", F.coalesce("_true", F.lit(0)))
        .drop("_true")
    )
    if method == "by_threshold":  # lists have no bound
        return running(flagged, [user], [("rank", True)], {"hit_no": F.col("hit")})
    from pyspark.sql import Window

    upto = Window.partitionBy(user).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most k rows
    return flagged.withColumn("hit_no", F.sum("hit").over(upto))


def _discount(rank: Column, base: str) -> Column:
    return F.log2(rank + 1) if base == "log2" else F.ln(rank + 1)


def _ideal(n: Column, base: str) -> Column:
    """Sum of the discounts of the first n ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0),
                       lambda s, r: s + 1 / _discount(r, base))


def per_user_metrics(hits: DataFrame, k=DEFAULT_K, user=USER) -> DataFrame:
    """All metrics of each user from a hit table."""
    hit, rank = F.col("hit"), F.col("rank")
    sums = hits.groupBy(user).agg(
        F.sum("hit").alias("_hits"),
        F.first("n_actual").alias("_actual"),
        F.sum(hit / rank).alias("arhr"),
        F.sum(hit * F.col("hit_no") / rank).alias("_ap"),
        F.min(F.when(hit == 1, rank)).alias("_first"),
        F.sum(hit / _discount(rank, "ln")).alias("_dcg"),
    )
    return sums.select(
        user,
        (F.col("_hits") / k).alias("precision"),
        (F.col("_hits") / F.col("_actual")).alias("recall"),
        (F.col("_dcg") / _ideal(F.least(F.lit(k), F.col("_actual")), "ln")).alias("ndcg"),
        (F.col("_ap") / F.col("_actual")).alias("map"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        "arhr",
        F.try_divide("_ap", "_hits").alias("avg_precision"),  # no hit: no value
    )


RANKING_METRICS = ("precision", "recall", "ndcg", "map", "mrr", "arhr", "avg_precision", "avg_recall", "f1")


def ranking_report(truth, pred, metrics: Sequence[str] = RANKING_METRICS, k=DEFAULT_K, user=USER, **options) -> DataFrame:
    """One row with the means over users; ``avg_recall`` is the recall, ``f1`` joins mean precision and recall."""
    per_user = per_user_metrics(hit_table(truth, pred, k=k, user=user, **options), k, user)
    p, r = F.avg("precision"), F.avg("recall")
    means = {m: F.avg(m) for m in ("precision", "recall", "ndcg", "map", "mrr", "arhr", "avg_precision")}
    means["avg_recall"] = r
    means["f1"] = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return per_user.agg(*[means[m].alias(m) for m in metrics])


def precision_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["precision"], **options)


def recall_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["recall"], **options)


def map_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["map"], **options)


def mrr_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["mrr"], **options)


def arhr_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["arhr"], **options)


def avg_precision_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["avg_precision"], **options)


def avg_recall_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["avg_recall"], **options)


def f1_at_k(truth, pred, **options):
    return ranking_report(truth, pred, ["f1"], **options)


def ndcg_at_k(
    truth, pred, score_type="binary", discount="loge", k=DEFAULT_K, user=USER, item=ITEM, rating=RATING, **options
) -> DataFrame:
    """nDCG with binary, raw-rating or 2**rating - 1 gains and a natural or base-2 discount."""
    if score_type not in ("binary", "raw", "exp"):
        raise ValueError(f"unknown score type {score_type!r}")
    base = "log2" if discount == "log2" else "ln"
    hits = hit_table(truth, pred, k=k, user=user, item=item, **options)
    if score_type == "binary":
        sums = hits.groupBy(user).agg(
            F.sum(F.col("hit") / _discount(F.col("rank"), base)).alias("_dcg"), F.first("n_actual").alias("_n")
        )
        per_user = sums.select((F.col("_dcg") / _ideal(F.least(F.lit(k), F.col("_n")), base)).alias("v"))
    else:
        gain = F.col("_r") if score_type == "raw" else F.pow(F.lit(2.0), F.col("_r")) - 1
        rated = truth.groupBy(user, item).agg(F.max(rating).cast("double").alias("_r"))
        value = gain / _discount(F.col("rank"), base)
        got = hits.filter(F.col("hit") == 1).join(rated, [user, item]).groupBy(user).agg(F.sum(value).alias("_dcg"))
        best = top_k(rated, [user], [F.col("_r").desc(), F.col(item)], k).groupBy(user).agg(F.sum(value).alias("_best"))
        listed = hits.select(user).distinct()
        joined = listed.join(best, user).join(got, user, "left")
        per_user = joined.select(F.coalesce(F.try_divide(F.coalesce("_dcg", F.lit(0.0)), F.col("_best")), F.lit(0.0)).alias("v"))
    return per_user.agg(F.avg("v").alias("ndcg"))


# ---------------------------------------------------------------- metrics of grouped scores


def group_metrics(df, group: Sequence[str], k=10, label="label", score="score", tie="item", limit=ROWS_PER_TASK) -> DataFrame:
    """Mean over groups of MRR, nDCG@k and hit@k of a scored list; a group without positives has no MRR or nDCG."""
    group = list(group)
    ranked = rank_rows(df, group, [(score, False), (tie, True)], "_rank", limit=limit)
    ranked = rank_rows(ranked, group, [(label, False), (tie, True)], "_ideal", limit=limit)
    y = F.col(label)
    gain = F.pow(F.lit(2.0), y) - 1

    def dcg(rank):
        return F.sum(F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + 1)).otherwise(0.0))

    per_group = ranked.groupBy(*group).agg(
        F.try_divide(F.sum(y / F.col("_rank")), F.sum(y)).alias("mrr"),
        F.try_divide(dcg("_rank"), dcg("_ideal")).alias("ndcg"),
        F.max(F.when(F.col("_rank") <= k, y).otherwise(0)).alias("hit"),
    )
    return per_group.agg(
        F.avg("mrr").alias("group_mrr"), F.avg("ndcg").alias("group_ndcg"), F.avg("hit").alias("group_hit")
    )


def group_auc(df, group: Sequence[str], label="label", score="score", limit=ROWS_PER_TASK) -> DataFrame:
    """Mean AUC of the groups that hold both classes."""
    return auc(df, label, score, group, limit).agg(F.avg("auc").alias("group_auc"))


def sampled_rank_metrics(batches, batch: Sequence[str], k=10, label="label", score="score") -> DataFrame:
    """Hit rate and nDCG of one positive among its sampled negatives."""
    batch = list(batch)
    pos = batches.filter(F.col(label) == 1).select(*batch, F.col(score).alias("_s"))
    neg = batches.filter(F.col(label) == 0).select(*batch, score)
    above = neg.join(pos, batch).filter(F.col(score) > F.col("_s")).groupBy(*batch).agg(F.count(F.lit(1)).alias("_above"))
    ranks = pos.join(above, batch, "left").select(F.coalesce("_above", F.lit(0)).alias("_above"))
    top = F.col("_above") < k
    return ranks.agg(
        F.avg(top.cast("int")).alias("hr"),
        F.avg(F.when(top, 1 / F.log2(F.col("_above") + 2)).otherwise(0.0)).alias("ndcg"),
    )


def metrics_unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value) rows."""
    return df.unpivot(list(keys), list(values), "metric", "value")


def run_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Union of one-row reports, named by algorithm."""
    frames = [df.select(F.lit(name).alias("algorithm"), "*") for name, df in reports.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
