"""Rating metrics over the inner join of true and predicted ratings, and metrics of binary scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, ROWS_PER_TASK, USER, require_columns, running


def rating_pairs(truth, pred, user=USER, item=ITEM, rating=RATING, prediction=PREDICTION) -> DataFrame:
    """True (y) and predicted (p) rating of the pairs both frames hold."""
    require_columns(truth, user, item, rating)
    require_columns(pred, user, item, prediction)
    y = truth.select(user, item, F.col(rating).cast("double").alias("y"))
    p = pred.select(user, item, F.col(prediction).cast("double").alias("p"))
    return y.join(p, [user, item])


def _rating_aggregates() -> dict[str, Column]:
    y, p = F.col("y"), F.col("p")
    error = y - p
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "mape": F.avg(F.abs(F.try_divide(error, y))) * 100,  # a true rating of 0 has no relative error
        "rsquared": 1 - F.try_divide(F.avg(error * error), F.var_pop(y)),
        "exp_var": 1 - F.try_divide(F.var_samp(error), F.var_samp(y)),
    }


def rating_report(truth, pred, metrics: Sequence[str] | None = None, **cols) -> DataFrame:
    """One row with the chosen rating metrics, in one pass over the joined pairs."""
    known = _rating_aggregates()
    names = list(metrics or known)
    return rating_pairs(truth, pred, **cols).agg(*[known[n].alias(n) for n in names])


def rmse(truth, pred, **cols):
    return rating_report(truth, pred, ["rmse"], **cols)


def mae(truth, pred, **cols):
    return rating_report(truth, pred, ["mae"], **cols)


def mse(truth, pred, **cols):
    return rating_report(truth, pred, ["mse"], **cols)


def mape(truth, pred, **cols):
    return rating_report(truth, pred, ["mape"], **cols)


def rsquared(truth, pred, **cols):
    return rating_report(truth, pred, ["rsquared"], **cols)


def exp_var(truth, pred, **cols):
    return rating_report(truth, pred, ["exp_var"], **cols)


# ---------------------------------------------------------------- binary labels and scores


def _score_counts(df, label, score, group):
    """Positives and negatives per distinct score: ties are settled before anything is sorted."""
    y = F.col(label)
    return df.groupBy(*group, score).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).alias("_neg"),
    )


def auc(df, label="label", score="score", group: Sequence[str] = (), limit=ROWS_PER_TASK) -> DataFrame:
    """Area under the ROC curve (ties count one half), for the table or for each group; null with one class only."""
    group = list(group)
    counts = _score_counts(df, label, score, group)
    below = running(counts, group, [(score, True)], {"_upto": F.col("_neg")}, limit=limit)
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return below.groupBy(*group).agg(F.try_divide(wins, pairs).alias("auc"))


def logloss(df, label="label", score="score", eps=1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return df.agg((-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"))


def threshold_metrics(df, label="label", score="score", threshold=0.5) -> DataFrame:
    """Accuracy and F1 of score >= threshold."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    tp, fp, fn = (F.sum(c.cast("long")) for c in (y & hit, ~y & hit, y & ~hit))
    return df.agg(
        F.avg((y == hit).cast("int")).alias("acc"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def curve_points(df, label="label", score="score", limit=ROWS_PER_TASK) -> DataFrame:
    """ROC and precision-recall points at every distinct score taken as the threshold."""
    counts = _score_counts(df, label, score, [])
    sums = running(
        counts, [], [(score, False)], {"tp": F.col("_pos"), "fp": F.col("_neg")},
        {"n_pos": F.col("_pos"), "n_neg": F.col("_neg")}, limit,
    )
    return sums.select(
        F.col(score).alias("threshold"),
        F.try_divide("tp", "n_pos").alias("tpr"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )
