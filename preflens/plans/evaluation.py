"""Registered queries: rating and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, USER
from preflens.operators import ranking, rating
from preflens.plans import fixtures as fx
from preflens.plans.fixtures import sql


def rounded(df, *names, digits=6):
    names = names or df.columns
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- rating

_RATING_SQL = {
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "mae": "avg(abs(y - p))",
    "mse": "avg((y - p) * (y - p))",
    "mape": "100 * avg(abs((y - p) / nullif(y, 0)))",
    "rsquared": "1 - avg((y - p) * (y - p)) / var_pop(y)",
    "exp_var": "1 - var_samp(y - p) / var_samp(y)",
}
_PAIRS = """(SELECT t.rating AS y, p.prediction AS p FROM test t JOIN rating_pred p
    ON t."userID" = p."userID" AND t."itemID" = p."itemID")"""


def _rating(name):
    return lambda spark, sf: rounded(getattr(rating, name)(fx.test(spark, sf), fx.rating_pred(spark, sf)))


def rating_report(spark, sf):
    return rounded(rating.rating_report(fx.test(spark, sf), fx.rating_pred(spark, sf)))


QUERIES = {n: (_rating(n), sql(f"SELECT round({e}, 6) AS {n} FROM {_PAIRS}")) for n, e in _RATING_SQL.items()}
QUERIES["rating_report"] = (
    rating_report,
    sql("SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATING_SQL.items()) + f" FROM {_PAIRS}"),
)

# ---------------------------------------------------------------- binary scores

_AUC_SQL = """SELECT {keys} sum(pos * (upto - neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc FROM (
    SELECT *, sum(neg) OVER ({part} ORDER BY score) AS upto FROM (
      SELECT {keys} score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
      FROM {source} GROUP BY {keys} score)) {end}"""


def auc_sql(source, key=None):
    if key:
        return _AUC_SQL.format(keys=f"{key},", part=f"PARTITION BY {key}", source=source, end=f"GROUP BY {key}")
    return _AUC_SQL.format(keys="", part="", source=source, end="")


QUERIES["auc"] = (
    lambda spark, sf: rounded(rating.auc(fx.line_scores(spark, sf))),
    sql(f"SELECT round(auc, 6) AS auc FROM ({auc_sql('line_scores')})"),
)
QUERIES["logloss"] = (
    lambda spark, sf: rounded(rating.logloss(fx.line_scores(spark, sf))),
    sql("""SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS logloss
        FROM (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM line_scores)"""),
)
QUERIES["acc"] = (
    lambda spark, sf: rounded(rating.threshold_metrics(fx.line_scores(spark, sf)).select("acc")),
    sql("SELECT round(avg(CAST((label = 1) = (score >= 0.5) AS INTEGER)), 6) AS acc FROM line_scores"),
)
QUERIES["f1"] = (
    lambda spark, sf: rounded(rating.threshold_metrics(fx.line_scores(spark, sf)).select("f1")),
    sql("""SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (
        SELECT CAST(count(*) FILTER (label = 1 AND score >= 0.5) AS DOUBLE) AS tp,
               count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
               count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM line_scores)"""),
)
QUERIES["pr_curve"] = (
    lambda spark, sf: rounded(rating.curve_points(fx.line_scores(spark, sf)), "threshold", "tpr", "fpr", "precision", digits=9),
    sql("""SELECT round(score, 9) AS threshold, round(tp / np, 9) AS tpr, round(fp / nn, 9) AS fpr,
        round(tp / (tp + fp), 9) AS "precision" FROM (
          SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
                 sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (
            SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
            FROM line_scores GROUP BY score))"""),
)

# ---------------------------------------------------------------- ranking

_HITS = {
    "top10": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY prediction DESC, "itemID") AS rank
        FROM rank_pred) WHERE rank <= 10""",
    "actual": 'SELECT "userID", count(*) AS n_actual FROM test GROUP BY 1',
    "hits": """SELECT p."userID", p."itemID", p.rank, a.n_actual, CAST(t."itemID" IS NOT NULL AS INTEGER) AS hit,
          sum(CAST(t."itemID" IS NOT NULL AS INTEGER)) OVER (PARTITION BY p."userID" ORDER BY p.rank) AS hit_no
        FROM top10 p JOIN actual a ON p."userID" = a."userID"
        LEFT JOIN test t ON t."userID" = p."userID" AND t."itemID" = p."itemID" """,
    "user_metrics": """SELECT "userID", sum(hit) / 10.0 AS "precision", sum(hit) / CAST(max(n_actual) AS DOUBLE) AS recall,
          sum(hit / ln(1 + rank)) / max(list_sum(list_transform(range(1, least(10, n_actual) + 1), lambda r: 1 / ln(1 + r)))) AS ndcg,
          sum(hit * hit_no / rank) / max(n_actual) AS map,
          coalesce(1.0 / min(rank) FILTER (hit = 1), 0) AS mrr, sum(hit / CAST(rank AS DOUBLE)) AS arhr,
          sum(hit * hit_no / rank) / nullif(sum(hit), 0) AS avg_precision
        FROM hits GROUP BY 1""",
}
_RANK_SQL = {
    "precision": 'avg("precision")',
    "recall": "avg(recall)",
    "ndcg": "avg(ndcg)",
    "map": "avg(map)",
    "mrr": "avg(mrr)",
    "arhr": "avg(arhr)",
    "avg_precision": "avg(avg_precision)",
    "avg_recall": "avg(recall)",
    "f1": '2 * avg("precision") * avg(recall) / (avg("precision") + avg(recall))',
}


def rank_sql(body):
    return sql(body, **_HITS)


def _ranking(metric):
    return lambda spark, sf: rounded(ranking.ranking_report(fx.test(spark, sf), fx.rank_pred(spark, sf), [metric]))


for _m in ("precision", "recall", "ndcg", "map", "mrr", "arhr", "avg_precision", "avg_recall", "f1"):
    QUERIES[f"{_m}_at_k"] = (_ranking(_m), rank_sql(f'SELECT round({_RANK_SQL[_m]}, 6) AS "{_m}" FROM user_metrics'))
QUERIES["ranking_report"] = (
    lambda spark, sf: rounded(ranking.ranking_report(fx.test(spark, sf), fx.rank_pred(spark, sf))),
    rank_sql("SELECT " + ", ".join(f'round({e}, 6) AS "{n}"' for n, e in _RANK_SQL.items()) + " FROM user_metrics"),
)

_METHODS = {
    "ranking_by_threshold": (
        {"method": "by_threshold", "threshold": 0.5}, "rank_pred",
        """SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY prediction DESC, "itemID") AS rank FROM rank_pred WHERE prediction >= 0.5""",
    ),
    "ranking_by_time": (
        {"method": "by_time_stamp"}, "interactions",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID") AS rank
        FROM interactions) WHERE rank <= 10""",
    ),
}
for _name, (_options, _source, _listed) in _METHODS.items():
    def _by(spark, sf, options=_options, source=_source):
        return rounded(ranking.ranking_report(fx.test(spark, sf), getattr(fx, source)(spark, sf), **options))

    QUERIES[_name] = (_by, sql("SELECT " + ", ".join(f'round({e}, 6) AS "{n}"' for n, e in _RANK_SQL.items()) + " FROM user_metrics", **{**_HITS, "top10": _listed}))


def report_runs(spark, sf):
    """The reports of two recommenders under each other."""
    test, names = fx.test(spark, sf), ["precision", "recall", "map"]
    lists = {"scored": ranking.ranking_report(test, fx.rank_pred(spark, sf), names),
             "latest": ranking.ranking_report(test, fx.interactions(spark, sf), names, method="by_time_stamp")}
    return rounded(ranking.run_reports(lists), *names)


_MEANS = """round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(map), 6) AS map"""
_LATEST = {k: v.replace("top10", "latest10").replace("hits", "latest_hits") for k, v in _HITS.items() if k in ("hits", "user_metrics")}
QUERIES["report_runs"] = (
    report_runs,
    sql(f"SELECT 'scored' AS algorithm, {_MEANS} FROM user_metrics UNION ALL SELECT 'latest', {_MEANS} FROM latest_metrics",
        **_HITS, latest10=_METHODS["ranking_by_time"][2], latest_hits=_LATEST["hits"], latest_metrics=_LATEST["user_metrics"]),
)

_NDCG = """SELECT round(avg(coalesce(dcg, 0) / best), 6) AS ndcg FROM (
      SELECT "userID", sum({gain} / {log}(1 + r)) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY rating DESC, "itemID") AS r FROM test) WHERE r <= 10 GROUP BY 1)
    JOIN (SELECT h."userID", sum(CASE WHEN hit = 1 THEN {gain} / {log}(1 + rank) END) AS dcg
      FROM hits h LEFT JOIN test t ON t."userID" = h."userID" AND t."itemID" = h."itemID" GROUP BY 1) USING ("userID")"""
QUERIES["ndcg_raw"] = (
    lambda spark, sf: rounded(ranking.ndcg_at_k(fx.test(spark, sf), fx.rank_pred(spark, sf), "raw")),
    rank_sql(_NDCG.format(gain="rating", log="ln")),
)
QUERIES["ndcg_exp_log2"] = (
    lambda spark, sf: rounded(ranking.ndcg_at_k(fx.test(spark, sf), fx.rank_pred(spark, sf), "exp", "log2")),
    rank_sql(_NDCG.format(gain="(pow(2.0, rating) - 1)", log="log2")),
)


def _lists(df, *names):
    return rounded(df.select(*names, "rank"), *[n for n in names if n == PREDICTION], digits=9)


QUERIES["topk_per_user"] = (
    lambda spark, sf: ranking.topk_per_user(fx.rank_pred(spark, sf)).select(USER, ITEM, F.col("rank").cast("long")),
    rank_sql('SELECT "userID", "itemID", rank FROM top10'),
)
QUERIES["relevant_by_threshold"] = (
    lambda spark, sf: ranking.relevant_by_threshold(fx.rating_pred(spark, sf)).select(USER, ITEM, "rank"),
    sql("""SELECT "userID", "itemID", row_number() OVER (PARTITION BY "userID" ORDER BY prediction DESC, "itemID") AS rank
        FROM rating_pred WHERE prediction >= 10"""),
)
QUERIES["relevant_by_timestamp"] = (
    lambda spark, sf: ranking.relevant_by_timestamp(fx.interactions(spark, sf)).select(USER, ITEM, F.col("rank").cast("long")),
    sql("""SELECT * FROM (SELECT "userID", "itemID",
        row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID") AS rank FROM interactions) WHERE rank <= 10"""),
)

# ---------------------------------------------------------------- grouped scores

_GROUPED = {
    "grouped": """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, line) AS r,
        row_number() OVER (PARTITION BY grp ORDER BY label DESC, line) AS b FROM line_scores""",
    "per_group": """SELECT grp, sum(label / CAST(r AS DOUBLE)) / nullif(sum(label), 0) AS mrr,
        sum(CASE WHEN r <= 3 THEN label / log2(r + 1) ELSE 0 END)
          / nullif(sum(CASE WHEN b <= 3 THEN label / log2(b + 1) ELSE 0 END), 0) AS ndcg,
        max(CASE WHEN r <= 3 THEN label ELSE 0 END) AS hit FROM grouped GROUP BY grp""",
}


def _group(name):
    return lambda spark, sf: rounded(
        ranking.group_metrics(fx.line_scores(spark, sf), ["grp"], 3, tie="line").select(f"group_{name}")
    )


for _m in ("mrr", "ndcg", "hit"):
    QUERIES[f"group_{_m}"] = (_group(_m), sql(f"SELECT round(avg({_m}), 6) AS group_{_m} FROM per_group", **_GROUPED))
QUERIES["group_auc"] = (
    lambda spark, sf: rounded(ranking.group_auc(fx.line_scores(spark, sf), ["grp"])),
    sql(f"SELECT round(avg(auc), 6) AS group_auc FROM ({auc_sql('line_scores', 'grp')})"),
)


def sampled_hr_ndcg(spark, sf):
    """Each test item against the distractors of its user."""
    score = fx.rank_pred(spark, sf)
    positives = fx.test(spark, sf).select(USER, F.col(ITEM).alias("batch"))
    negatives = fx.distractors(spark, sf).join(fx.test(spark, sf).select(USER, ITEM), [USER, ITEM], "left_anti")
    rows = positives.withColumn(ITEM, F.col("batch")).withColumn("label", F.lit(1)).unionByName(
        positives.join(negatives, USER).withColumn("label", F.lit(0))
    )
    return rounded(ranking.sampled_rank_metrics(rows.join(score, [USER, ITEM]), [USER, "batch"], score=PREDICTION))


QUERIES["sampled_hr_ndcg"] = (
    sampled_hr_ndcg,
    sql(f"""SELECT round(avg(CASE WHEN above < 10 THEN 1.0 ELSE 0.0 END), 6) AS hr,
        round(avg(CASE WHEN above < 10 THEN 1 / log2(above + 2) ELSE 0 END), 6) AS ndcg FROM (
          SELECT t."userID", t."itemID", count(d."itemID") AS above FROM
            (SELECT *, {fx.h('p', '"userID"', '"itemID"')} AS s FROM test) t LEFT JOIN
            (SELECT *, {fx.h('p', '"userID"', '"itemID"')} AS s FROM distractors
              WHERE NOT EXISTS (SELECT 1 FROM test x WHERE x."userID" = distractors."userID" AND x."itemID" = distractors."itemID")) d
            ON t."userID" = d."userID" AND d.s > t.s GROUP BY 1, 2)"""),
)
QUERIES["metrics_unpivot"] = (
    lambda spark, sf: ranking.metrics_unpivot(
        rating_report(spark, sf).withColumn("stage", F.lit("test")), ["stage"], ["rmse", "mae", "rsquared"]
    ),
    sql(" UNION ALL ".join(
        f"SELECT 'test' AS stage, '{n}' AS metric, round({_RATING_SQL[n]}, 6) AS value FROM {_PAIRS}"
        for n in ("rmse", "mae", "rsquared"))),
)
