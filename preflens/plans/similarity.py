"""Registered queries: co-occurrence recommender and diversity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, TIMESTAMP, USER, item_pairs
from preflens.operators import cooccur, diversity
from preflens.plans import fixtures as fx
from preflens.plans.evaluation import rounded
from preflens.plans.fixtures import sql

QUERIES = {}
PAIR = '"userID", "itemID"'
VIEWS = {
    "freq": 'SELECT "itemID", CAST(count(*) AS DOUBLE) AS n FROM train GROUP BY 1',
    "cooc": """SELECT a."itemID" AS i1, b."itemID" AS i2, count(*) AS c FROM train a JOIN train b
        ON a."userID" = b."userID" AND a."itemID" <= b."itemID" GROUP BY 1, 2""",
    "cooc_n": """SELECT i1, i2, c, f.n AS a, g.n AS b FROM cooc JOIN freq f ON f."itemID" = i1 JOIN freq g ON g."itemID" = i2""",
    "cosine": "SELECT i1, i2, c / sqrt(a * b) AS sim FROM cooc_n",
    "jaccard": "SELECT i1, i2, c / (a + b - c) AS sim FROM cooc_n",
    "sim_both": "SELECT i1 AS a, i2 AS b, sim FROM jaccard UNION ALL SELECT i2, i1, sim FROM jaccard WHERE i1 <> i2",
    "sar": """SELECT t."userID", s.b AS "itemID", round(sum(t.rating * s.sim), 10) AS score, sum(s.sim) AS unity,
        sum(t.rating * s.sim) AS raw FROM train t JOIN sim_both s ON s.a = t."itemID" GROUP BY 1, 2""",
    "sar_new": f"""SELECT * FROM sar s WHERE NOT EXISTS
        (SELECT 1 FROM train t WHERE t."userID" = s."userID" AND t."itemID" = s."itemID")""",
    "list_sim": """SELECT p."userID", avg(coalesce(s.sim, 0)) AS avg_il_sim FROM (
        SELECT a."userID", a."itemID" AS i1, b."itemID" AS i2 FROM reco a JOIN reco b
        ON a."userID" = b."userID" AND a."itemID" < b."itemID") p
        LEFT JOIN cosine s ON s.i1 = p.i1 AND s.i2 = p.i2 GROUP BY 1""",
    "novelty_items": """SELECT "itemID", -log2(count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE)) AS item_novelty
        FROM train GROUP BY 1""",
    "seren": """SELECT r."userID", r."itemID", 1 - avg(coalesce(s.sim, 0)) AS v FROM reco r JOIN train t ON t."userID" = r."userID"
        LEFT JOIN cosine s ON s.i1 = least(r."itemID", t."itemID") AND s.i2 = greatest(r."itemID", t."itemID") GROUP BY 1, 2""",
}


def add(name, text=None, **views):
    def keep(run):
        QUERIES[name] = (run, sql(text, **VIEWS, **views) if text else None)
        return run

    return keep


# ---------------------------------------------------------------- diversity


@add("cooccurrence_sim", "SELECT i1, i2, round(sim, 9) AS sim FROM cosine")
def cooccurrence_sim(spark, sf):
    return rounded(diversity.cooccurrence_sim(fx.train(spark, sf)), "sim", digits=9)


def _features(spark, sf):
    return fx.vectors(spark, sf).select(F.col("vec_id").alias(ITEM), F.col("v").alias("features"))


@add("item_feature_sim", """SELECT i1, i2, round(list_cosine_similarity(x.v, y.v), 6) AS sim FROM (
      SELECT DISTINCT a."itemID" AS i1, b."itemID" AS i2 FROM reco a JOIN reco b
      ON a."userID" = b."userID" AND a."itemID" <= b."itemID") JOIN vectors x ON x.vec_id = i1 JOIN vectors y ON y.vec_id = i2""")
def item_feature_sim(spark, sf):
    pairs = item_pairs(fx.reco(spark, sf), [USER], ITEM)
    return rounded(diversity.feature_sim(pairs, _features(spark, sf)), "sim")


@add("item_feature_pairs", "SELECT a AS i1, b AS i2, round(list_cosine_similarity(x, y), 6) AS sim FROM vector_pairs")
def item_feature_pairs(spark, sf):
    pairs = fx.vector_pairs(spark, sf).select(F.col("a").alias("i1"), F.col("b").alias("i2"))
    return rounded(diversity.feature_sim(pairs, _features(spark, sf)), "sim")


def _div(fn, *names, **options):
    return lambda spark, sf: rounded(fn(fx.train(spark, sf), fx.reco(spark, sf), **options), *names)


add("intralist_sim", 'SELECT "userID", round(avg_il_sim, 6) AS avg_il_sim FROM list_sim')(_div(diversity.intralist_sim, "avg_il_sim"))
add("user_diversity", 'SELECT "userID", round(1 - avg_il_sim, 6) AS user_diversity FROM list_sim')(
    _div(diversity.user_diversity, "user_diversity"))
add("diversity", "SELECT round(avg(1 - avg_il_sim), 6) AS diversity FROM list_sim")(_div(diversity.diversity))
add("user_item_serendipity", f"SELECT {PAIR}, round(v, 6) AS user_item_serendipity FROM seren")(
    _div(diversity.user_item_serendipity, "user_item_serendipity"))
add("user_serendipity", 'SELECT "userID", round(avg(v), 6) AS user_serendipity FROM seren GROUP BY 1')(
    _div(diversity.user_serendipity, "user_serendipity"))
add("serendipity", 'SELECT round(avg(v), 6) AS serendipity FROM (SELECT avg(v) AS v FROM seren GROUP BY "userID")')(
    _div(diversity.serendipity))
add("novelty", """SELECT round(sum(coalesce(item_novelty, 0)) / count(*), 6) AS novelty FROM reco r
    LEFT JOIN novelty_items n ON n."itemID" = r."itemID" """)(_div(diversity.novelty))
add("catalog_coverage", """SELECT round(count(DISTINCT "itemID") / CAST((SELECT count(DISTINCT "itemID") FROM train) AS DOUBLE), 6)
    AS catalog_coverage FROM reco""")(_div(diversity.catalog_coverage))


@add("diversity_features", """SELECT round(avg(d), 6) AS diversity FROM (
      SELECT p."userID", 1 - avg(coalesce(list_cosine_similarity(x.v, y.v), 0)) AS d FROM (
        SELECT a."userID", a."itemID" AS i1, b."itemID" AS i2 FROM reco a JOIN reco b
        ON a."userID" = b."userID" AND a."itemID" < b."itemID") p
      LEFT JOIN vectors x ON x.vec_id = i1 LEFT JOIN vectors y ON y.vec_id = i2 GROUP BY 1)""")
def diversity_features(spark, sf):
    return rounded(diversity.diversity(
        fx.train(spark, sf), fx.reco(spark, sf), features=_features(spark, sf), measure=diversity.FEATURES))


@add("item_novelty", 'SELECT "itemID", round(item_novelty, 6) AS item_novelty FROM novelty_items')
def item_novelty(spark, sf):
    return rounded(diversity.item_novelty(fx.train(spark, sf)), "item_novelty")


@add("distributional_coverage", """SELECT round(-sum(p * log2(p)), 6) AS distributional_coverage FROM (
    SELECT count(*) / CAST((SELECT count(*) FROM reco) AS DOUBLE) AS p FROM reco GROUP BY "itemID")""")
def distributional_coverage(spark, sf):
    return rounded(diversity.distributional_coverage(fx.reco(spark, sf)))


# ---------------------------------------------------------------- co-occurrence recommender


@add("affinity", f"SELECT {PAIR}, sum(rating) AS affinity FROM train GROUP BY 1, 2")
def affinity(spark, sf):
    return cooccur.affinity(fx.train(spark, sf))


@add("decayed_affinity", f"""SELECT {PAIR}, round(sum(rating * least(1.0, pow(0.5::DOUBLE, (newest - "timestamp") / 2592000.0))), 6) AS affinity
    FROM train, (SELECT max("timestamp") AS newest FROM train) GROUP BY 1, 2""")
def decayed_affinity(spark, sf):
    return rounded(cooccur.decayed_affinity(fx.train(spark, sf)), "affinity")


@add("cooccurrence", "SELECT i1, i2, c FROM cooc WHERE c >= 2")
def cooccurrence(spark, sf):
    return cooccur.cooccurrence(fx.train(spark, sf), 2)


_SIMS = {
    "sim_cooccurrence": ("cooccurrence", "CAST(c AS DOUBLE)"),
    "sim_cosine": ("cosine", "c / sqrt(a * b)"),
    "sim_inclusion": ("inclusion", "c / least(a, b)"),
    "sim_jaccard": ("jaccard", "c / (a + b - c)"),
    "sim_lift": ("lift", "c / (a * b)"),
    "sim_mi": ("mutual_information", "log2((SELECT count(*) FROM freq) * c / (a * b))"),
    "sim_lex_mi": ("lexicographers_mi", "c * log2((SELECT count(*) FROM freq) * c / (a * b))"),
}
for _name, (_kind, _expr) in _SIMS.items():
    def _sim(spark, sf, kind=_kind):
        return rounded(cooccur.item_similarity(fx.train(spark, sf), kind, 2), "sim", digits=9)

    add(_name, f"SELECT i1, i2, round({_expr}, 9) AS sim FROM cooc_n WHERE c >= 2")(_sim)


def _model(spark, sf):
    train = fx.train(spark, sf)
    return cooccur.affinity(train), cooccur.item_similarity(train, "jaccard")


@add("sar_scores", f"SELECT {PAIR}, round(score, 6) AS prediction FROM sar_new")
def sar_scores(spark, sf):
    aff, sim = _model(spark, sf)
    return rounded(cooccur.scores(aff, sim, fx.train(spark, sf)), PREDICTION)


@add("sar_normalized", f"""SELECT {PAIR}, round((raw - low * lo) / nullif(high * hi - low * lo, 0) * (hi - lo) + lo, 6) AS prediction
    FROM sar JOIN (SELECT "userID", CASE WHEN count(*) < (SELECT count(*) FROM freq) THEN least(min(unity), 0) ELSE min(unity) END AS low,
      max(unity) AS high FROM sar GROUP BY 1) USING ("userID"), (SELECT min(rating) AS lo, max(rating) AS hi FROM train)
    WHERE EXISTS (SELECT 1 FROM test t WHERE t."userID" = sar."userID" AND t."itemID" = sar."itemID")""")
def sar_normalized(spark, sf):
    """Normalised scores of the test pairs."""
    train = fx.train(spark, sf)
    aff, sim = _model(spark, sf)
    low, high = train.agg(F.min(RATING)).scalar(), train.agg(F.max(RATING)).scalar()
    n_items = train.agg(F.count_distinct(ITEM)).scalar()
    return rounded(cooccur.normalized_scores(aff, sim, low, high, n_items, wanted=fx.test(spark, sf)), PREDICTION)


@add("sar_topk", f"""SELECT {PAIR}, rank, round(score, 6) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY "userID"
    ORDER BY score DESC, "itemID") AS rank FROM sar_new) WHERE rank <= 10""")
def sar_topk(spark, sf):
    aff, sim = _model(spark, sf)
    out = cooccur.recommend_k_items(aff, sim, users=fx.test(spark, sf))
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), PREDICTION)


@add("sar_topk_mi", f"""SELECT {PAIR}, rank, round(score, 6) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY "userID"
      ORDER BY score DESC, "itemID") AS rank FROM (
        SELECT t."userID", s.b AS "itemID", round(sum(t.rating * s.sim), 10) AS score FROM train t JOIN mi_both s ON s.a = t."itemID" GROUP BY 1, 2) m
      WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."userID" = m."userID" AND t."itemID" = m."itemID")) WHERE rank <= 10""",
     mi="SELECT i1, i2, log2((SELECT count(*) FROM freq) * (c / (a * b))) AS sim FROM cooc_n",
     mi_both="SELECT i1 AS a, i2 AS b, sim FROM mi UNION ALL SELECT i2, i1, sim FROM mi WHERE i1 <> i2")
def sar_topk_mi(spark, sf):
    """A similarity that can be negative."""
    train = fx.train(spark, sf)
    out = cooccur.recommend_k_items(cooccur.affinity(train), cooccur.item_similarity(train, "mutual_information"))
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), PREDICTION)


@add("sar_topk_normalized", f"""SELECT {PAIR}, rank, round(prediction, 6) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY "userID"
      ORDER BY prediction DESC, "itemID") AS rank FROM (
        SELECT {PAIR}, round((raw - low * lo) / nullif(high * hi - low * lo, 0) * (hi - lo) + lo, 10) AS prediction
        FROM sar_new JOIN (SELECT "userID", CASE WHEN count(*) < (SELECT count(*) FROM freq) THEN least(min(unity), 0) ELSE min(unity) END AS low,
          max(unity) AS high FROM sar GROUP BY 1) USING ("userID"), (SELECT min(rating) AS lo, max(rating) AS hi FROM train))) WHERE rank <= 10""")
def sar_topk_normalized(spark, sf):
    train = fx.train(spark, sf)
    aff, sim = _model(spark, sf)
    low, high = train.agg(F.min(RATING)).scalar(), train.agg(F.max(RATING)).scalar()
    out = cooccur.recommend_k_items(aff, sim, normalize=(low, high, train.agg(F.count_distinct(ITEM)).scalar()))
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), PREDICTION)


@add("sar_predict", f"""SELECT t."userID", t."itemID", round(coalesce(score, 0), 6) AS prediction FROM test t
    LEFT JOIN sar s ON s."userID" = t."userID" AND s."itemID" = t."itemID" """)
def sar_predict(spark, sf):
    aff, sim = _model(spark, sf)
    return rounded(cooccur.predict(fx.test(spark, sf), aff, sim), PREDICTION)


@add("popular_items", 'SELECT "itemID", CAST(n AS BIGINT) AS n FROM freq ORDER BY n DESC, "itemID" LIMIT 10')
def popular_items(spark, sf):
    return cooccur.popular_items(fx.train(spark, sf))


@add("active_users", 'SELECT "userID", count(*) AS n FROM train GROUP BY 1 ORDER BY n DESC, "userID" LIMIT 10')
def active_users(spark, sf):
    return cooccur.active_users(fx.train(spark, sf))


@add("seed_topk", """SELECT * FROM (SELECT "userID", "itemID", round(score, 6) AS prediction,
      row_number() OVER (PARTITION BY "userID" ORDER BY score DESC, "itemID") AS rank FROM (
        SELECT r."userID", s.b AS "itemID", round(sum(s.sim), 10) AS score FROM reco r JOIN sim_both s ON s.a = r."itemID" GROUP BY 1, 2) x
      WHERE NOT EXISTS (SELECT 1 FROM reco r WHERE r."userID" = x."userID" AND r."itemID" = x."itemID")) WHERE rank <= 10""")
def seed_topk(spark, sf):
    """The recommended list of each user as its seeds."""
    _, sim = _model(spark, sf)
    out = cooccur.seed_topk(fx.reco(spark, sf), sim)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), PREDICTION)


@add("similar_users", """SELECT o."userID", round(sum(o.rating * m.rating), 10) AS similarity FROM train o JOIN train m
    ON m."itemID" = o."itemID" AND m."userID" = 7 AND o."userID" <> 7 GROUP BY 1 ORDER BY similarity DESC, "userID" LIMIT 10""")
def similar_users(spark, sf):
    return cooccur.similar_users(cooccur.affinity(fx.train(spark, sf)), 7)
