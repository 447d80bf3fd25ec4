"""Registered queries: filters, id maps, splits, negative sampling and candidates."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, TIMESTAMP, USER, item_pairs, stable, unit_hash
from preflens.operators import candidates, negatives, prep, split
from preflens.plans import fixtures as fx
from preflens.plans.evaluation import rounded
from preflens.plans.fixtures import h, sql

QUERIES = {}
PAIR = '"userID", "itemID"'


def add(name, text=None, **views):
    def keep(run):
        QUERIES[name] = (run, sql(text, **views) if text else None)
        return run

    return keep


# ---------------------------------------------------------------- filters and ids

for _by, _n in (("user", 40), ("item", 30)):
    def _filtered(spark, sf, by=_by, n=_n):
        return prep.min_rating_filter(fx.interactions(spark, sf), n, by).select(USER, ITEM)

    add(f"min_rating_{_by}", f"""SELECT {PAIR} FROM interactions WHERE "{_by}ID" IN
        (SELECT "{_by}ID" FROM interactions GROUP BY 1 HAVING count(*) >= {_n})""")(_filtered)

CORE, ROUNDS = 20, 30
_core = {"core_0": f"SELECT {PAIR} FROM interactions"}
for _i in range(1, ROUNDS + 1):
    _core[f"core_{_i}a"] = f"""SELECT * FROM core_{_i - 1} WHERE "itemID" IN
        (SELECT "itemID" FROM core_{_i - 1} GROUP BY 1 HAVING count(*) >= {CORE})"""
    _core[f"core_{_i}"] = f"""SELECT * FROM core_{_i}a WHERE "userID" IN
        (SELECT "userID" FROM core_{_i}a GROUP BY 1 HAVING count(*) >= {CORE})"""


@add("k_core", f"SELECT {PAIR} FROM core_{ROUNDS}", **_core)
def k_core(spark, sf):
    return prep.k_core(fx.interactions(spark, sf).select(USER, ITEM), CORE)


@add("anti_filter", f"""SELECT {PAIR} FROM interactions i WHERE NOT EXISTS
    (SELECT 1 FROM test t WHERE t."userID" = i."userID" AND t."itemID" = i."itemID")""")
def anti_filter(spark, sf):
    return prep.anti_filter(fx.interactions(spark, sf), fx.test(spark, sf), [USER, ITEM]).select(USER, ITEM)


@add("index_ids", """SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS "index" FROM (SELECT DISTINCT p_name FROM part)""")
def index_ids(spark, sf):
    return prep.index_ids(fx.table(spark, sf, "part"), "p_name")


@add("index_interactions", """SELECT u."index" AS user_index, i."index" AS item_index, rating FROM interactions
    JOIN (SELECT "userID", row_number() OVER (ORDER BY "userID") - 1 AS "index" FROM (SELECT DISTINCT "userID" FROM interactions)) u
      USING ("userID")
    JOIN (SELECT "itemID", row_number() OVER (ORDER BY "itemID") - 1 AS "index" FROM (SELECT DISTINCT "itemID" FROM interactions)) i
      USING ("itemID")""")
def index_interactions(spark, sf):
    return prep.index_interactions(fx.interactions(spark, sf))


@add("vocab_items", """SELECT "itemID", count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, "itemID") AS "index"
    FROM interactions GROUP BY 1""")
def vocab_items(spark, sf):
    return prep.vocab(fx.interactions(spark, sf), ITEM)


@add("binarize", f"SELECT {PAIR}, CASE WHEN rating > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM interactions")
def binarize(spark, sf):
    return fx.interactions(spark, sf).select(USER, ITEM, prep.binarize(RATING, 25).alias("label"))


@add("rescale", f"""SELECT {PAIR}, round((rating - lo) / (hi - lo) * 4 + 1, 6) AS rescaled FROM interactions,
    (SELECT min(rating) AS lo, max(rating) AS hi FROM interactions)""")
def rescale(spark, sf):
    return rounded(prep.rescale(fx.interactions(spark, sf), RATING, 1, 5).select(USER, ITEM, "rescaled"), "rescaled")


@add("time_decay", f"""SELECT {PAIR}, round(least(1.0, pow(0.5::DOUBLE, (newest - "timestamp") / 2592000.0)), 6) AS weight
    FROM interactions, (SELECT max("timestamp") AS newest FROM interactions)""")
def time_decay(spark, sf):
    df = fx.interactions(spark, sf)
    weight = prep.exponential_decay(TIMESTAMP, df.agg(F.max(TIMESTAMP)).scalar(), 30 * 86400)
    return rounded(df.select(USER, ITEM, weight.alias("weight")), "weight")


@add("mean_center", f"""SELECT {PAIR}, round(rating - (SELECT avg(rating) FROM train), 6) AS centered FROM interactions""")
def mean_center(spark, sf):
    out = prep.mean_center(fx.interactions(spark, sf), fx.train(spark, sf))
    return rounded(out.select(USER, ITEM, "centered"), "centered")


@add("sparsity", """SELECT n_cells, n_users, n_items, round((1 - n_cells / (CAST(n_users AS DOUBLE) * n_items)) * 100, 6) AS sparsity
    FROM (SELECT count(*) AS n_cells, count(DISTINCT "userID") AS n_users, count(DISTINCT "itemID") AS n_items FROM interactions)""")
def sparsity(spark, sf):
    return rounded(prep.sparsity(fx.interactions(spark, sf)), "sparsity")


@add("user_item_sets", """SELECT "userID", string_agg(CAST("itemID" AS VARCHAR), ',' ORDER BY "itemID") AS items FROM interactions GROUP BY 1""")
def user_item_sets(spark, sf):
    out = prep.user_item_sets(fx.interactions(spark, sf))
    return out.withColumn("items", F.concat_ws(",", F.col("items").cast("array<string>")))


@add("normalize_rating", f"""SELECT {PAIR}, round(rating / sqrt(hi * (hi + 1) * (2 * hi + 1) / 6 - (lo - 1) * lo * (2 * lo - 1) / 6), 9) AS target,
    CASE WHEN rating > 3 THEN 1 ELSE 0 END AS liked FROM interactions, (SELECT min(rating) AS lo, max(rating) AS hi FROM interactions)""")
def normalize_rating(spark, sf):
    out = prep.normalize_rating(fx.interactions(spark, sf)).withColumn("liked", prep.like_target(RATING))
    return rounded(out.select(USER, ITEM, "target", "liked"), "target", digits=9)


# ---------------------------------------------------------------- splits

_SHARES = [0.7, 0.2, 0.1]
_b = list(accumulate(split.split_ratio(_SHARES)))


@add("random_split_sizes", f"""SELECT CASE WHEN s <= {_b[0]!r} THEN 0 WHEN s <= {_b[1]!r} THEN 1 ELSE 2 END AS part, count(*) AS n
    FROM (SELECT 1 - {h('42', PAIR)} AS s FROM interactions) GROUP BY 1""")
def random_split_sizes(spark, sf):
    parts = split.random_split(fx.interactions(spark, sf), _SHARES)
    sizes = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("part"), "n") for i, p in enumerate(parts)]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@add("stratified_split", f"""SELECT {PAIR} FROM (SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY {h('42', PAIR)}, "itemID")
    / CAST(count(*) OVER (PARTITION BY "userID") AS DOUBLE) AS share FROM interactions) WHERE share <= 0.75""")
def stratified_split(spark, sf):
    return split.stratified_split(fx.interactions(spark, sf), 0.75)[0].select(USER, ITEM)


@add("stratified_split_item", f"""SELECT {PAIR} FROM (SELECT *, row_number() OVER (PARTITION BY "itemID" ORDER BY {h('42', PAIR)}, "userID")
    / CAST(count(*) OVER (PARTITION BY "itemID") AS DOUBLE) AS share FROM interactions WHERE "itemID" IN
      (SELECT "itemID" FROM interactions GROUP BY 1 HAVING count(*) >= 25)) WHERE share > 0.75""")
def stratified_split_item(spark, sf):
    return split.stratified_split(fx.interactions(spark, sf), 0.75, 25, "item")[1].select(USER, ITEM)


for _part in ("train", "test"):
    def _chrono(spark, sf, part=_part):
        return getattr(fx, part)(spark, sf)

    add(f"chrono_split_{_part}", f"SELECT * FROM {_part}")(_chrono)


@add("timestamp_split", f"""SELECT {PAIR} FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", "userID", "itemID")
    / CAST(count(*) OVER () AS DOUBLE) AS share FROM interactions) WHERE share <= 0.75""")
def timestamp_split(spark, sf):
    return split.timestamp_split(fx.interactions(spark, sf))[0].select(USER, ITEM)


@add("cell_split_counts", f"""SELECT "userID", n - CAST(round_even(n * 25 / 100.0::DOUBLE, 0) AS BIGINT) AS n_train,
    CAST(round_even(n * 25 / 100.0::DOUBLE, 0) AS BIGINT) AS n_test
    FROM (SELECT "userID", count(*) AS n FROM interactions WHERE rating <> 0 GROUP BY 1)""")
def cell_split_counts(spark, sf):
    first, second = split.cell_split(fx.interactions(spark, sf))
    both = first.withColumn("t", F.lit(0)).unionByName(second.withColumn("t", F.lit(1)))
    return both.groupBy(USER).agg(F.count_if(F.col("t") == 0).alias("n_train"), F.count_if(F.col("t") == 1).alias("n_test"))


@add("leave_last_out", f"""SELECT {PAIR}, CASE WHEN n < 3 THEN 'train' WHEN r = 1 THEN 'test' WHEN r = 2 THEN 'valid' ELSE 'train' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID" DESC) AS r,
      count(*) OVER (PARTITION BY "userID") AS n FROM interactions)""")
def leave_last_out(spark, sf):
    return split.leave_last_out(fx.interactions(spark, sf), [TIMESTAMP, ITEM]).select(USER, ITEM, "part")


@add("sample_items", f"""SELECT {PAIR} FROM interactions WHERE "itemID" IN (SELECT "itemID" FROM (
      SELECT "itemID", row_number() OVER (ORDER BY -ln(greatest({h('42', '"itemID"')}, 2.0 ** -52)) / n, "itemID") AS r, count(*) OVER () AS total
      FROM (SELECT "itemID", count(*) AS n FROM interactions GROUP BY 1)) WHERE r <= floor(total * 0.1::DOUBLE))""")
def sample_items(spark, sf):
    return split.sample_items(fx.interactions(spark, sf), 0.1).select(USER, ITEM)


# ---------------------------------------------------------------- negatives

def permuted(place: str) -> str:
    """SQL of the keyed permutation of [0, pool): six rounds on the rectangle a x b, then up to 16 steps along the cycle."""
    def rounds(x, s, r):
        key = f"((k3 + {r} * k4) % 2147483647)"
        half = f"(CASE WHEN {r} % 2 = 0 THEN {s} % b ELSE {s} // b END)"
        first = f"(({half} * (1 + (k1 + {r} * k2) % 2147483646) + {key}) % 2147483647)"
        drawn = f"(({first} * {first} + {key}) % 2147483647)"
        moved = f"CASE WHEN {r} % 2 = 0 THEN (({s} // b + {drawn}) % a) * b + {s} % b ELSE ({s} // b) * b + ({s} % b + {drawn}) % b END"
        return f"list_reduce([{x}, 0, 1, 2, 3, 4, 5], lambda {s}, {r}: {moved})"

    return f"list_reduce(list_concat([{rounds(place, 's', 'r')}], range(16)), lambda x, i: CASE WHEN x < pool THEN x ELSE {rounds('x', 't', 'q')} END)"


def unseen_views(seen: str, pool: str, need: str, keys: str = "", replace: bool = False) -> dict[str, str]:
    """SQL for ``draw_unseen``: view drawn has the user, the keys, j and the item."""
    names = f'"userID"{", " + keys if keys else ""}'
    seeds = [c.strip() for c in names.split(",")]
    if replace:
        p = f"CAST(floor({h('42', *seeds, 'j')} * pool) AS BIGINT)"
        n = "n"
    else:
        n = "least(n, pool)"
        p = permuted("j")
    return {
        "pool": f'SELECT "itemID", row_number() OVER (ORDER BY "itemID") - 1 AS idx FROM (SELECT DISTINCT "itemID" FROM {pool})',
        "seen_at": f"""SELECT s."userID", idx - (row_number() OVER (PARTITION BY s."userID" ORDER BY idx) - 1) AS t
            FROM (SELECT DISTINCT {PAIR} FROM {seen}) s JOIN pool ON s."itemID" = pool."itemID" """,
        "sizes": 'SELECT "userID", (SELECT count(*) FROM pool) - count(*) AS pool FROM seen_at GROUP BY 1',
        "need": need,
        "js": f"""SELECT *, unnest(range({n})) AS j FROM (SELECT *, (pool + a - 1) // a AS b FROM (SELECT *,
            CAST(ceil(sqrt(pool::DOUBLE)) AS BIGINT) AS a, {", ".join(f"CAST(floor({h('42', *seeds, chr(39) + k + chr(39))} * 2147483646) AS BIGINT) AS {k}" for k in ("k1", "k2", "k3", "k4"))}
            FROM need JOIN sizes USING ("userID") WHERE pool > 0))""",
        "positions": f"SELECT {names}, j, {p} AS p FROM js",
        "placed": f"""SELECT d.*, count(t.t) AS before FROM positions d LEFT JOIN seen_at t
            ON t."userID" = d."userID" AND t.t <= d.p GROUP BY ALL""",
        "drawn": 'SELECT placed.* EXCLUDE (before, p), pool."itemID" FROM placed JOIN pool ON placed.p + before = pool.idx',
    }


@add("neg_feedback", f"""SELECT {PAIR}, 1 AS feedback FROM train UNION ALL SELECT {PAIR}, 0 FROM drawn""",
     **unseen_views("train", "train", 'SELECT "userID", greatest(CAST(round_even(count(*) * 1.0::DOUBLE, 0) AS BIGINT), 1) AS n FROM train GROUP BY 1'))
def neg_feedback(spark, sf):
    return negatives.negative_feedback(fx.train(spark, sf))


@add("neg_per_positive", f"""SELECT {PAIR}, 1 AS label FROM train UNION ALL SELECT {PAIR}, 0 FROM drawn""",
     **unseen_views("train", "train", 'SELECT "userID", count(*) * 4 AS n FROM train GROUP BY 1'))
def neg_per_positive(spark, sf):
    return negatives.negatives_per_positive(fx.train(spark, sf), 4)


@add("neg_with_replacement", f"""SELECT {PAIR}, 1 AS label FROM train UNION ALL SELECT {PAIR}, 0 FROM drawn""",
     **unseen_views("train", "train", 'SELECT "userID", count(*) * 4 AS n FROM train GROUP BY 1', replace=True))
def neg_with_replacement(spark, sf):
    return negatives.negatives_per_positive(fx.train(spark, sf), 4, replace=True)


@add("loo_test_batches", f"""SELECT {PAIR}, batch, 1 AS label FROM batches UNION ALL SELECT {PAIR}, batch, 0 FROM drawn""",
     batches=f"""SELECT {PAIR}, row_number() OVER (ORDER BY {PAIR}) - 1 AS batch FROM test
       WHERE "userID" IN (SELECT "userID" FROM train)""",
     **unseen_views("interactions", "train", 'SELECT "userID", batch, 100 AS n FROM batches', "batch"))
def loo_test_batches(spark, sf):
    return negatives.loo_test_batches(fx.train(spark, sf), fx.test(spark, sf), 100)


@add("bpr_triples", """SELECT p."userID", p.pos, d."itemID" AS neg FROM (SELECT "userID", arg_min("itemID", """
     + h("42", PAIR) + """) AS pos FROM train GROUP BY 1) p JOIN drawn d ON p."userID" = d."userID" """,
     **unseen_views("train", "train", 'SELECT DISTINCT "userID", 1 AS n FROM train'))
def bpr_triples(spark, sf):
    return negatives.bpr_triples(fx.train(spark, sf))


_HIST = 'SELECT t."itemID", p_type AS cate FROM train t JOIN part ON p_partkey = t."itemID"'


@add("pop_negatives", """SELECT "userID", "itemID", neg, cate, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY "userID", "itemID" ORDER BY j) AS rank FROM (
        SELECT d."userID", d."itemID", s."itemID" AS neg, s.cate, min(d.j) AS j FROM draws d JOIN spans s
        ON d.at >= s.low AND d.at < s.high WHERE s."itemID" <> d."itemID" GROUP BY 1, 2, 3, 4)) WHERE rank <= 4""",
     hist=_HIST,
     spans="""SELECT "itemID", cate, CAST(sum(n) OVER (ORDER BY "itemID") - n AS BIGINT) AS low,
       CAST(sum(n) OVER (ORDER BY "itemID") AS BIGINT) AS high FROM (SELECT "itemID", min(cate) AS cate, count(*) AS n FROM hist GROUP BY 1)""",
     draws=f"""SELECT {PAIR}, j, CAST(floor({h('42', PAIR, 'j')} * (SELECT count(*) FROM hist)) AS BIGINT) AS at
       FROM (SELECT {PAIR}, unnest(range(64)) AS j FROM test)""")
def pop_negatives(spark, sf):
    types = fx.table(spark, sf, "part").select(F.col("p_partkey").alias(ITEM), F.col("p_type").alias("cate"))
    history = fx.train(spark, sf).join(types, ITEM)
    return negatives.popularity_negatives(fx.test(spark, sf), history, 4)


_IMP = """SELECT p.grp AS imp, p.item AS pos, j, n.item AS neg FROM (
      SELECT grp, item, unnest(range(4)) AS j FROM line_scores WHERE label = 1) p
    JOIN (SELECT grp, count(*) AS n FROM line_scores WHERE label = 0 GROUP BY 1) s ON p.grp = s.grp
    JOIN (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY """ + h("42", "grp", "item") + """, item) - 1 AS i
      FROM line_scores WHERE label = 0) n ON n.grp = p.grp AND n.i = (CAST(floor(""" + h("42", "p.grp", "p.item") + """ * s.n) AS BIGINT) + j) % s.n"""


@add("impression_negatives", _IMP)
def impression_negatives(spark, sf):
    rows = fx.line_scores(spark, sf).withColumnRenamed("grp", "imp")
    return negatives.impression_negatives(rows, 4).withColumn("j", F.col("j").cast("long"))


@add("impression_negatives_padded", """SELECT p.grp AS imp, p.item AS pos, j, n.item AS neg FROM (
      SELECT grp, item, unnest(range(4)) AS j FROM line_scores WHERE label = 1) p
    LEFT JOIN (SELECT grp, count(*) AS n FROM line_scores WHERE label = 0 GROUP BY 1) s ON p.grp = s.grp
    LEFT JOIN (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY """ + h("42", "grp", "item") + """, item) - 1 AS i
      FROM line_scores WHERE label = 0) n ON n.grp = p.grp AND j < s.n
      AND n.i = (CAST(floor(""" + h("42", "p.grp", "p.item") + """ * s.n) AS BIGINT) + j) % s.n""")
def impression_negatives_padded(spark, sf):
    rows = fx.line_scores(spark, sf).withColumnRenamed("grp", "imp")
    return negatives.impression_negatives(rows, 4, pad=True).withColumn("j", F.col("j").cast("long"))


# ---------------------------------------------------------------- candidates


@add("candidates_unseen", f"""SELECT {PAIR}, rank FROM (SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY s DESC, "itemID") AS rank
    FROM (SELECT {PAIR}, {h('p', PAIR)} AS s FROM (SELECT {PAIR} FROM interactions UNION SELECT {PAIR} FROM distractors) a
      WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."userID" = a."userID" AND t."itemID" = a."itemID"))) WHERE rank <= 10""")
def candidates_unseen(spark, sf):
    pairs = fx.interactions(spark, sf).select(USER, ITEM).union(fx.distractors(spark, sf)).distinct()
    out = candidates.candidates_unseen(pairs.withColumn(PREDICTION, unit_hash("p", USER, ITEM)), fx.train(spark, sf))
    return out.select(USER, ITEM, F.col("rank").cast("long"))


@add("pairwise_items", """SELECT a."userID", a."itemID" AS i1, b."itemID" AS i2 FROM reco a JOIN reco b
    ON a."userID" = b."userID" AND a."itemID" <= b."itemID" """)
def pairwise_items(spark, sf):
    return item_pairs(fx.reco(spark, sf), [USER], ITEM)


@add("dot_score_topk", """SELECT "userID", "itemID", rank, round(s, 6) AS prediction FROM (
      SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY s DESC, "itemID") AS rank FROM (
        SELECT l.vec_id AS "userID", r.vec_id AS "itemID", list_inner_product(l.v, r.v) AS s FROM vectors l, vectors r
        WHERE l.vec_id <> r.vec_id AND NOT (r.vec_id BETWEEN l.vec_id + 1 AND l.vec_id + 20))) WHERE rank <= 10""")
def dot_score_topk(spark, sf):
    v = fx.vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))
    out = candidates.dot_score_topk(v, v, 10, fx.vector_pairs(spark, sf).select("a", "b"), drop_same=True)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), PREDICTION)


@add("binarize_mean", f"SELECT {PAIR}, CAST(prediction > (SELECT avg(prediction) FROM rank_pred) AS INTEGER) AS label FROM rank_pred")
def binarize_mean(spark, sf):
    return candidates.binarize_mean(fx.rank_pred(spark, sf)).select(USER, ITEM, "label")


@add("binarize_topk", f"""SELECT {PAIR}, CAST(row_number() OVER (PARTITION BY "userID" ORDER BY prediction DESC, "itemID") <= 10 AS INTEGER) AS label
    FROM rank_pred""")
def binarize_topk(spark, sf):
    return candidates.binarize_topk(fx.rank_pred(spark, sf)).select(USER, ITEM, "label")


@add("similar_vectors", """SELECT vec_id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 0)), 6) AS similarity
    FROM vectors WHERE vec_id <> 0
    ORDER BY list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 0)) DESC, vec_id LIMIT 10""")
def similar_vectors(spark, sf):
    return rounded(candidates.similar_vectors(fx.vectors(spark, sf), 0, 10, "vec_id", "v"), "similarity")


@add("als_topk")
def als_topk(spark, sf):
    train = stable(fx.train(spark, sf).select(USER, ITEM, RATING))  # read by the fit and as seen pairs
    return rounded(candidates.als_topk(train), PREDICTION, digits=4)


@add("als_topk_shape", """SELECT "userID", least(10, (SELECT count(DISTINCT "itemID") FROM train) - count(*)) AS n,
      least(10, (SELECT count(DISTINCT "itemID") FROM train) - count(*)) AS last_rank, 0 AS seen FROM train GROUP BY 1""")
def als_topk_shape(spark, sf):
    """What every list of the factor model has to keep: k different unseen items per user, ranked 1 to k."""
    train = stable(fx.train(spark, sf).select(USER, ITEM, RATING))
    out = candidates.als_topk(train).join(train.select(USER, ITEM, F.lit(1).alias("_seen")), [USER, ITEM], "left")
    return out.groupBy(USER).agg(
        F.count_distinct(ITEM).alias("n"), F.max("rank").cast("long").alias("last_rank"), F.coalesce(F.sum("_seen").cast("int"), F.lit(0)).alias("seen"))
