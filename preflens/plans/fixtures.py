"""Views over the driver tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, TIMESTAMP, USER, lanes, stable, top_k, unit_hash
from preflens.operators.split import chrono_split

N_DISTRACTORS = 30
LINES_PER_TASK = 150_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@cache
def interactions(spark, sf):
    """Made once: most queries read it several times."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias(ITEM), "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias(USER), "o_orderdate")
    return stable(
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(USER, ITEM)
        .agg(
            F.sum("l_quantity").alias(RATING),
            F.unix_seconds(F.max("o_orderdate").cast("timestamp")).alias(TIMESTAMP),
        )
    )


@cache
def train_test(spark, sf):
    return [stable(part) for part in chrono_split(interactions(spark, sf), [0.75, 0.25])]


def train(spark, sf):
    return train_test(spark, sf)[0]


def test(spark, sf):
    return train_test(spark, sf)[1]


def rating_pred(spark, sf):
    score = (F.lit(1) + F.pmod(F.col(USER) * 7 + F.col(ITEM) * 13, F.lit(50))).cast("double")
    return interactions(spark, sf).select(USER, ITEM, score.alias(PREDICTION))


@cache
def distractors(spark, sf):
    """30 pseudo-random items per training user, without the ones in train."""
    known = train(spark, sf).select(USER, ITEM)
    n_items = table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    draws = known.select(USER).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(N_DISTRACTORS - 1))))
    draws = draws.select(USER, F.pmod(F.col(USER) * 31 + F.col("n") * 67, n_items).alias(ITEM)).distinct()
    return draws.join(known, [USER, ITEM], "left_anti")


@cache
def rank_pred(spark, sf):
    pairs = test(spark, sf).select(USER, ITEM).union(distractors(spark, sf)).distinct()
    return pairs.withColumn(PREDICTION, unit_hash("p", USER, ITEM))


@cache
def reco(spark, sf):
    ordered = [unit_hash("r", USER, ITEM).desc(), F.col(ITEM)]
    return top_k(distractors(spark, sf), [USER], ordered, 10).select(USER, ITEM)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def vector_pairs(spark, sf):
    """Each vector with the next 20 by id; edge = same label."""
    v = vectors(spark, sf)
    left = v.select(F.col("vec_id").alias("a"), F.col("v").alias("x"), F.col("label").alias("la"))
    left = left.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 20)))
    right = v.select(F.col("vec_id").alias("b"), F.col("v").alias("y"), F.col("label").alias("lb"))
    return left.join(right, "b").select("a", "b", "x", "y", (F.col("la") == F.col("lb")).cast("int").alias("edge"))


def line_scores(spark, sf):
    """Binary labels with a score, grouped by order."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("grp"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        unit_hash("s", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("score"),
        F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("supp"),
    )


def sequences(spark, sf):
    """User event sequences: item = event_id % 50, category = event type."""
    ev = table(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias(USER),
        F.pmod("event_id", F.lit(50)).alias(ITEM),
        F.col("event_type").alias("cate"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias(TIMESTAMP),
        "event_id",
        "value",
    )


@cache
def related(spark, sf):
    """Product metadata: for each part, the parts of the same order by return flag."""
    rel = (
        F.when(F.col("l_returnflag") == "N", "also_bought")
        .when(F.col("l_returnflag") == "A", "also_viewed")
        .otherwise("bought_together")
    )
    lines = table(spark, sf, "lineitem")
    parts = lanes(spark, lines.count(), LINES_PER_TASK)
    # An order's lines travel as one list to each of its parts; pairs are made there, and all grouping is by part.
    li = lines.filter("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL").repartition(parts, "l_orderkey")
    orders = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("other"), rel.alias("relation"))).alias("_lines"))
    sent = orders.select(F.explode(F.array_distinct("_lines.other")).alias("p_partkey"), "_lines").repartition(parts, "p_partkey")
    pairs = sent.select("p_partkey", F.explode("_lines").alias("_o")).select("p_partkey", "_o.*").filter(F.col("p_partkey") != F.col("other"))
    lists = pairs.groupBy("p_partkey", "relation").agg(F.sort_array(F.collect_set(F.col("other").cast("string"))).alias("items"))
    maps = lists.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("relation", "items"))).alias("related"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"))
    return part.join(maps, "p_partkey", "left").select(F.col("p_partkey").cast("string").alias("asin"), "title", "related")


# ---------------------------------------------------------------- the same views in SQL


def h(seed: str, *cols: str) -> str:
    cols = [c.strip() for some in cols for c in some.split(",")]
    parts = ", ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0)"


VIEWS: dict[str, str] = {
    "interactions": """SELECT o_custkey AS "userID", l_partkey AS "itemID", sum(l_quantity) AS rating,
        CAST(epoch(max(o_orderdate)) AS BIGINT) AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp", "itemID")
        / CAST(count(*) OVER (PARTITION BY "userID") AS DOUBLE) AS q FROM interactions""",
    "train": 'SELECT "userID", "itemID", rating, "timestamp" FROM ranked WHERE q <= 0.75',
    "test": 'SELECT "userID", "itemID", rating, "timestamp" FROM ranked WHERE q > 0.75',
    "rating_pred": """SELECT "userID", "itemID", CAST(1 + (("userID" * 7 + "itemID" * 13) % 50) AS DOUBLE) AS prediction
        FROM interactions""",
    "distractors": """SELECT DISTINCT d."userID", d."itemID" FROM (
          SELECT u."userID", (u."userID" * 31 + n.n * 67) % (SELECT count(*) FROM part) AS "itemID"
          FROM (SELECT DISTINCT "userID" FROM train) u CROSS JOIN range(30) n(n)) d
        WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."userID" = d."userID" AND t."itemID" = d."itemID")""",
    "rank_pred": f"""SELECT "userID", "itemID", {h('p', '"userID"', '"itemID"')} AS prediction
        FROM (SELECT "userID", "itemID" FROM test UNION SELECT "userID", "itemID" FROM distractors)""",
    "reco": f"""SELECT "userID", "itemID" FROM (SELECT *, row_number() OVER (PARTITION BY "userID"
        ORDER BY {h('r', '"userID"', '"itemID"')} DESC, "itemID") rk FROM distractors) WHERE rk <= 10""",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "vector_pairs": """SELECT l.vec_id AS a, r.vec_id AS b, l.v AS x, r.v AS y, CAST(l.label = r.label AS INTEGER) AS edge
        FROM vectors l JOIN vectors r ON r.vec_id BETWEEN l.vec_id + 1 AND l.vec_id + 20""",
    "line_scores": f"""SELECT l_orderkey AS grp, l_linenumber AS line, CAST(l_returnflag = 'R' AS INTEGER) AS label,
        {h('s', 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')} AS score, l_partkey AS item, l_suppkey AS supp
        FROM lineitem""",
    "sequences": """SELECT user_id AS "userID", event_id % 50 AS "itemID", event_type AS cate,
        CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", event_id, value FROM events""",
    "line_rel": """SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'N' THEN 'also_bought'
        WHEN 'A' THEN 'also_viewed' ELSE 'bought_together' END AS relation FROM lineitem""",
    "rel_rows": """SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS product1, b.relation,
        CAST(b.l_partkey AS VARCHAR) AS product2
        FROM line_rel a JOIN line_rel b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey""",
    "related_rows": """SELECT * FROM rel_rows WHERE product1 IN (SELECT product1 FROM rel_rows
        WHERE relation = 'also_bought' GROUP BY 1 HAVING count(*) >= 2)""",
}


def sql(body: str, **extra: str) -> str:
    """Put the views a query names (and the ones those name) in front of it as CTEs."""
    views = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf'\b(?:FROM|JOIN)\s+{name}\b', text, re.I):
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    texts = [body, *(views[n] for n in needed)]

    def kind(name: str) -> str:
        uses = sum(len(re.findall(rf'\b{name}\b(?!\s*\()', t)) for t in texts)
        return "AS MATERIALIZED" if uses > 1 else "AS"  # computed once

    return "WITH " + ",\n".join(f"{n} {kind(n)} ({views[n]})" for n in needed) + "\n" + body
