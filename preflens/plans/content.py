"""Registered queries: text, vectors and the item graph."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from preflens.frames import ITEM, TIMESTAMP, USER, rank_rows, stable
from preflens.operators import graph, negatives, text, vectors
from preflens.plans import fixtures as fx
from preflens.plans.evaluation import auc_sql, rounded
from preflens.plans.fixtures import h, sql

QUERIES = {}
STOP_WORDS = ("the", "of", "and", "la", "le", "der", "die", "el")
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def cleaned(column: str, normal: bool = True) -> str:
    out = f"nfc_normalize({column})" if normal else column
    for pattern, new in ((r"<.*?>", ""), (r"[\n\t\r]", " "), ("Â ", ""), (r"[^\s\p{Z}\p{L}\p{N}]+", "")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"coalesce(lower({out}), '')"


VIEWS = {
    "tokens": f"""SELECT doc_id, list_filter(regexp_extract_all({cleaned('text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda t: NOT list_contains({_STOP}, t)) AS toks FROM documents""",
    "grams": """SELECT doc_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]),
        list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]))) AS term FROM tokens""",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2",
    "dfreq": "SELECT term, count(*) AS df FROM tf GROUP BY 1",
    "raw_w": """SELECT doc_id, term, df, tf * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w
        FROM tf JOIN dfreq USING (term)""",
    "weights": """SELECT r.doc_id, term, df, w / len AS weight FROM raw_w r JOIN
        (SELECT doc_id, sqrt(sum(w * w)) AS len FROM raw_w GROUP BY 1) l ON l.doc_id = r.doc_id""",
    "doc_sims": """SELECT a.doc_id, b.doc_id AS other, round(sum(a.weight * b.weight), 9) AS similarity
        FROM weights a JOIN weights b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2""",
    "doc_best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, other) AS rank
        FROM doc_sims) WHERE rank <= 5""",
    "words": """SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM
        (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM documents)""",
    "word_ids": """SELECT token, row_number() OVER (ORDER BY f) AS "index" FROM
        (SELECT token, min({'d': doc_id, 'p': pos}) AS f FROM words GROUP BY 1)""",
    "edges": """SELECT least(product1, product2) AS product1, greatest(product1, product2) AS product2,
        sum(CASE relation WHEN 'bought_together' THEN 1.2::DOUBLE WHEN 'also_bought' THEN 1.0 ELSE 0.5 END) AS weight
        FROM related_rows GROUP BY 1, 2""",
    "ways": "SELECT product1 AS node, product2 AS next, weight FROM edges UNION ALL SELECT product2, product1, weight FROM edges WHERE product1 <> product2",
    "walks": """SELECT "userID" AS walk, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp", event_id) - 1 AS step,
        "itemID" AS node FROM sequences""",
    "node_freq": "SELECT node, count(*) AS freq FROM walks GROUP BY 1",
    "kept": """SELECT node, (sqrt(p / 0.001) + 1) * (0.001 / p) AS keep_prob FROM (
        SELECT node, freq / CAST((SELECT sum(freq) FROM node_freq) AS DOUBLE) AS p FROM node_freq)""",
    "adj": """SELECT t."userID", t."itemID", pow(u.n + 1e-9, -0.5) * pow(i.n + 1e-9, -0.5) AS value FROM train t
        JOIN (SELECT "userID", count(*) AS n FROM train GROUP BY 1) u ON u."userID" = t."userID"
        JOIN (SELECT "itemID", count(*) AS n FROM train GROUP BY 1) i ON i."itemID" = t."itemID" """,
}


def add(name, text_=None, **views):
    def keep(run):
        QUERIES[name] = (run, sql(text_, **{**VIEWS, **views}) if text_ else None)
        return run

    return keep


# ---------------------------------------------------------------- text


def _documents(spark, sf):
    """Text is costly per row: fewer files than cores are spread over the cores first."""
    docs, cores = fx.table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if len(docs.inputFiles()) < cores else docs


def _cleaned(spark, sf):
    return _documents(spark, sf).select("doc_id", text.clean_text("text").alias("cleaned_text"))


@add("clean_text", f"SELECT doc_id, {cleaned('text')} AS cleaned_text FROM documents")
def clean_text(spark, sf):
    return _cleaned(spark, sf)


@add("clean_pages", f"SELECT page_id, {cleaned(chr(34) + 'joined' + chr(34))} AS cleaned_text FROM (SELECT page_id, url || ' ' || html AS joined FROM pages)")
def clean_pages(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return text.clean_frame(pages, ["url", "html"]).select("page_id", "cleaned_text")


@add("doc_tokens", "SELECT doc_id, token, count(*) AS n FROM words GROUP BY 1, 2")
def doc_tokens(spark, sf):
    return text.counts_of(_documents(spark, sf), "doc_id", text.words("text"), "token", "n")


@add("word_punct_tokens", """SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[.,!?;|]'), ' ') AS tokens
    FROM conversations""")
def word_punct_tokens(spark, sf):
    df = fx.table(spark, sf, "conversations")
    return df.select("conv_id", "turn", F.array_join(text.words_and_marks("text"), " ").alias("tokens"))


@add("doc_ngrams", "SELECT doc_id, term, tf FROM tf")
def doc_ngrams(spark, sf):
    return text.term_counts(_cleaned(spark, sf), "doc_id", "cleaned_text", (1, 3), STOP_WORDS)


def _weights(spark, sf):
    return text.tfidf(_cleaned(spark, sf), "doc_id", "cleaned_text", (1, 3), 0, STOP_WORDS)


@add("tfidf", "SELECT doc_id, term, df, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf):
    return rounded(_weights(spark, sf), "weight")


@add("doc_topk", "SELECT doc_id, other, rank, round(similarity, 6) AS similarity FROM doc_best")
def doc_topk(spark, sf):
    out = text.doc_topk(_weights(spark, sf), "doc_id")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "similarity")


@add("doc_recommend", """SELECT rank, round(similarity, 6) AS similarity_score, other AS doc_id, lang, source FROM doc_best b
    JOIN documents d ON d.doc_id = b.other WHERE b.doc_id = 3""")
def doc_recommend(spark, sf):
    weights = _weights(spark, sf)
    top = text.doc_topk(weights, "doc_id", queries=weights.filter("doc_id = 3"))
    out = text.doc_recommend(top, _documents(spark, sf), 3, "doc_id", ["lang", "source"])
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "similarity_score")


def _tokens(spark, sf):
    return _documents(spark, sf).select("doc_id", text.words("text").alias("tokens"))


@add("word_index", 'SELECT token, "index" FROM word_ids')
def word_index(spark, sf):
    return text.word_index(_tokens(spark, sf), "doc_id", "tokens")


@add("doc_word_indices", """SELECT d.doc_id, string_agg(CAST(coalesce(i."index", 0) AS VARCHAR), ',' ORDER BY p.pos) AS indices
    FROM documents d CROSS JOIN range(30) p(pos) LEFT JOIN words w ON w.doc_id = d.doc_id AND w.pos = p.pos
    LEFT JOIN word_ids i ON i.token = w.token GROUP BY 1""")
def doc_word_indices(spark, sf):
    tokens = _tokens(spark, sf)
    out = text.padded_indices(tokens, "doc_id", "tokens", text.word_index(tokens, "doc_id", "tokens"), 30)
    return out.select("doc_id", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"))


def places(out, name, *ids, digits=6):
    """All numbers of an array column, one per row."""
    return rounded(out.select(*ids, F.posexplode(name).alias("place", "value")), "value", digits=digits)


@add("embed_lookup", """SELECT p_partkey AS vec_id, CAST(p - 1 AS INTEGER) AS place, round(coalesce(v[p], 0), 6) AS value
    FROM part LEFT JOIN vectors ON vec_id = p_partkey CROSS JOIN range(1, 65) r(p)""")
def embed_lookup(spark, sf):
    index = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"))
    out = text.embed_lookup(index, fx.vectors(spark, sf), "vec_id", 64, "v")
    return places(out, "v", "vec_id")


# ---------------------------------------------------------------- vector pairs

_LISTS = {
    "cosine": "list_cosine_similarity(x, y)",
    "adj_cosine": """list_cosine_similarity(list_transform(x, lambda e: e - list_avg(x)), list_transform(y, lambda e: e - list_avg(y)))""",
    "pearson_global": """list_cosine_similarity(list_transform(x, lambda e: e - mx), list_transform(y, lambda e: e - my))""",
    "euclidean": "list_distance(x, y)",
    "manhattan": "list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))",
    "hamming": "list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN (z[1] > 0.5) <> (z[2] > 0.5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
    "jaccard": """list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))
        / (list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN z[1] > 0 OR z[2] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) + 1e-7)""",
}
_NAMES = {"adj_cosine": "adjusted_cosine", "pearson_global": "pearson"}
_SOURCES = {"pearson_global": """(SELECT *, (SELECT sum(list_sum(x)) / sum(len(x)) FROM vector_pairs) AS mx,
    (SELECT sum(list_sum(y)) / sum(len(y)) FROM vector_pairs) AS my FROM vector_pairs)"""}
for _name, _expr in _LISTS.items():
    def _measure(spark, sf, name=_NAMES.get(_name, _name)):
        scored = vectors.score_pairs(fx.vector_pairs(spark, sf), name)
        return rounded(scored.select("a", "b", "score"), "score")

    add(f"vec_{_name}", f"SELECT a, b, round({_expr}, 6) AS score FROM {_SOURCES.get(_name, 'vector_pairs')}")(_measure)


@add("link_auc", f"SELECT round(auc, 6) AS auc, true AS is_distance FROM ({auc_sql('pair_scores')})",
     pair_scores=f"SELECT edge AS label, round({_LISTS['euclidean']}, 9) AS score FROM vector_pairs")
def link_auc(spark, sf):
    pairs = fx.vector_pairs(spark, sf)
    return rounded(vectors.link_auc(pairs, "euclidean"), "auc")


@add("link_spearman", """SELECT round(corr(rx, ry), 6) AS spearman FROM (
      SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY edge) + (count(*) OVER (PARTITION BY edge) - 1) / 2.0 AS ry FROM
        (SELECT edge, list_distance(x, y) AS d FROM vector_pairs))""")
def link_spearman(spark, sf):
    scored = vectors.score_pairs(fx.vector_pairs(spark, sf), "euclidean")
    return rounded(vectors.spearman(scored.select("score", "edge"), "score", "edge"))


@add("l2_normalize", """SELECT vec_id, CAST(p - 1 AS INTEGER) AS place, round(v[p] / n, 6) AS value FROM (
    SELECT vec_id, v, CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END AS n FROM (SELECT *, list_sum(list_transform(v, lambda e: e * e)) AS s FROM vectors))
    CROSS JOIN range(1, 65) r(p)""")
def l2_normalize(spark, sf):
    return places(vectors.l2_normalize(fx.vectors(spark, sf), "v"), "v", "vec_id")


@add("column_center", """SELECT vec_id, CAST(p - 1 AS INTEGER) AS place, round(x - avg(x) OVER (PARTITION BY p), 6) AS value
    FROM (SELECT vec_id, p, v[p] AS x FROM vectors CROSS JOIN range(1, 65) r(p))""")
def column_center(spark, sf):
    return places(vectors.column_center(fx.vectors(spark, sf), "v"), "v", "vec_id")


@add("pca")
def pca(spark, sf):
    out = vectors.reduce_dims(fx.vectors(spark, sf), 4, "v")
    return out.select("vec_id", F.concat_ws(",", F.transform("reduced", lambda x: F.round(F.abs(x), 4)).cast("array<string>")).alias("reduced"))


@add("pca_shape", "SELECT count(*) AS n, 4 AS dim, true AS falling, 0.0::DOUBLE AS overlap FROM vectors")
def pca_shape(spark, sf):
    """Components are uncorrelated and their variances fall."""
    x = vectors.reduce_dims(fx.vectors(spark, sf), 4, "v").select("vec_id", *[F.col("reduced")[i].cast("double").alias(f"x{i}") for i in range(4)])
    pairs = [(i, j) for i in range(4) for j in range(i)]
    falling = [F.var_pop(f"x{i}") >= F.var_pop(f"x{i + 1}") for i in range(3)]
    overlap = F.greatest(*[F.abs(F.corr(f"x{i}", f"x{j}")) for i, j in pairs])
    return x.agg(F.count(F.lit(1)).alias("n"), F.lit(4).alias("dim"), (falling[0] & falling[1] & falling[2]).alias("falling"), F.round(overlap, 4).alias("overlap"))


@add("one_hot", """SELECT vec_id, concat_ws(',', """ + ", ".join(f"CAST(label = {i} AS INTEGER)" for i in range(10)) + ") AS one_hot FROM vectors")
def one_hot(spark, sf):
    out = vectors.one_hot(fx.vectors(spark, sf), "label", list(range(10)))
    return out.select("vec_id", F.concat_ws(",", F.col("one_hot").cast("array<int>").cast("array<string>")).alias("one_hot"))


# ---------------------------------------------------------------- item graph


def _relations(spark, sf):
    return graph.explode_related(fx.related(spark, sf))


@cache
def _edges(spark, sf):
    """Made once: it is counted, split and walked on."""
    return stable(graph.weighted_edges(_relations(spark, sf)))


@add("explode_related", "SELECT product1 AS asin, product2 AS related, relation AS relationship FROM related_rows")
def explode_related(spark, sf):
    return _relations(spark, sf)


@add("weighted_edges", "SELECT product1, product2, round(weight, 6) AS weight, product1 || '|' || product2 AS product_pair FROM edges")
def weighted_edges(spark, sf):
    return rounded(_edges(spark, sf), "weight")


@add("transition_prob", """SELECT w.node, next, round(weight, 9) AS weight, round(weight / d, 9) AS prob FROM ways w
    JOIN (SELECT node, sum(weight) AS d FROM ways GROUP BY 1) s ON s.node = w.node""")
def transition_prob(spark, sf):
    return rounded(graph.transition_prob(_edges(spark, sf)), "weight", "prob", digits=9)


_RANDOM = {
    "owned": """SELECT node, next, CASE WHEN i = 1 THEN 0 ELSE hi - prob END AS lo, CASE WHEN i = n THEN 1 ELSE hi END AS hi FROM (
        SELECT *, sum(prob) OVER (PARTITION BY node ORDER BY next) AS hi, row_number() OVER (PARTITION BY node ORDER BY next) AS i,
          count(*) OVER (PARTITION BY node) AS n FROM (
            SELECT w.node, next, weight / d AS prob FROM ways w JOIN (SELECT node, sum(weight) AS d FROM ways GROUP BY 1) s ON s.node = w.node))""",
    "rw": f"""SELECT * FROM (WITH RECURSIVE r AS (
        SELECT node || '#' || w AS walk, 0 AS step, node FROM (SELECT DISTINCT node FROM owned) CROSS JOIN range(10) t(w)
        UNION ALL SELECT r.walk, r.step + 1, o.next FROM r JOIN owned o ON o.node = r.node
          AND {h('42', 'r.walk', '(r.step + 1)')} >= o.lo AND {h('42', 'r.walk', '(r.step + 1)')} < o.hi WHERE r.step < 9)
        SELECT walk, step, node FROM r)""",
}


@add("random_walks", "SELECT walk, step, node FROM rw", **_RANDOM)
def random_walks(spark, sf):
    return graph.random_walks(graph.transition_prob(_edges(spark, sf)))


_EDGE = {
    "cut": f"""SELECT product1, product2, weight, row_number() OVER (ORDER BY {h('42', 'product1', 'product2')}, product1, product2) AS k,
        floor(count(*) OVER () * 0.1::DOUBLE) AS n_val FROM edges""",
    "held": "SELECT * FROM cut WHERE k <= n_val",
    "nodes": f"""SELECT node, row_number() OVER (ORDER BY {h('42', 'node')}, node) - 1 AS i, count(*) OVER () AS m
        FROM (SELECT product1 AS node FROM held UNION SELECT product2 FROM held)""",
    "circle": """SELECT count(*) AS m, count(*) // 2 AS shifts, (SELECT count(*) FROM held) AS wanted,
        (SELECT count(*) FROM (SELECT DISTINCT product1, product2 FROM edges WHERE product1 <> product2
          AND product1 IN (SELECT node FROM nodes) AND product2 IN (SELECT node FROM nodes))) AS taken FROM nodes""",
    "rounds": f"""SELECT r, 1 + (CAST(floor({h('42', "'round'")} * shifts) AS BIGINT)
          + r * CASE WHEN shifts % {negatives.SHIFT} = 0 THEN 1 ELSE {negatives.SHIFT} END) % shifts AS ahead
        FROM (SELECT *, unnest(range(least(shifts, CAST(ceil((wanted + taken) / CAST(m AS DOUBLE)) AS BIGINT) + 1))) AS r FROM circle)""",
    "paired": """SELECT least(a.node, b.node) AS product1, greatest(a.node, b.node) AS product2, r * a.m + a.i AS d
        FROM nodes a CROSS JOIN rounds JOIN nodes b ON b.i = (a.i + ahead) % a.m WHERE 2 * ahead < a.m OR a.i < ahead""",
    "fresh": """SELECT product1, product2, row_number() OVER (ORDER BY d) AS k FROM paired p
        WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.product1 = p.product1 AND e.product2 = p.product2)""",
    "negs": "SELECT product1, product2 FROM fresh WHERE k <= (SELECT count(*) FROM held)",
}


@add("edge_split", "SELECT product1, product2, 1 AS edge FROM held UNION ALL SELECT product1, product2, 0 FROM negs", **_EDGE)
def edge_split(spark, sf):
    return negatives.edge_split(_edges(spark, sf))[1]


@add("negative_edges", "SELECT product1, product2 FROM negs", **{**_EDGE, "held": "SELECT * FROM edges"})
def negative_edges(spark, sf):
    edges = stable(_edges(spark, sf).select("product1", "product2"))  # counted and read twice
    return negatives.negative_edges(edges, edges, edges.count())


def _walks(spark, sf):
    """Event sequences of the users as walks over items."""
    s = rank_rows(fx.sequences(spark, sf), [USER], [(TIMESTAMP, True), ("event_id", True)], "step")
    return s.select(F.col(USER).alias("walk"), (F.col("step") - 1).alias("step"), F.col(ITEM).alias("node"))


@add("token_freq", "SELECT node, freq FROM node_freq")
def token_freq(spark, sf):
    return negatives.token_freq(_walks(spark, sf), "node")


@add("neg_table", """SELECT node, CAST(round_even(pow(freq, 0.75::DOUBLE) / (SELECT sum(pow(freq, 0.75::DOUBLE)) FROM node_freq) * 100000, 0) AS BIGINT) AS slots
    FROM node_freq""")
def neg_table(spark, sf):
    return negatives.negative_table(negatives.token_freq(_walks(spark, sf), "node"), 100_000, token="node")


@add("keep_prob", "SELECT node, round(keep_prob, 6) AS keep_prob FROM kept")
def keep_prob(spark, sf):
    return rounded(graph.sequence_keep_prob(_walks(spark, sf)), "keep_prob")


@add("context_pairs", f"""SELECT c.walk, c.step, c.node AS center, o.node AS context FROM walks c JOIN walks o
    ON o.walk = c.walk AND o.step BETWEEN c.step - 5 AND c.step + 5 AND o.node <> c.node JOIN kept k ON k.node = o.node
    WHERE {h('42', 'c.walk', 'c.step', 'o.step')} < k.keep_prob""")
def context_pairs(spark, sf):
    walks = _walks(spark, sf)
    return graph.context_pairs(walks, keep=graph.sequence_keep_prob(walks))


_DIM = 32
_EMBED = {
    "met": """SELECT c.node AS a, o.node AS b, CAST(count(*) AS DOUBLE) AS n FROM rw c JOIN rw o ON o.walk = c.walk
        AND o.step BETWEEN c.step - 5 AND c.step + 5 AND o.node <> c.node GROUP BY 1, 2""",
    "own": "SELECT a, sum(n) AS n FROM met GROUP BY 1",
    "ppmi": """SELECT * FROM (SELECT met.a, met.b, ln(met.n * (SELECT sum(n) FROM own) / (x.n * y.n)) AS w FROM met
        JOIN own x ON x.a = met.a JOIN own y ON y.a = met.b) WHERE w > 0""",
    "v0": f"SELECT a AS node, p, CASE WHEN {h('42', 'a', 'p')} < 0.5 THEN -1.0::DOUBLE ELSE 1 END AS x FROM own CROSS JOIN range(1, {_DIM + 1}) t(p)",
    "v1": """SELECT node, p, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM (
        SELECT a AS node, p, sum(w * x) AS x FROM ppmi JOIN v0 ON v0.node = b GROUP BY 1, 2)""",
    "v2": """SELECT node, p, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM (
        SELECT a AS node, p, sum(w * x) AS x FROM ppmi JOIN v1 ON v1.node = b GROUP BY 1, 2)""",
}


@add("walk_embeddings", "SELECT node, CAST(p - 1 AS INTEGER) AS place, round(x, 6) AS value FROM v2", **_RANDOM, **_EMBED)
def walk_embeddings(spark, sf):
    walks = graph.random_walks(graph.transition_prob(_edges(spark, sf)))
    return places(graph.walk_embeddings(walks, _DIM), "vec", "node")


@add("norm_adjacency", 'SELECT "userID", "itemID", round(value, 9) AS value FROM adj')
def norm_adjacency(spark, sf):
    return rounded(graph.norm_adjacency(fx.train(spark, sf)), "value", digits=9)


_LAYERS = {
    "places": """SELECT 'u' AS side, "userID" AS id, e.p, CAST(v[e.p] AS DOUBLE) AS x FROM (SELECT DISTINCT "userID" FROM train)
          JOIN vectors ON vec_id = "userID" % (SELECT count(*) FROM vectors) CROSS JOIN range(1, 65) e(p)
        UNION ALL SELECT 'i', "itemID", e.p, v[e.p] FROM (SELECT DISTINCT "itemID" FROM train)
          JOIN vectors ON vec_id = ("itemID" + 1) % (SELECT count(*) FROM vectors) CROSS JOIN range(1, 65) e(p)""",
    "twoway": """SELECT 'u' AS side, "userID" AS id, 'i' AS to_side, "itemID" AS dest, value FROM adj
        UNION ALL SELECT 'i', "itemID", 'u', "userID", value FROM adj""",
    "layer1": "SELECT to_side AS side, dest AS id, p, sum(value * x) AS x FROM twoway JOIN places USING (side, id) GROUP BY 1, 2, 3",
    "layer2": "SELECT to_side AS side, dest AS id, p, sum(value * x) AS x FROM twoway JOIN layer1 USING (side, id) GROUP BY 1, 2, 3",
    "summed": """SELECT side, id, p, sum(x) / 3 AS x FROM (SELECT * FROM places UNION ALL SELECT * FROM layer1
        UNION ALL SELECT * FROM layer2) GROUP BY 1, 2, 3""",
}


@add("propagate_vectors", "SELECT side, id, CAST(p - 1 AS INTEGER) AS place, round(x, 6) AS value FROM summed", **_LAYERS)
def propagate_vectors(spark, sf):
    train, v = fx.train(spark, sf), fx.vectors(spark, sf)
    n = v.agg(F.count(F.lit(1))).scalar()
    vec = v.select(F.col("vec_id").alias("_k"), F.col("v").alias("vec"))
    users = train.select(F.col(USER).alias("id")).distinct().withColumn("_k", F.pmod("id", n)).join(vec, "_k")
    items = train.select(F.col(ITEM).alias("id")).distinct().withColumn("_k", F.pmod(F.col("id") + 1, n)).join(vec, "_k")
    out = graph.propagate_vectors(graph.norm_adjacency(train), users, items, 2)
    return places(out, "vec", "side", "id")
