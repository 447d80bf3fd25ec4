"""Properties and edge cases of splits, sampling, blocks, graph, text, sequences and sources."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflens.operators import blocked, candidates, cooccur, features, graph, negatives, prep, sequence, split, text
from preflens.sources import ratings, records


@pytest.fixture(scope="module")
def df(spark):
    data = [(u, i, float(i % 5 + 1), (u * 31 + i * 17) % 97) for u in range(12) for i in range(40) if (u + i * i) % 3 or u == 0]
    return spark.createDataFrame(data, "userID long, itemID long, rating double, timestamp long").cache()


def keys(frame):
    return sorted((r.userID, r.itemID) for r in frame.select("userID", "itemID").collect())


@pytest.mark.parametrize("cut", [
    lambda d: split.random_split(d, [0.5, 0.3, 0.2]), lambda d: split.stratified_split(d, 0.7), lambda d: split.stratified_split(d, 0.7, limit=5),
    lambda d: split.chrono_split(d, [2, 1, 1], by="item"), lambda d: split.timestamp_split(d, 0.6, limit=30), lambda d: split.cell_split(d, 0.8),
])
def test_splits_are_complete(df, cut):
    parts = [keys(p) for p in cut(df)]
    assert sorted(sum(parts, [])) == keys(df) and all(parts)


def test_split_arguments(df):
    assert split.split_ratio([2, 1, 1]) == [0.5, 0.25, 0.25]
    for bad in (1.5, 0.0, [0.5, -1]):
        with pytest.raises(ValueError):
            split.split_ratio(bad)
    with pytest.raises(TypeError):
        split.split_ratio(1)
    with pytest.raises(ValueError):
        split.stratified_split(df, by="shop")
    with pytest.raises(ValueError):
        split.chrono_split(df.drop("timestamp"))
    with pytest.raises(ValueError):
        prep.min_rating_filter(df, 0)


def test_leave_last_out_short_users(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3)], "userID long, itemID long, timestamp long")
    got = {(r.userID, r.itemID): r.part for r in split.leave_last_out(d, ["timestamp"]).collect()}
    assert got == {(1, 1): "train", (1, 2): "train", (2, 1): "train", (2, 2): "valid", (2, 3): "test"}


def test_k_core(df):
    core = prep.k_core(df, 9)
    for name in ("userID", "itemID"):
        assert core.groupBy(name).count().agg(F.min("count")).first()[0] >= 9


@pytest.mark.parametrize("replace, limit", [(False, 40), (False, 10_000), (True, 10_000)])
def test_negatives_are_unseen(df, replace, limit):
    out = negatives.negatives_per_positive(df, 2, replace, limit=limit)
    neg = [tuple(r) for r in out.filter("label = 0").select("userID", "itemID").collect()]
    seen = set(keys(df))
    assert not seen & set(neg)
    pools = {u: len({i for _, i in seen}) - sum(1 for x, _ in seen if x == u) for u in range(12)}
    for u in range(12):
        mine, n = [x for x in neg if x[0] == u], sum(1 for x, _ in seen if x == u)
        want = 2 * n if replace and pools[u] else min(2 * n, pools[u])
        assert len(mine) == want and (replace or len(set(mine)) == want)


def test_full_user_has_no_negatives(df):
    out = negatives.negative_feedback(df, 1.0)
    assert out.filter("userID = 0 and feedback = 0").count() == 0  # user 0 has seen every item


def test_popularity_negatives(spark, df):
    hist = df.select("itemID", F.lit("c").alias("cate"))
    hot = hist.union(spark.range(5000).select(F.lit(1).cast("long"), F.lit("c")))  # one item holds nearly all rows
    out = negatives.popularity_negatives(df, hot, 5, draws=2)
    per = out.groupBy("userID", "itemID").agg(F.count_distinct("neg").alias("n"), F.max((F.col("neg") == F.col("itemID")).cast("int")).alias("same"))
    assert per.count() == df.count() and per.filter("n <> 5 or same = 1").count() == 0
    with pytest.raises(ValueError):
        negatives.popularity_negatives(df, hist, 1000)


def test_impression_negatives(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "c", 0), (2, "a", 1)], "imp int, item string, label int")
    out = negatives.impression_negatives(rows, 3).collect()
    assert len(out) == 3 and {r.neg for r in out} == {"b", "c"}
    padded = negatives.impression_negatives(rows, 3, pad=True).filter("imp = 1").collect()
    assert sorted(str(r.neg) for r in padded) == ["None", "b", "c"]
    assert negatives.impression_negatives(rows, 3, pad=True).filter("imp = 2 and neg is null").count() == 3


def test_edge_split(spark):
    edges = spark.createDataFrame([(f"p{a}", f"p{b}", 1.0) for a in range(30) for b in range(a + 1, 30) if (a * b) % 7 == 1],
                                  "product1 string, product2 string, weight double")
    train, val = negatives.edge_split(edges, 0.3)
    known = {tuple(sorted((r.product1, r.product2))) for r in edges.collect()}
    got = val.collect()
    pos, neg = ([(r.product1, r.product2) for r in got if r.edge == e] for e in (1, 0))
    assert len(pos) == int(len(known) * 0.3) == len(neg) and train.count() + len(pos) == len(known)
    assert not known & {tuple(sorted(n)) for n in neg} and len(set(neg)) == len(neg)


def test_blocked_topk(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (23, 6)).astype(float)
    b = rng.integers(0, 3, (31, 6)).astype(float)
    seen = [(i, (i * 5) % 31) for i in range(23)]

    def table(m):
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>")

    out = blocked.blocked_topk(table(a), table(b), 4, spark.createDataFrame(seen, "l long, r long"), True, left_block=5, right_block=7).collect()
    scores = a @ b.T
    for i in range(23):
        order = sorted((-scores[i, j], j) for j in range(31) if j != i and (i, j) not in seen)[:4]
        assert [(r.right, r.score) for r in sorted((o for o in out if o.left == i), key=lambda o: o.rank)] == [(j, -s) for s, j in order]


def test_blocked_topk_skips_short_vectors(spark, monkeypatch):
    """A table of skewed lengths: under half of the block pairs are multiplied, and the result is that of all of them."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(200, 5)) * (0.9 ** np.arange(200))[:, None]
    tables = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>") for m in (a, b)]
    made = []
    real = blocked.needed_blocks

    def counted(*args):
        out = real(*args)
        made.append(out.select("lb", "rb").distinct().count())
        return out

    monkeypatch.setattr(blocked, "needed_blocks", counted)
    got = {}
    for r in blocked.blocked_topk(*tables, 3, left_block=8, right_block=20).collect():
        got.setdefault(r.left, []).append((r["rank"], r.right))
    scores = a @ b.T
    assert {i: [j for _, j in sorted(x)] for i, x in got.items()} == {i: np.lexsort((np.arange(200), -scores[i]))[:3].tolist() for i in range(40)}
    assert made[0] + 5 < 5 * 10 / 2


def test_wide_blocks_are_sent_few_times(spark, monkeypatch):
    """Steps stay small, but a left row is sent to a few wide blocks: about SIDE times, not once for each step of right rows."""
    rng = np.random.default_rng(8)
    a, b = (rng.integers(-2, 3, (n, 4)).astype(float) for n in (50, 400))
    tables = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>") for m in (a, b)]
    sent, real = [], blocked.needed_blocks

    def counted(*args):
        out = real(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(blocked, "needed_blocks", counted)
    seen = [(i, (i * 7 + j) % 400) for i in range(50) for j in range(60)]
    got = {}
    for r in blocked.blocked_topk(*tables, 5, spark.createDataFrame(seen, "l long, r long"), True, left_block=4, right_block=5).collect():
        got.setdefault(r.left, []).append((r["rank"], r.right, r.score))
    scores, known = a @ b.T, set(seen)
    for i in range(50):
        order = sorted((-scores[i, j], j) for j in range(400) if j != i and (i, j) not in known)[:5]
        assert [(j, x) for _, j, x in sorted(got[i])] == [(j, -x) for x, j in order]
    assert sent[0] <= 50 * blocked.SIDE


@pytest.mark.parametrize("text_ids", [False, True])
def test_sparse_topk(spark, monkeypatch, text_ids):
    """Small blocks, steps of a few cells, negative links, ties, a heavy user and items without links."""
    for name, size in (("DENSE_CELLS", 12), ("PRODUCTS", 9), ("WEIGHTS_PER_BLOCK", 20), ("LINKS_PER_BLOCK", 30)):
        monkeypatch.setattr(blocked, name, size)
    rng = np.random.default_rng(5)
    name = (lambda x: f"i{x:02d}") if text_ids else (lambda x: x)
    w = {(u, int(i)): float(rng.integers(1, 4)) for u in range(15) for i in rng.choice(25, rng.integers(1, 6), replace=False)}
    w |= {(99, i): 1.0 for i in range(25)}
    links = {(a, b): float(rng.integers(-2, 3)) for a in range(22) for b in range(25) if rng.random() < 0.3}
    kind = "string" if text_ids else "long"
    weights = spark.createDataFrame([(u, name(i), x) for (u, i), x in w.items()], f"user long, item {kind}, weight double")
    table = spark.createDataFrame([(name(a), name(b), s) for (a, b), s in links.items()], f"item {kind}, to {kind}, sim double")
    sums = {}
    for (u, i), x in w.items():
        for (a, b), s in links.items():
            if a == i:
                sums[u, b] = sums.get((u, b), 0.0) + x * s
    for drop in (True, False):
        got = sorted((r.user, r["rank"], r["item"], r.score) for r in blocked.sparse_topk(weights, table, 3, drop).collect())
        want = []
        for u in {u for u, _ in w}:
            order = sorted((-s, b) for (v, b), s in sums.items() if v == u and not (drop and (u, b) in w))[:3]
            want += [(u, r, name(b), -s) for r, (s, b) in enumerate(order, 1)]
        assert got == sorted(want)
    bounds = {r.user: (r.low, r.high, r.n) for r in blocked.sparse_bounds(weights, table).collect()}
    per_user = {u: [s for (v, _), s in sums.items() if v == u] for u in {u for u, _ in sums}}
    assert bounds == {u: (min(s), max(s), len(s)) for u, s in per_user.items()}


def test_scores_in_place(spark, monkeypatch):
    """Repeated and null keys and values as in SQL, over several blocks and steps; nothing as long as the products is shuffled."""
    for name, size in (("DENSE_CELLS", 12), ("PRODUCTS", 9), ("WEIGHTS_PER_BLOCK", 40), ("LINKS_PER_BLOCK", 60), ("ROWS_SENT", 5)):
        monkeypatch.setattr(blocked, name, size)
    rng = np.random.default_rng(11)
    some = lambda x, p=0.1: None if rng.random() < p else x
    aff = [(some(int(rng.integers(9))), some(int(rng.integers(12))), some(float(rng.integers(1, 6)))) for _ in range(70)]
    sim = [(a, b, some(float(rng.integers(-2, 4)))) for a in range(12) for b in range(a, 14) if rng.random() < 0.4]
    sim += sim[:4]
    seen = [(some(int(rng.integers(9))), some(int(rng.integers(12)))) for _ in range(30)]
    ways = [(a, b, s) for x, y, s in sim for a, b in {(x, y), (y, x)}]
    cells, unity = {}, {}
    for u, i, x in aff:
        for a, b, s in ways:
            if a == i:
                cells.setdefault((u, b), []).append(None if x is None or s is None else x * s)
                unity.setdefault((u, b), []).append(s)
    total = lambda xs: sum(x for x in xs if x is not None) if any(x is not None for x in xs) else None
    sums = {c: total(xs) for c, xs in cells.items()}
    frames = (spark.createDataFrame(aff, "userID long, itemID long, affinity double"), spark.createDataFrame(sim, "i1 long, i2 long, sim double"))
    marked = spark.createDataFrame(seen, "userID long, itemID long")
    known = {p for p in seen if None not in p}
    as_dict = lambda df: {(r.userID, r.itemID): r.prediction for r in df.collect()}
    full = cooccur.scores(*frames)
    assert as_dict(full) == sums and full.count() == len(sums)
    above, made, _ = full._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")
    assert made and "Join" not in above and "Aggregate" not in above
    assert as_dict(cooccur.scores(*frames, marked)) == {c: s for c, s in sums.items() if c not in known}
    want = {}
    for (u, b), s in sums.items():
        reached = [total(xs) for (v, _), xs in unity.items() if v == u]
        given = [x for x in reached if x is not None]
        more = [0.0] if len(reached) < 13 else []
        low, high = min(given + more, default=None), max(given + more, default=None)
        if u is not None:
            want[u, b] = None if s is None or low is None or 5 * high == low else (s - low) / (5 * high - low) * 4 + 1
    args = (*frames, F.lit(1.0), F.lit(5.0), F.lit(13))
    near = lambda x: pytest.approx(x, abs=1e-8)
    assert as_dict(cooccur.normalized_scores(*args)) == near(want)
    assert as_dict(cooccur.normalized_scores(*args, marked)) == near({c: s for c, s in want.items() if c not in known})
    assert as_dict(cooccur.normalized_scores(*args, wanted=marked)) == near({c: s for c, s in want.items() if c in known})
    seeds = frames[0].withColumnRenamed("affinity", "rating")
    own, got = {(u, i) for u, i, _ in aff if u is not None}, {}
    for r in cooccur.seed_topk(seeds, frames[1], 3).collect():
        got.setdefault(r.userID, {})[r["rank"]] = (r.itemID, r.prediction)
    for u in {u for u, _ in sums}:
        order = sorted(((s is None, -(s or 0), b) for (v, b), s in sums.items() if v == u and (u, b) not in own))[:3]
        assert [got.get(u, {}).get(n) for n in range(1, len(order) + 1)] == [(b, None if none else -s) for none, s, b in order]


def test_random_walks(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 0.5)] + [("hub", f"n{i}", 1.2) for i in range(60)] + [("a", "hub", 1.0)],
                                  "product1 string, product2 string, weight double")
    steps = graph.transition_prob(edges)
    assert steps.groupBy("node").agg(F.sum("prob").alias("p")).filter("abs(p - 1) > 1e-9").count() == 0
    walks = graph.random_walks(steps, 20, 6, limit=10).collect()
    allowed = {(r.node, r.next) for r in steps.collect()}
    by_walk = {}
    for r in walks:
        by_walk.setdefault(r.walk, {})[r.step] = r.node
    assert len(by_walk) == 20 * 64 and all(len(w) == 6 for w in by_walk.values())
    assert all((w[i], w[i + 1]) in allowed for w in by_walk.values() for i in range(5))
    first = [w[1] for w in by_walk.values() if w[0] == "a"]
    assert set(first) == {"b", "c", "hub"} and first.count("c") > first.count("b")


def test_context_pairs(spark):
    seq = spark.createDataFrame([(1, i, n) for i, n in enumerate("abcab")], "walk int, step int, node string")
    got = sorted((r.step, r.context) for r in graph.context_pairs(seq, 2).collect())
    s = "abcab"
    assert got == sorted((i, s[j]) for i in range(5) for j in range(5) if i != j and abs(i - j) <= 2 and s[i] != s[j])


def test_explode_related(spark):
    d = spark.createDataFrame([
        ("p1", "t", {"also_bought": ["x", "y"], "also_viewed": ["z"]}), ("p2", "t", {"also_bought": ["x"]}), ("p3", None, {"also_bought": ["x", "y"]}),
        ("p4", "t", None), ("p5", "t", {"bought_together": ["x"]}),
    ], "asin string, title string, related map<string,array<string>>")
    rel = graph.explode_related(d)
    assert sorted(tuple(r) for r in rel.collect()) == [("p1", "x", "also_bought"), ("p1", "y", "also_bought"), ("p1", "z", "also_viewed")]


def test_text(spark):
    d = spark.createDataFrame([(1, "<b>The</b> Cat_sat, on\nthe mat!"), (2, None), (3, ""), (4, "Été été 123")], "id int, t string")
    got = {r.id: r.c for r in d.select("id", text.clean_text("t").alias("c")).collect()}
    assert got == {1: "the catsat on the mat", 2: "", 3: "", 4: "été été 123"}
    grams = d.select(text.ngrams(F.lit("the cat sat on a mat"), (1, 3), ["the"]).alias("g")).first().g
    assert grams == ["cat", "sat", "on", "mat", "cat sat", "sat on", "on mat", "cat sat on", "sat on mat"]
    assert d.select(text.words_and_marks(F.lit("Hi, you!")).alias("w")).first().w == ["hi", ",", "you", "!"]
    assert d.filter("id = 2").select(text.words("t").alias("w")).first().w == []


def test_doc_topk_of_copies(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "beta delta"), (4, "omega")], "id long, t string")
    out = text.doc_topk(text.tfidf(d, "id", "t", (1, 1)), "id", 2)
    best = {(r.id, r.rank): (r.other, round(r.similarity, 6)) for r in out.collect()}
    assert best[1, 1] == (2, 1.0) and best[2, 1] == (1, 1.0) and not any(i == 4 for i, _ in best)
    with pytest.raises(ValueError):
        text.check_k(d, 4)


def test_histories(spark):
    d = spark.createDataFrame([(1, i, i * 10) for i in range(300)] + [(2, 5, 1)], "userID long, itemID long, timestamp long")
    sequence.CHUNK, old = 20, sequence.CHUNK
    try:
        got = {r.itemID: [h.itemID for h in r.history] for r in sequence.expanding_history(d, ["timestamp"], ["itemID"], max_len=7, limit=25).collect()}
    finally:
        sequence.CHUNK = old
    assert got == {i: list(range(max(0, i - 7), i)) for i in range(1, 300)}
    parts = split.leave_last_out(d, ["timestamp"])
    last = {(r.userID, r.part): [h.itemID for h in r.history] for r in sequence.final_history(parts, ["timestamp"], ["itemID"], max_len=3).collect()}
    assert last == {(1, "train"): [294, 295, 296], (1, "valid"): [295, 296, 297], (1, "test"): [296, 297, 298]}


def test_padding(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([9],)], "v array<int>")
    out = sequence.pad_sequences(d, "v", 2).collect()
    assert [r.v for r in out] == [[2, 3], [9, 0]] and [r.v_mask for r in out] == [[1, 1], [1, 0]]
    assert [r.v for r in sequence.pad_sequences(d, "v", 4, left=True).collect()] == [[0, 1, 2, 3], [0, 0, 0, 9]]


def test_encoders(spark):
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "a", 0), (4, None, 1), (5, "a", 1)], "id int, c string, y int")
    folded = features.fold_rare(d, "c", features.frequent_values(d, "c", 1, 1.0))
    assert sorted(r.c for r in folded.collect()) == ["<LESS>", "<UNK>", "a", "a", "a"]
    enc = {r.id: (round(r.t_mean, 4), round(r.t_count, 4)) for r in features.target_encode(folded, "c", "y", ["id"], limit=2).collect()}
    assert enc == {1: (0, 0), 2: (0, 0), 3: (1, 0.5), 4: (0, 0), 5: (0.5, 0.5)}
    assert features.parameter_grid({"a": [1, 2], "b": 3}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_similar_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, vec array<double>")
    assert [r.id for r in candidates.similar_vectors(v, 1, 3).collect()] == [2, 3, 4]


def test_rating_files(spark, tmp_path):
    for sep in ("\t", "::", ","):
        folder = tmp_path / f"r{ord(sep[0])}"
        folder.mkdir()
        (folder / "f.txt").write_text("\n".join(sep.join(map(str, r)) for r in [(1, 2, 3.5, 100), (4, 5, 1.0, 200)]))
        assert [tuple(r) for r in ratings.read_ratings(spark, str(folder), sep).collect()] == [(1, 2, 3.5, 100), (4, 5, 1.0, 200)]
    with pytest.warns(UserWarning):
        assert len(ratings.rating_schema(["a", "b", "c", "d", "e"])) == 4
    flags = ["0"] * 19
    flags[1] = flags[5] = "1"
    (tmp_path / "items").write_text("1|Toy Story (1995)|01-Jan-1995||http://x|" + "|".join(flags) + "\n2|Plain||||" + "|".join(["0"] * 19))
    items = {r.itemID: (r.year, r.genres) for r in ratings.read_items(spark, str(tmp_path / "items")).collect()}
    assert items == {1: ("1995", "Action|Comedy"), 2: (None, "")}
    mock = ratings.mock_interactions(spark, 100, with_genre=True)
    assert mock.select("userID", "itemID").distinct().count() == 100 and mock.filter("rating between 1 and 5").count() == 100


def test_record_files(spark, tmp_path):
    (tmp_path / "clicks").write_text("1\t" + "\t".join(["7"] * 13) + "\t" + "\t".join(["x"] * 26) + "\n")
    row = records.read_click_log(spark, str(tmp_path / "clicks")).first()
    assert (row.label, row.int12, row.cat25, len(row)) == (1, 7, "x", 40)
    (tmp_path / "b").write_text("1\tu\t11/11/2019 9:05:58 AM\tn1 n2\tn3-1 n-4-0\n2\tv\t11/12/2019 9:05:58 AM\t\tn5-0\n")
    b = records.read_behaviors(spark, str(tmp_path / "b"))
    got = {r.imp: (r.clicks, r.pos, r.neg) for r in records.parse_impressions(b).collect()}
    assert got == {"1": (["n1", "n2"], ["n3"], ["n-4"]), "2": ([], [], ["n5"])}
    assert [(r.item, r.label) for r in records.impression_rows(b).filter("imp = '1'").orderBy("pos").collect()] == [("n3", 1), ("n-4", 0)]
    entity = json.dumps([{"SurfaceForms": ["Old York", "York"], "WikidataId": "Q1"}])
    (tmp_path / "n").write_text(f"n1\tnews\tworld\tA Title, here\tabs\turl\t{entity}\t[]\n")
    news = records.read_news(spark, str(tmp_path / "n"))
    assert news.first().words == ["a", "title", "here"]
    assert [(r.surface, r.entity) for r in records.entity_rows(news).collect()] == [("Old York", "Q1"), ("York", "Q1")]
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write(json.dumps({"asin": "P1", "title": "Big TITLE", "categories": [["A", "B"], ["C"]], "related": {"also_bought": ["X"]}}) + "\n")
    meta = records.read_product_meta(spark, str(tmp_path / "m.json.gz"))
    assert records.last_category(meta).first().cate == "B" and records.lower_strings(meta).first().title == "big title"
    records.write_table(meta.select("asin"), str(tmp_path / "out"), "csv", header=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().asin == "P1"


def test_dedupe(spark):
    d = spark.createDataFrame([(1, "a", "x", "t"), (2, "a", "y", "t"), (3, "b", "x", "t"), (4, "c", "z", ""), (5, None, "w", "t"), (6, "d", "v", "t")],
                              "id int, k string, l string, t string")
    assert sorted(r.id for r in records.dedupe_then_dropna(d, ["k", "l"], ["k", "t"], "id").collect()) == [1, 6]


def test_libffm(spark):
    d = spark.createDataFrame([(1, 1, "a", 5), (2, 0, "b", 6)], "id int, y int, c string, n int")
    lines = features.libffm_rows(d, ["c", "n"], "y", ["id"])
    assert {r.id: r.value for r in lines.collect()} == {1: "1 1:1:1 2:3:5", 2: "0 1:2:1 2:3:6"}
    parsed = features.parse_libffm(lines, key=["id"]).filter("id = 1").first()
    assert (parsed.label, parsed.impression, [tuple(f) for f in parsed.features]) == (1.0, "0", [(0, 0, 1.0), (1, 2, 5.0)])


@pytest.mark.parametrize("k,impacts,first_terms", [(1, 64, 8), (4, 2, 1), (30, 64, 8)])
def test_doc_topk_against_all_pairs(spark, k, impacts, first_terms):
    """Copies, ties, a word of every document, documents without partners."""
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(["the", *rng.choice(words, rng.integers(1, 12))]) for _ in range(60)]
    docs += docs[:6] + ["the", "the the", "only here", ""] + ["same text again"] * 8
    table = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    weights = text.tfidf(table, "id", "text", (1, 2))
    got = {}
    for r in text.doc_topk(weights, "id", k, impacts=impacts, first_terms=first_terms).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["similarity"]))
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in weights.collect()}))}
    m = np.zeros((len(docs), len(terms)))
    for r in weights.collect():
        m[r["id"], terms[r["term"]]] = r["weight"]
    sims = np.round(m @ m.T, 9)
    for i in range(len(docs)):
        order = sorted((-sims[i, j], j) for j in range(len(docs)) if j != i and sims[i, j] > 0)[:k]
        assert [(a, b) for a, b, _ in sorted(got.get(i, []))] == [(n, j) for n, (_, j) in enumerate(order, 1)]


def test_doc_topk_rows_grow_with_the_documents(spark):
    """A word of every document pairs no documents once the floors are known: join rows stay in proportion."""
    rng = np.random.default_rng(2)

    def rows(n):
        docs = [" ".join(["the", "of", *(f"g{i // 8}x{j}" for j in rng.choice(12, 6, replace=False))]) for i in range(n)]
        weights = text.tfidf(spark.createDataFrame(list(enumerate(docs)), "id long, text string"), "id", "text", (1, 1))
        shared = weights.filter("df > 1").select(F.col("id").alias("_id"), "term", "df", "weight")
        asked, _, _ = text._floors(shared, 3, None, "id", 64, 8)
        return asked.filter("_needed").agg(F.sum("df")).first()[0]

    assert rows(500) <= 6 * rows(100)
