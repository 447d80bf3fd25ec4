"""Steps that once made too many rows, shuffles or reads: the results stay, the work does not grow faster than the input."""

import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from preflens import frames
from preflens.operators import candidates, cooccur, diversity, features, graph, negatives, text
from preflens.plans import content, fixtures, sampling, tabular

TRAIN = [(u, i) for u in range(12) for i in range(15) if (u * 7 + i * 5) % 4 < 2] + [(1, None), (None, 3), (None, 4), (2, 1), (2, 1)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "userID long, itemID long")


def test_whole_table_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return (i * 37 % 100,)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 4).map(row), "x long")
    for limit in (30, 1000):
        made.value = 0
        got = frames.rank_rows(df, [], [("x", True)], "r", "n", limit=limit).collect()
        assert sorted(tuple(r) for r in got) == [(i, i + 1, 100) for i in range(100)]
        assert made.value <= 200


@pytest.mark.parametrize("set_size, pasts", [(2000, 1000), (2000, 2), (4, 1000), (4, 2)])
def test_mean_past_sim(spark, train, set_size, pasts):
    listed = spark.createDataFrame(
        [(u, i, 1.0 + u) for u in range(13) for i in (0, 3, 14, 99)] + [(1, None, 1.0), (2, None, 1.0), (None, 3, 1.0)],
        "userID long, itemID long, relevance double")
    past = train.select("userID", F.col("itemID").alias("_past")).distinct()
    pairs = listed.join(past, "userID").withColumns({"i1": F.least("itemID", "_past"), "i2": F.greatest("itemID", "_past")})
    want = diversity.with_cooccurrence_sim(pairs, train).groupBy("userID", "itemID").agg(F.round(F.avg("sim"), 9).alias("s"), F.first("relevance").alias("r"))
    got = diversity.mean_past_sim(listed, train, set_size=set_size, pasts=pasts).select("userID", "itemID", F.round("_sim", 9), "relevance")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("block, hot", [(2000, 1000), (5, 1000), (2000, 2), (5, 2)])
def test_pair_counts(train, block, hot):
    want, n = Counter(), Counter(i for _, i in set(TRAIN))
    for u in {u for u, _ in TRAIN}:
        want.update(combinations(sorted({i for v, i in TRAIN if v == u and i is not None}), 2))
    want = {(*p, c, n[p[0]], n[p[1]]) for p, c in want.items() if c > 1} | {(i, i, c, c, c) for i, c in n.items() if c > 1}
    base = train.distinct()
    got = cooccur._pair_counts(base, cooccur.item_frequency(base), 2, "userID", "itemID", block, hot).collect()
    assert len(got) == len(want) and {(r.i1, r.i2, r.c, r._a, r._b) for r in got} == want


def test_similarity_needs_no_join_of_pairs(train):
    shown = plan(cooccur.item_similarity(train, "cosine"))
    assert shown.count("Join") == 1  # frequencies come with the items of the baskets


@pytest.mark.parametrize("twice", [False, True])
def test_terms_are_counted_in_their_row(spark, twice):
    rows = [(1, "b a b"), (2, ""), (3, None), (None, "a")] + [(1, "b c"), (None, "a a")] * twice
    df = spark.createDataFrame(rows, "id long, t string")
    got = text.counts_of(df, "id", text.words("t"), "token", "n")
    want = Counter((i, w) for i, t in rows for w in (t or "").split())
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*k, n) for k, n in want.items()), key=repr)
    assert twice or "Aggregate" not in plan(got)


def test_related_pairs_without_a_join_of_lines(spark, tmp_path):
    lines = [(1, 1, "N"), (1, 2, "A"), (1, 2, "A"), (1, 3, None), (2, 1, "N"), (2, 2, "N"), (None, 1, "N"), (None, 2, "N"), (3, None, "N"), (3, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = fixtures.related(spark, str(tmp_path))
    assert {r.asin: r.related for r in out.collect()} == {
        "1": {"also_viewed": ["2"], "bought_together": ["3"], "also_bought": ["2"]},
        "2": {"also_bought": ["1"], "bought_together": ["3"]}, "9": None}
    assert plan(out).count("Join") == 1


def test_few_codes_are_sent_to_the_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 0, None), (3, 1, "b")], "id long, y int, c string")
    out = features.libffm_rows(rows, ["c"], "y", ["id"])
    assert {r.id: r.value for r in out.collect()} == {1: "1 1:2:1", 2: "0 1:1:1", 3: "1 1:3:1"}
    assert "strategy=broadcast" in plan(out)


@pytest.mark.parametrize("replace", [False, True])
def test_draws_find_their_item_in_place(spark, replace):
    seen = spark.createDataFrame([(u, i) for u in range(6) for i in range(60) if i % (u + 2) == 0], "userID long, itemID long")
    items = spark.createDataFrame([(i, i) for i in range(60)], "itemID long, index long")
    need = spark.createDataFrame([(u, b, 9) for u in range(7) for b in (1, 2)], "userID long, batch long, n long")
    lists, both = (negatives.draw_unseen(need, seen, items, ("batch",), replace=replace, limit=n) for n in (1000, 15))  # 15: two users by windows
    assert "Window" not in plan(lists)
    want = Counter(map(tuple, both.collect()))
    assert len(want) == 6 * 2 * 9 and Counter(map(tuple, lists.collect())) == want
    assert not {(r[0], r[3]) for r in want} & set(map(tuple, seen.collect()))


def test_large_catalogues_are_joined(spark, monkeypatch):
    items = spark.createDataFrame([(i * 10, i) for i in range(3000)], "itemID long, index long")
    rows = spark.createDataFrame([(i,) for i in (0, 1023, 1024, 2999)], "index long")
    for most in (3000, 10):
        monkeypatch.setattr(negatives, "SENT_ITEMS", most)
        got = negatives._items_at(rows, items, 3000, "itemID").select("index", "itemID").collect()
        assert sorted(map(tuple, got)) == [(0, 0), (1023, 10230), (1024, 10240), (2999, 29990)]


@pytest.mark.parametrize("cells", [1, 8, 1 << 16])
def test_cut_without_a_sort_of_the_table(spark, monkeypatch, cells):
    """Edges are counted by cell of their hash; only the cell of the cut is ranked, and both parts are those of a full sort."""
    ranked, real = [], negatives.rank_rows
    monkeypatch.setattr(negatives, "CELLS", cells)
    edges = spark.createDataFrame([(f"p{a}", f"p{b}", 1.0) for a in range(40) for b in range(a + 1, 40) if (a * b) % 5 == 1],
                                  "product1 string, product2 string, weight double")
    order = [frames.unit_hash(42, "product1", "product2"), F.col("product1"), F.col("product2")]
    rows = [tuple(r) for r in edges.orderBy(*order).collect()]

    def counted(df, *args, **options):
        ranked.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(negatives, "rank_rows", counted)
    train, val = negatives.edge_split(edges, 0.3)
    n = int(len(rows) * 0.3)
    assert sorted(map(tuple, train.collect())) == sorted(rows[n:])
    assert sorted((r.product1, r.product2) for r in val.filter("edge = 1").collect()) == sorted(r[:2] for r in rows[:n])
    assert val.filter("edge = 0").distinct().count() == n
    if cells > 8:
        assert ranked[0] == 1 and ranked[-1] == 1


def test_factor_models_read_their_table_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return (i % 9, i * 5 % 7, float(i % 4 + 1), i)

    table = spark.sparkContext.parallelize(range(40), 2).map(row)
    monkeypatch.setattr(fixtures, "train", lambda *_: spark.createDataFrame(table, "userID long, itemID long, rating double, timestamp long"))
    monkeypatch.setattr(fixtures, "test", lambda *_: spark.createDataFrame([(1, 2, 3.0, 9), (2, 99, 1.0, 9)], "userID long, itemID long, rating double, timestamp long"))
    assert [r.n for r in tabular.param_grid(spark, "").collect()] == [1] * 4
    assert made.value == 40
    sampling.als_topk_shape(spark, "").collect()
    assert made.value == 80


def test_few_arrivals_are_drawn_at_first(spark, monkeypatch):
    """Few arrivals a key, then more; a list does not depend on how many were drawn."""
    lists, real = [], negatives.stable

    def kept(df):
        if "_l" in df.columns:
            lists.append(df)
        return real(df)

    monkeypatch.setattr(negatives, "stable", kept)
    history = spark.range(3000).select((F.col("id") % 500).alias("itemID"), F.lit("c").alias("cate"))
    positives = spark.range(60).select(F.col("id").alias("userID"), F.col("id").alias("itemID"))
    few, many = ({tuple(r) for r in negatives.popularity_negatives(positives, history, 4, draws=d).collect()} for d in (16, 64))
    assert few == many and len(few) == 240
    assert len(lists) == 4  # two steps a call, before the last one


@pytest.mark.parametrize("edges_per_cell", [1024, 7])
def test_walks_move_and_edges_stay(spark, monkeypatch, edges_per_cell):
    """Each step goes to the edge that owns its random number, with and without cells; the table of edges is never shuffled again."""
    rows = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 0.5), ("b", "end", 0.5), (None, "b", 1.0), ("hub", None, 1.0)]
    rows = [(n, x, w / {"a": 4.0, "hub": 61.0}.get(n, 1.0)) for n, x, w in rows + [("hub", f"n{i:02}", 1.0) for i in range(60)] + [("c", "hub", 1.0)]]
    monkeypatch.setattr(graph, "EDGES_PER_CELL", edges_per_cell)
    shown, real = [], graph.saved

    def saved(df):
        shown.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(graph, "saved", saved)
    edges = spark.createDataFrame(rows, "node string, next string, prob double")
    got = {(r.walk, r.step): r.node for r in graph.random_walks(edges, 9, 4).collect()}
    draws = spark.createDataFrame([(f"{n}#{w}",) for n in {r[0] for r in rows if r[0]} for w in range(9)], "walk string")
    draws = {(r.walk, s): r.u for s in range(1, 4) for r in draws.select("walk", frames.unit_hash(42, "walk", F.lit(s)).alias("u")).collect()}
    want = {(str(w), 0): None for w in range(9)}
    for (walk, step), u in sorted(draws.items()):
        node = want.setdefault((walk, 0), walk.split("#")[0]) if step == 1 else want.get((walk, step - 1))
        own = sorted(((x or "", p) for n, x, p in rows if node and n == node))
        for i, (x, _) in enumerate(own):
            if u < sum(p for _, p in own[:i + 1]) or i == len(own) - 1:
                want[walk, step] = x or None
                break
    assert got == want
    assert len(shown) == 4 and all(len(re.findall(r"Exchange hashpartitioning\(node#\d+, _cell#", p)) == 1 for p in shown[1:])


def test_kept_tables_are_compressed(spark):
    """A table that is read again stands in columns, compressed: under 10 bytes a row here, where a checkpoint of rows took over 40."""
    rows = spark.range(200_000, numPartitions=2).selectExpr("id div 20 as user", "id % 1000 as item", "cast(id % 7 as double) as x", "cast(null as long) as y")
    kept = frames.stable(rows)
    assert "Scan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    files = [Path(f.removeprefix("file:")) for f in kept.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 2_000_000
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty() and kept.count() == 200_000


def test_inputs_are_made_once(spark, tmp_path):
    """The training and test parts and the edges are read from files, without the join and the ranks they come from."""
    spark.createDataFrame([(o, p, 1.0, "N") for o in range(4) for p in (o, o + 1, o + 2)], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 2, "2020-01-0%d" % (o + 1)) for o in range(4)], "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "cast(d as date) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, f"part {p}") for p in range(7)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    tables = [fixtures.interactions(spark, str(tmp_path)), *fixtures.train_test(spark, str(tmp_path)), content._edges(spark, str(tmp_path))]
    assert not any(re.search("Exchange|Join|Window|Aggregate", t._jdf.queryExecution().executedPlan().toString()) for t in tables)
    assert [t.count() for t in tables] == [10, 6, 4, 9]


def test_factors_are_checkpointed_each_iteration(spark, monkeypatch):
    """ALS deletes its shuffles at a checkpoint only; without a folder for them or every tenth iteration they pile up."""
    made, real = [], candidates.ALS
    monkeypatch.setattr(candidates, "ALS", lambda **options: made.append(options) or real(**options))
    train = spark.createDataFrame([(u, i, 1.0 + (u * i) % 5) for u in range(5) for i in range(6)], "userID long, itemID long, rating double")
    model = candidates.als_fit(train, rank=2, iterations=3)
    assert made[0]["checkpointInterval"] == 1 and spark.sparkContext.getCheckpointDir() and model.userFactors.count() == 5


def test_pairs_are_looked_up_in_one_order(spark):
    """Given pairs meet the upper triangle; no link is sent in both directions."""
    sim = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 2, 1.0), (None, 2, 9.0), (5, 4, 2.0)], "i1 long, i2 long, sim double")
    aff = spark.createDataFrame([(7, 1, 2.0), (7, 2, 3.0), (7, None, 5.0), (8, 4, 1.5), (None, 1, 1.0)], "userID long, itemID long, affinity double")
    pairs = spark.createDataFrame([(7, 2), (7, 3), (7, 9), (8, 5), (7, None), (None, 2), (7, 2)], "userID long, itemID long")
    out = cooccur.predict(pairs, aff, sim)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == [(7, 2, 4.0), (7, 3, 0.5), (7, 9, 0.0), (7, None, 0.0), (8, 5, 3.0), (None, 2, 0.0)]
