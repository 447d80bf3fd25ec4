"""Ranks, running sums and pairs: the sliced paths have to agree with plain Python."""

from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from preflens import frames


def rows(spark, hot=300, same_time=False):
    """One user with most rows, a few small ones."""
    data = [(1, i, 5 if same_time else (i * 37) % 101, f"k{(i * 7919) % 1000:04d}") for i in range(hot)]
    data += [(u, i, i % 3, f"k{i}") for u in range(2, 8) for i in range(u)]
    return spark.createDataFrame(data, "userID long, itemID long, timestamp long, name string")


@pytest.mark.parametrize("same_time", [False, True])
@pytest.mark.parametrize("asc", [True, False])
def test_rank_of_hot_group(spark, same_time, asc):
    df = rows(spark, same_time=same_time)
    got = frames.rank_rows(df, ["userID"], [("timestamp", asc), ("itemID", True)], "r", "n", limit=20)
    data = [r.asDict() for r in df.collect()]
    expected = {}
    for user in {d["userID"] for d in data}:
        mine = sorted((d for d in data if d["userID"] == user), key=lambda d: (d["timestamp"] * (1 if asc else -1), d["itemID"]))
        expected.update({(user, d["itemID"]): (i, len(mine)) for i, d in enumerate(mine, 1)})
    assert {(r.userID, r.itemID): (r.r, r.n) for r in got.collect()} == expected


def test_hot_slices_are_small(spark):
    df = rows(spark, hot=2000)
    cut = frames.in_ranges(df, ["userID"], [("timestamp", True), ("itemID", True)], 100)
    sizes = [r["count"] for r in cut.groupBy("userID", "_slice").count().collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 300


@pytest.mark.parametrize("group", [[], ["g"]])
def test_ranks_do_not_depend_on_the_limit(spark, group):
    """Shared prefixes, nulls, three order columns, a heavy tail and a hot null group."""
    data = []
    for i in range(1200):
        name = None if i % 97 == 0 else f"doc-000000-{i * 7919 % 400:05d}"
        data.append((None if i % 3 else i % 5, name, 2.0 ** (i % 60) if i % 11 else None, i))
    df = spark.createDataFrame(data, "g long, name string, x double, id long")
    order = [("name", True), ("x", False), ("id", True)]
    few, all_rows = (frames.rank_rows(df, group, order, "r", "n", limit=limit) for limit in (10, 10**6))
    assert sorted((r.id, r.r, r.n) for r in few.collect()) == sorted((r.id, r.r, r.n) for r in all_rows.collect())


def test_global_rank_by_string(spark):
    df = rows(spark).filter("userID = 1").withColumn("name", F.when(F.col("itemID") == 3, None).otherwise(F.col("name")))
    got = frames.rank_rows(df, [], [("name", True), ("itemID", True)], "r", limit=15).orderBy("r").collect()
    names = [(r.name, r.itemID) for r in got]
    assert names == sorted(names, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [r.r for r in got] == list(range(1, len(got) + 1))


def test_running_sum(spark):
    df = rows(spark)
    got = frames.running(df, ["userID"], [("itemID", True)], {"s": F.col("timestamp")}, {"t": F.col("timestamp")}, limit=10)
    for r in got.filter("userID = 1").collect():
        assert r.s == sum((i * 37) % 101 for i in range(r.itemID + 1))
        assert r.t == sum((i * 37) % 101 for i in range(300))


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("with_self", [True, False])
def test_item_pairs(spark, block, with_self):
    df = rows(spark, hot=40)
    got = [(r.userID, r.i1, r.i2) for r in frames.item_pairs(df, ["userID"], "itemID", with_self, block).collect()]
    items = {}
    for r in df.collect():
        items.setdefault(r.userID, set()).add(r.itemID)
    expected = {(u, a, b) for u, its in items.items() for a, b in combinations_with_replacement(sorted(its), 2) if with_self or a != b}
    assert len(got) == len(expected) and set(got) == expected


def test_unit_hash_is_uniform(spark):
    df = spark.range(4000).select(frames.unit_hash(1, "id").alias("h"))
    low, high, mean = df.agg(F.min("h"), F.max("h"), F.avg("h")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.02


def test_checks(spark):
    df = rows(spark)
    with pytest.raises(ValueError):
        frames.require_columns(df, "absent")
    with pytest.raises(ValueError):
        frames.require_rows(df.filter("false"))
    with pytest.raises(ValueError):
        frames.require_disjoint(df, df.limit(1), ["userID", "itemID"])
    assert frames.same_base_type(df, df.withColumn("itemID", F.col("itemID").cast("int")), ["itemID"])
    assert not frames.same_base_type(df, df.withColumn("itemID", F.col("itemID").cast("string")), ["itemID"])
