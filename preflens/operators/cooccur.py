"""Item co-occurrence: affinity, similarities, and the recommendations made from them.

All matrices stay in long form. Similarities keep the pairs that co-occur, with i1 <= i2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import (
    DEFAULT_K, ITEM, ITEMS_PER_BLOCK, PREDICTION, RATING, ROWS_PER_TASK, TIMESTAMP, USER, item_pairs, lanes, same_keys, stable, top_k,
)
from preflens.operators.blocked import sparse_bounds, sparse_scores, sparse_topk
from preflens.operators.prep import exponential_decay

PAIRS_PER_TASK = 2_000_000
DIGITS = 10  # scores are sums without a fixed order; rounded, equal scores tie
SIMILARITIES = ("cooccurrence", "cosine", "inclusion", "jaccard", "lift", "mutual_information", "lexicographers_mi")


def require_unique(df: DataFrame, *names: str) -> None:
    """Raise when rows repeat in the given columns."""
    twice = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not twice.isEmpty():
        raise ValueError("there should be no duplicate rows")


def affinity(df, user=USER, item=ITEM, rating=RATING) -> DataFrame:
    return df.groupBy(user, item).agg(F.sum(rating).alias("affinity"))


def decayed_affinity(
    df, half_life_days=30.0, now=None, user=USER, item=ITEM, rating=RATING, timestamp=TIMESTAMP
) -> DataFrame:
    """Ratings lose half their weight every half life before ``now`` (the newest row by default)."""
    newest = F.lit(now) if now is not None else df.agg(F.max(timestamp)).scalar()
    weight = exponential_decay(timestamp, newest, half_life_days * 86400)
    weighted = df.withColumn("_w", F.col(rating) * weight)
    return weighted.groupBy(user, item).agg(F.sum("_w").alias("affinity"))


def item_frequency(df, user=USER, item=ITEM) -> DataFrame:
    return df.select(user, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(df, threshold=1, user=USER, item=ITEM, block=ITEMS_PER_BLOCK) -> DataFrame:
    """(i1, i2, c): users with both items, i1 <= i2, from ``threshold`` on. Pairs are counted before the shuffle."""
    base = stable(df.select(user, item).distinct())
    return _pair_counts(base, item_frequency(base, user, item), threshold, user, item, block).select("i1", "i2", "c")


def _pair_counts(base, freq, threshold, user, item, block=ITEMS_PER_BLOCK, hot=ROWS_PER_TASK // 8) -> DataFrame:
    """(i1, i2, c, _a, _b): users with both items and the frequencies of the two, i1 <= i2, from ``threshold`` on.

    ``base`` has distinct rows and ``freq`` their number per item. Each item of a basket sends one row with the items after it to
    the task that counts all its pairs, so a pair costs one number in a list. An item of over ``hot`` users is counted by several
    tasks; a basket of over ``block`` items is paired block by block.
    """
    spark, whole = base.sparkSession, base
    sizes = base.filter(F.col(item).isNotNull()).groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    most, pairs = sizes.agg(F.max("_n"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()
    large = None
    if (most or 0) > block:
        large = sizes.filter(F.col("_n") > block).select(user)
        base = same_keys(base, large, [user], "left_anti")
    parts = lanes(spark, pairs or 0, PAIRS_PER_TASK)
    n = F.col("n").alias("_n")
    spread = F.ceil(F.col("n") / hot).cast("int").alias("_s")  # tasks that share an item
    rows = base.join(freq.select(item, n, spread), item).select(user, F.struct(F.col(item).alias("i"), "_n", "_s").alias("_e"))
    packed = rows.repartition(parts, user).groupBy(user).agg(F.sort_array(F.collect_list("_e")).alias("_l"))
    first = packed.select(user, F.posexplode("_l").alias("_p", "_e"), "_l").filter(F.col("_p") + 1 < F.size("_l"))
    rest = F.slice("_l", F.col("_p") + 2, F.size("_l"))
    some = F.pmod(F.xxhash64(user), F.col("_e._s")).alias("_some")
    sent = first.select(F.col("_e.i").alias("i1"), F.col("_e._n").alias("_a"), some, rest.alias("_r"))
    sent = sent.select("i1", "_a", "_some", F.col("_r.i").alias("i2"), F.col("_r._n").alias("_b")).repartition(parts, "i1", "_some")
    met = sent.select("i1", "_a", "_some", F.explode(F.arrays_zip("i2", "_b")).alias("_z")).select("i1", "_a", "_some", "_z.i2", "_z._b")
    counts = met.groupBy("i1", "_some", "i2").agg(F.count(F.lit(1)).alias("c"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    if large is not None:
        blocks = item_pairs(same_keys(whole, large, [user], "left_semi"), [user], item, with_self=False, block=block)
        more = blocks.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("c"))
        more = more.join(freq.select(F.col(item).alias("i1"), F.col("n").alias("_a")), "i1").join(freq.select(F.col(item).alias("i2"), F.col("n").alias("_b")), "i2")
        counts = counts.drop("_some").unionByName(more)
    shared = large is not None or not freq.filter(F.col("n") > hot).isEmpty()
    if shared:
        counts = counts.groupBy("i1", "i2").agg(F.sum("c").alias("c"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    own = freq.select(F.col(item).alias("i1"), F.col(item).alias("i2"), F.col("n").alias("c"), F.col("n").alias("_a"), F.col("n").alias("_b"))
    return counts.select("i1", "i2", "c", "_a", "_b").unionByName(own).filter(F.col("c") >= threshold)


def _measure(kind: str, c: Column, a: Column, b: Column, n_items: Column) -> Column:
    lift = c / (a * b)
    mi = F.log2(n_items * lift)
    return {
        "cooccurrence": c.cast("double"),
        "cosine": c / F.sqrt(a * b),
        "inclusion": c / F.least(a, b),
        "jaccard": c / (a + b - c),
        "lift": lift,
        "mutual_information": mi,
        "lexicographers_mi": c * mi,
    }[kind]


def item_similarity(df, kind="jaccard", threshold=1, user=USER, item=ITEM, block=ITEMS_PER_BLOCK) -> DataFrame:
    """(i1, i2, sim) for the pairs that co-occur at least ``threshold`` times."""
    if kind not in SIMILARITIES:
        raise ValueError(f"unknown similarity {kind!r}")
    if kind == "cooccurrence":
        return cooccurrence(df, threshold, user, item, block).select("i1", "i2", F.col("c").cast("double").alias("sim"))
    base = stable(df.select(user, item).distinct())
    freq = item_frequency(base, user, item)
    pairs = _pair_counts(base, freq, threshold, user, item, block).filter(F.col("i1").isNotNull())
    sim = _measure(kind, F.col("c"), F.col("_a").cast("double"), F.col("_b").cast("double"), freq.agg(F.count(F.lit(1))).scalar())
    return pairs.select("i1", "i2", sim.alias("sim"))


def both_ways(sim: DataFrame) -> DataFrame:
    """Full symmetric form of an upper triangle."""
    pair = F.struct(F.col("i1").alias("a"), F.col("i2").alias("b"))
    back = F.struct(F.col("i2").alias("a"), F.col("i1").alias("b"))
    ways = F.when(F.col("i1") == F.col("i2"), F.array(pair)).otherwise(F.array(pair, back))
    return sim.select(F.explode(ways).alias("_p"), "sim").select("_p.a", "_p.b", "sim")


def _tables(aff, sim, user, item, weight="affinity", extra=()):
    """Weights (user, item, weight, extra...) and links (item, to, sim) for the sums in place; both are read more than once."""
    weights = stable(aff.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(weight).cast("double").alias("weight"), *extra))
    half = stable(sim.select(F.col("i1").alias("item"), F.col("i2").alias("to"), F.col("sim").cast("double").alias("sim")))
    return weights, half.union(half.select("to", "item", "sim").filter(~F.col("to").eqNullSafe(F.col("item"))))


def _as_pairs(df, user, item):
    return None if df is None else df.select(F.col(user).alias("user"), F.col(item).alias("item"))


def scores(aff, sim, seen=None, user=USER, item=ITEM) -> DataFrame:
    """Score of every item a user reaches: sum of affinity x similarity, without the seen pairs if given.

    The sums are made in place and no product is shuffled (``blocked.sparse_scores``).
    """
    out = sparse_scores(*_tables(aff, sim, user, item), _as_pairs(seen, user, item))
    return out.select(F.col("user").alias(user), F.col("item").alias(item), F.round("score", DIGITS).alias(PREDICTION))


def normalized_scores(aff, sim, low, high, n_items, seen=None, user=USER, item=ITEM, wanted=None) -> DataFrame:
    """Scores brought to the rating range [low, high] by the user's lowest and highest possible score.

    ``low``, ``high`` and ``n_items`` are scalar columns. ``aff`` may carry a column ``unity`` (decay weight
    of a rating of one; 1 by default). An item out of reach counts 0 for the lowest value. ``seen`` pairs are left out;
    with ``wanted`` only those pairs are returned, their bounds still come from all items.
    """
    if "unity" not in aff.columns:
        aff = aff.withColumn("unity", F.lit(1.0))
    aff = aff.filter(F.col(user).isNotNull())
    if wanted is not None:
        aff = aff.join(wanted.select(user).distinct(), user, "left_semi")
        if seen is not None:
            wanted, seen = wanted.select(user, item).join(seen.select(user, item), [user, item], "left_anti"), None
    weights, links = _tables(aff, sim, user, item, extra=(F.col("unity").cast("double").alias("unity"),))
    bounds = sparse_bounds(weights.select("user", "item", F.col("unity").alias("weight")).filter("item is not null"), links.filter("item is not null"))
    bounds = bounds.select("user", F.col("low").alias("_min"), F.col("high").alias("_max"), F.col("n").alias("_n"))
    floor = F.when(F.col("_n") < n_items, F.least(F.col("_min"), F.lit(0.0))).otherwise(F.col("_min")) * low
    top = F.greatest(F.col("_max"), F.when(F.col("_n") < n_items, 0.0)) * high
    weights = weights.drop("unity").join(bounds.select("user", floor.cast("double").alias("_floor"), top.cast("double").alias("_top")), "user")
    pairs = _as_pairs(seen if wanted is None else wanted, user, item)
    out = sparse_scores(weights, links, pairs, wanted is None, ("_floor", "_top"))
    scaled = F.try_divide(F.col("score") - F.col("_floor"), F.col("_top") - F.col("_floor")) * (high - low) + low
    return out.select(F.col("user").alias(user), F.col("item").alias(item), F.round(scaled, DIGITS).alias(PREDICTION))


def recommend_k_items(
    aff, sim, k=DEFAULT_K, users=None, remove_seen=True, user=USER, item=ITEM, normalize: tuple | None = None, check=False,
) -> DataFrame:
    """Best k reached items per user, whatever the sign of their scores.

    Blocks of users stay in place, the similarities of their items are sent to them once, and only k rows a user leave a task
    (``blocked.sparse_topk``). ``normalize`` (low, high, n_items) brings the scores to the rating range; ``check`` raises on
    repeated pairs and on users without affinity. Rows without a user or an item count for nothing.
    """
    if check:
        require_unique(aff, user, item)
        if users is not None:
            require_known_users(users, aff, user)
    aff = aff.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    wanted = aff if users is None else aff.join(users.select(user).distinct(), user, "left_semi")
    unity = F.col("unity") if "unity" in aff.columns else F.lit(1.0)
    wanted = wanted.select(F.col(user).alias("user"), F.col(item).alias("item"), F.coalesce(F.col("affinity").cast("double"), F.lit(float("nan"))).alias("weight"), unity.alias("unity"))
    wanted = stable(wanted)  # counted and then read more than once, like the links
    half = stable(sim.select(F.col("i1").alias("item"), F.col("i2").alias("to"), F.col("sim").cast("double").alias("sim")))
    links = half.union(half.select("to", "item", "sim").filter(F.col("to") != F.col("item")))
    if normalize is None:
        best = sparse_topk(wanted.drop("unity"), links, k, remove_seen, DIGITS)
        return best.select(F.col("user").alias(user), F.col("item").alias(item), F.col("score").alias(PREDICTION), "rank")
    low, high, n_items = normalize
    bounds = sparse_bounds(wanted.select("user", "item", F.col("unity").alias("weight")), links)
    some = F.col("n") < n_items
    floor = F.when(some, F.least(F.col("low"), F.lit(0.0))).otherwise(F.col("low")) * low
    span = F.greatest(F.col("high"), F.when(some, 0.0)) * high - floor
    scale = F.try_divide(high - low, span)
    bounds = bounds.select("user", F.coalesce(scale, F.lit(0.0)).alias("scale"), F.coalesce(low - floor * scale, F.lit(0.0)).alias("shift"), (span == 0).alias("_flat"))
    best = sparse_topk(wanted.drop("unity").join(bounds.drop("_flat"), "user"), links, k, remove_seen, DIGITS)
    best = best.join(bounds.select("user", "_flat"), "user").withColumn("score", F.when(~F.col("_flat"), F.col("score")))
    return best.select(F.col("user").alias(user), F.col("item").alias(item), F.col("score").alias(PREDICTION), "rank")


def require_known_users(test, train, user=USER) -> None:
    """Raise when the test table holds a user that train lacks."""
    if not test.select(user).join(train.select(user), user, "left_anti").isEmpty():
        raise ValueError("users that are not in the training table cannot be scored")


def predict(pairs, aff, sim, user=USER, item=ITEM) -> DataFrame:
    """Score of the given pairs only; an item out of reach gets 0."""
    wanted = pairs.select(user, item).distinct()
    owned = aff.select(user, F.col(item).alias("_from"), "affinity").filter("_from is not null")
    low, high = F.least("i1", "i2").alias("_low"), F.greatest("i1", "i2").alias("_high")  # a pair is looked up in one order
    links = sim.filter("i1 is not null and i2 is not null").select(low, high, "sim")
    asked = wanted.filter(F.col(item).isNotNull()).join(owned, user)
    asked = asked.select(user, item, "affinity", F.least(item, "_from").alias("_low"), F.greatest(item, "_from").alias("_high"))
    got = asked.join(links, ["_low", "_high"])
    got = got.groupBy(user, item).agg(F.round(F.sum(F.col("affinity") * F.col("sim")), DIGITS).alias(PREDICTION))
    return wanted.join(got, [user, item], "left").withColumn(PREDICTION, F.coalesce(PREDICTION, F.lit(0.0)))


def popular_items(df, k=DEFAULT_K, user=USER, item=ITEM) -> DataFrame:
    return item_frequency(df, user, item).orderBy(F.col("n").desc(), item).limit(k)


def active_users(df, k=DEFAULT_K, user=USER, item=ITEM) -> DataFrame:
    return item_frequency(df, item, user).orderBy(F.col("n").desc(), user).limit(k)


def seed_topk(seeds, sim, k=DEFAULT_K, user=USER, item=ITEM, rating=RATING) -> DataFrame:
    """Best k items for given seed items; the seeds are left out. ``user`` and ``rating`` columns are optional."""
    if user not in seeds.columns:
        seeds = seeds.withColumn(user, F.lit(0))
    if rating not in seeds.columns:
        seeds = seeds.withColumn(rating, F.lit(1.0))
    weights, links = _tables(affinity(seeds, user, item, rating), sim, user, item)
    best = sparse_topk(weights.filter("item is not null"), links.filter("item is not null and to is not null"), k, True, DIGITS)
    return best.select(F.col("user").alias(user), F.col("item").alias(item), F.col("score").alias(PREDICTION), "rank")


def similar_users(aff, seed_user, k=DEFAULT_K, user=USER, item=ITEM) -> DataFrame:
    """Users with the largest sum of affinity products with one user, without that user."""
    own = aff.filter(F.col(user) == seed_user).select(item, F.col("affinity").alias("_a"))
    others = aff.filter(F.col(user) != seed_user).join(own, item)
    total = others.groupBy(user).agg(F.round(F.sum(F.col("affinity") * F.col("_a")), DIGITS).alias("similarity"))
    return total.orderBy(F.col("similarity").desc(), user).limit(k)
