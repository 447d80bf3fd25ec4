"""Diversity, novelty, serendipity and coverage of recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.frames import ITEM, RELEVANCE, USER, hot_groups, item_pairs, lanes, require_disjoint, require_rows, stable
from preflens.functions.arrays import cosine
from preflens.operators.cooccur import item_similarity

SET_SIZE = 2_000  # users of an item that go into one array
PASTS_PER_LIST, ROWS_PER_SETS = 1_000, 100_000  # sets in one row, training rows in one task
COOCCURRENCE, FEATURES = "item_cooccurrence_count", "item_feature_vector"


def cooccurrence_sim(train, user=USER, item=ITEM) -> DataFrame:
    """(i1, i2, sim) with i1 <= i2: users sharing both over the root of the product of their frequencies."""
    return item_similarity(train, "cosine", 1, user, item)


def cooccurrence_sim_of(pairs, train, user=USER, item=ITEM, set_size=SET_SIZE) -> DataFrame:
    """The same similarity for the pairs asked for (columns i1, i2), without those that share no user."""
    return with_cooccurrence_sim(pairs.select("i1", "i2").distinct(), train, user, item, set_size).filter("sim > 0")


def with_cooccurrence_sim(rows, train, user=USER, item=ITEM, set_size=SET_SIZE) -> DataFrame:
    """Adds ``sim`` to rows with columns i1 and i2; 0 where the items share no user.

    The users of an item are packed into one array, and a pair's common users are counted in place from the two arrays, so a pair
    stays one row. Items with more than ``set_size`` users have no array: for a pair with such an item the users of its rarer item
    are looked up one by one, on the key (user, item), which no hot item gathers in one task.
    """
    owned = stable(train.select(F.col(user).alias("_u"), F.col(item).alias("_i")).dropna().distinct())
    hot = hot_groups(owned, ["_i"], set_size)
    if hot is None:
        return _packed_sim(rows, owned)
    freq = owned.groupBy("_i").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = rows.join(freq.select(F.col("_i").alias("i1"), F.col("_n").alias("_a")), "i1", "left")
    rows = rows.join(freq.select(F.col("_i").alias("i2"), F.col("_n").alias("_b")), "i2", "left")
    is_hot = F.coalesce(F.greatest("_a", "_b") > set_size, F.lit(False))
    cold = _packed_sim(rows.filter(~is_hot).drop("_a", "_b"), owned.join(freq.filter(F.col("_n") <= set_size), "_i", "left_semi"))
    others = rows.filter(is_hot)
    asked = others.select("i1", "i2", "_a", "_b").dropna().distinct()
    found = others.drop("_a", "_b").join(_looked_up_sim(asked, owned), ["i1", "i2"], "left").na.fill(0.0, ["sim"])
    return cold.unionByName(found)


def _packed_sim(rows, owned) -> DataFrame:
    sets = owned.groupBy("_i").agg(F.collect_list("_u").alias("_set"))
    first = sets.select(F.col("_i").alias("i1"), F.col("_set").alias("_x"))
    second = sets.select(F.col("_i").alias("i2"), F.col("_set").alias("_y"))
    found = rows.join(first, "i1", "left").join(second, "i2", "left")
    common = F.when(F.col("i1") == F.col("i2"), F.size("_x")).otherwise(F.size(F.array_intersect("_x", "_y")))
    sim = common / F.sqrt(F.size("_x").cast("double") * F.size("_y"))
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return found.withColumn("sim", F.when(known, sim).otherwise(0.0)).drop("_x", "_y")


def _looked_up_sim(wanted, owned) -> DataFrame:
    rarer = F.col("_a") <= F.col("_b")
    asked = wanted.withColumns({"_i": F.when(rarer, F.col("i1")).otherwise(F.col("i2")), "_y": F.when(rarer, F.col("i2")).otherwise(F.col("i1"))})
    users = asked.join(owned, "_i").select("i1", "i2", "_a", "_b", "_u", F.col("_y").alias("_i"))
    counts = users.join(owned, ["_u", "_i"]).groupBy("i1", "i2", "_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
    return counts.select("i1", "i2", (F.col("_c") / F.sqrt(F.col("_a") * F.col("_b"))).alias("sim"))


def mean_past_sim(listed, train, user=USER, item=ITEM, relevance=RELEVANCE, set_size=SET_SIZE, pasts=PASTS_PER_LIST) -> DataFrame:
    """(user, item, relevance, _sim): mean co-occurrence similarity of each listed item to the user's training items.

    The user sets of all training items of a user come as one row and meet the set of each listed item there, so a set travels
    once a user and not once a pair. Users of over ``pasts`` items have several such rows. Pairs with an item of over ``set_size``
    users are looked up one by one, as in ``with_cooccurrence_sim``.
    """
    base = stable(train.select(F.col(user).alias("_u"), F.col(item).alias("_i")).filter("_u IS NOT NULL").distinct())
    owned, parts = base.dropna(), lanes(base.sparkSession, base.count(), ROWS_PER_SETS)
    n = F.count(F.lit(1)).cast("double").alias("_n")
    hot = hot_groups(owned, ["_i"], set_size)
    sets = (owned if hot is None else owned.join(hot, "_i", "left_anti")).groupBy("_i").agg(n, F.collect_list("_u").alias("_set"))
    if hot is not None:
        frequent = owned.join(hot, "_i", "left_semi").groupBy("_i").agg(n)
        sets = sets.unionByName(frequent.withColumn("_set", F.lit(None).cast(sets.schema["_set"].dataType)))
    asked = listed.groupBy(F.col(user).alias("_u"), F.col(item).alias("_j")).agg(F.first(relevance).alias("_rel"))
    asked = asked.join(sets.withColumnRenamed("_i", "_j"), "_j", "left")
    chunk = F.lit(0).cast("long")
    rows = base
    if hot_groups(base, ["_u"], pasts) is not None:
        rows = base.join(base.groupBy("_u").agg(F.ceil(F.count(F.lit(1)) / pasts).alias("_lists")), "_u")
        chunk = F.pmod(F.xxhash64("_i"), F.col("_lists"))
    past = rows.withColumn("_c", chunk).join(sets.select("_i", F.col("_set").alias("_x")), "_i", "left").repartition(parts, "_u")
    past = past.groupBy("_u", "_c").agg(F.collect_list("_x").alias("_sets"), F.count(F.lit(1)).alias("_m"), F.count("_i").alias("_k"))
    common = F.aggregate("_sets", F.lit(0.0), lambda s, x: s + F.size(F.array_intersect(x, "_set")) / F.sqrt(F.size(x).cast("double") * F.size("_set")))
    common = F.when(F.col("_set").isNotNull(), common).otherwise(0.0)
    # A null stands for the other item of its pair: alike if train knows that one.
    alone = F.when(F.col("_j").isNull(), F.col("_k")).when(F.col("_n").isNotNull(), F.col("_m") - F.col("_k")).otherwise(0)
    found = asked.repartition(parts, "_u").join(past, "_u").select("_u", "_j", "_rel", (common + alone).alias("_sum"), "_m")
    if hot is not None:
        known = owned.join(sets.select("_i", F.col("_n").alias("_b")), "_i").select("_u", F.col("_i").alias("i2"), "_b")
        pairs = asked.select("_u", F.col("_j").alias("i1"), "_rel", F.col("_n").alias("_a")).join(known, "_u")
        pairs = pairs.filter(F.col("_a").isNotNull() & (F.greatest("_a", "_b") > set_size))
        sims = _looked_up_sim(pairs.select("i1", "i2", "_a", "_b").distinct(), owned)
        more = pairs.join(sims, ["i1", "i2"]).select("_u", F.col("i1").alias("_j"), "_rel", F.col("sim").alias("_sum"), F.lit(0).cast("long").alias("_m"))
        found = found.unionByName(more)
    mean = (F.sum("_sum") / F.sum("_m")).alias("_sim")
    return found.groupBy(F.col("_u").alias(user), F.col("_j").alias(item)).agg(mean, F.first("_rel").alias(relevance))


def feature_sim(pairs, features, item=ITEM, vec="features") -> DataFrame:
    """(i1, i2, sim) cosine of feature vectors, for the pairs asked for instead of all pairs of items."""
    if features.schema[vec].dataType.typeName() == "vectorudt":
        from pyspark.ml.functions import vector_to_array

        features = features.withColumn(vec, vector_to_array(vec))
    v = features.select(item, F.col(vec).cast("array<double>").alias(vec))
    left = v.select(F.col(item).alias("i1"), F.col(vec).alias("_x"))
    right = v.select(F.col(item).alias("i2"), F.col(vec).alias("_y"))
    wanted = pairs.select("i1", "i2").distinct()
    return wanted.join(left, "i1").join(right, "i2").select("i1", "i2", cosine("_x", "_y").alias("sim"))


def _with_similarity(rows, train, features, measure, user, item):
    """Rows with columns i1 and i2, and their ``sim``; unknown pairs have 0."""
    if measure == COOCCURRENCE:
        return with_cooccurrence_sim(rows, train, user, item)
    if measure == FEATURES:
        if features is None:
            raise ValueError("item features are needed for this measure")
        return rows.join(feature_sim(rows, features, item), ["i1", "i2"], "left").na.fill(0.0, ["sim"])
    raise ValueError(f"unknown similarity measure {measure!r}")


def _check(train, reco, user, item) -> None:
    """Raise on an empty table and on recommended pairs that train holds."""
    require_rows(train, "train")
    require_rows(reco, "reco")
    require_disjoint(train, reco, [user, item])


def intralist_sim(train, reco, features=None, measure=COOCCURRENCE, user=USER, item=ITEM, check=False) -> DataFrame:
    """Mean similarity of the item pairs in each user's list; unknown pairs count 0. One-item lists have no row.

    ``check`` raises when a table is empty or a recommended pair is in train, here and in the metrics made from it.
    """
    if check:
        _check(train, reco, user, item)
    pairs = item_pairs(reco, [user], item, with_self=False)
    joined = _with_similarity(pairs, train, features, measure, user, item)
    return joined.groupBy(user).agg(F.avg("sim").alias("avg_il_sim"))


def user_diversity(train, reco, **options) -> DataFrame:
    user = options.get("user", USER)
    return intralist_sim(train, reco, **options).select(user, (1 - F.col("avg_il_sim")).alias("user_diversity"))


def diversity(train, reco, **options) -> DataFrame:
    return user_diversity(train, reco, **options).agg(F.avg("user_diversity").alias("diversity"))


def item_novelty(train, item=ITEM) -> DataFrame:
    """-log2 of each item's share of the training rows."""
    total = train.agg(F.count(F.lit(1))).scalar()
    counts = train.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(item, (-F.log2(F.col("_n") / total)).alias("item_novelty"))


def novelty(train, reco, item=ITEM) -> DataFrame:
    """Mean novelty of the recommended rows; an item unseen in train adds 0."""
    counts = reco.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(item_novelty(train, item), item, "left")
    value = F.sum(F.col("_n") * F.coalesce("item_novelty", F.lit(0.0))) / F.sum("_n")
    return joined.agg(value.alias("novelty"))


def user_item_serendipity(
    train, reco, features=None, measure=COOCCURRENCE, user=USER, item=ITEM, relevance=RELEVANCE, check=False,
):
    """(1 - mean similarity to the user's training items) x relevance, for each recommended row."""
    if check:
        _check(train, reco, user, item)
    listed = reco if relevance in reco.columns else reco.withColumn(relevance, F.lit(1.0))
    listed = listed.select(user, item, relevance)
    if measure == COOCCURRENCE:
        per_item = mean_past_sim(listed, train, user, item, relevance)
        return per_item.select(user, item, ((1 - F.col("_sim")) * F.col(relevance)).alias("user_item_serendipity"))
    past = train.select(user, F.col(item).alias("_past")).distinct()
    pairs = listed.join(past, user).withColumns({"i1": F.least(item, "_past"), "i2": F.greatest(item, "_past")})
    joined = _with_similarity(pairs, train, features, measure, user, item)
    per_item = joined.groupBy(user, item).agg(F.avg("sim").alias("_sim"), F.first(relevance).alias(relevance))
    return per_item.select(user, item, ((1 - F.col("_sim")) * F.col(relevance)).alias("user_item_serendipity"))


def user_serendipity(train, reco, **options) -> DataFrame:
    user = options.get("user", USER)
    return user_item_serendipity(train, reco, **options).groupBy(user).agg(
        F.avg("user_item_serendipity").alias("user_serendipity")
    )


def serendipity(train, reco, **options) -> DataFrame:
    return user_serendipity(train, reco, **options).agg(F.avg("user_serendipity").alias("serendipity"))


def catalog_coverage(train, reco, item=ITEM, approximate=False) -> DataFrame:
    """Distinct recommended items over distinct training items."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    known = train.agg(count(F.col(item))).scalar()
    return reco.agg((count(F.col(item)) / known).alias("catalog_coverage"))


def distributional_coverage(reco, item=ITEM) -> DataFrame:
    """Entropy in bits of the item shares of the recommended rows."""
    counts = reco.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / reco.agg(F.count(F.lit(1))).scalar()
    return counts.agg((-F.sum(share * F.log2(share))).alias("distributional_coverage"))
