"""Filters, id mapping and rescaling of interaction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import ITEM, RATING, ROWS_PER_TASK, USER, rank_rows, require_columns, stable


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def min_rating_filter(df: DataFrame, min_rating: int = 1, by: str = "user", user: str = USER, item: str = ITEM) -> DataFrame:
    """Rows whose user (or item) has at least ``min_rating`` rows."""
    require_columns(df, user, item)
    if by not in ("user", "item"):
        raise ValueError("by should be 'user' or 'item'")
    if min_rating < 1:
        raise ValueError("min_rating should be at least 1")
    key = user if by == "user" else item
    kept = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rating).select(key)
    return df.join(kept, key, "left_semi")


def k_core(df: DataFrame, n: int, user: str = USER, item: str = ITEM, max_rounds: int = 1_000) -> DataFrame:
    """Drop items, then users, with fewer than n rows until nothing changes.

    Every round is checkpointed, so the plan stays short and a lost executor costs one round at most.
    """
    current = stable(df)
    size = current.count()
    for _ in range(max_rounds):
        current = stable(min_rating_filter(min_rating_filter(current, n, "item", user, item), n, "user", user, item))
        now = current.count()
        if now == size:
            return current
        size = now
    raise RuntimeError(f"no stable core after {max_rounds} rounds")


def anti_filter(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose key is not in the other frame."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def index_ids(df: DataFrame, name: str, out: str = "index", limit: int = ROWS_PER_TASK) -> DataFrame:
    """Map of the distinct values of a column to 0, 1, 2, ... in sort order."""
    ids = rank_rows(df.select(name).dropna().distinct(), [], [(name, True)], out, limit=limit)
    return ids.withColumn(out, F.col(out) - 1)


def apply_index(df: DataFrame, ids: DataFrame, name: str, out: str, how: str = "inner") -> DataFrame:
    """Add the index of a column; ids that are not in the map are dropped (or null with ``how='left'``)."""
    return df.join(ids.select(name, F.col(ids.columns[-1]).alias(out)), name, how)


def index_interactions(df, user=USER, item=ITEM, rating=RATING) -> DataFrame:
    """Interactions with a positive rating as (user_index, item_index, rating)."""
    used = df.filter(F.col(rating) > 0)
    both = apply_index(apply_index(used, index_ids(used, user), user, "user_index"), index_ids(used, item), item, "item_index")
    return both.select("user_index", "item_index", rating)


def vocab(df: DataFrame, name: str, first: int = 1, out: str = "index", limit: int = ROWS_PER_TASK) -> DataFrame:
    """Values with their frequency and an id by falling frequency, counted from ``first`` (0 is left for 'unknown')."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("freq"))
    ranked = rank_rows(counts, [], [("freq", False), (name, True)], out, limit=limit)
    return ranked.withColumn(out, F.col(out) - 1 + first)


def binarize(x, threshold: float) -> Column:
    """1.0 above the threshold, else 0.0."""
    return F.when(_c(x) > threshold, 1.0).otherwise(0.0)


def rescale(df, name, new_min=0.0, new_max=1.0, data_min=None, data_max=None, out="rescaled") -> DataFrame:
    """Map a column linearly to a new range; the observed range is used where none is given."""
    low = F.lit(float(data_min)) if data_min is not None else df.agg(F.min(name)).scalar()
    high = F.lit(float(data_max)) if data_max is not None else df.agg(F.max(name)).scalar()
    share = F.try_divide(F.col(name) - low, high - low)
    return df.withColumn(out, share * (new_max - new_min) + new_min)


def exponential_decay(value, newest, half_life: float) -> Column:
    """min(1, 0.5 ** ((newest - value) / half_life))."""
    return F.least(F.lit(1.0), F.pow(F.lit(0.5), (_c(newest) - _c(value)) / half_life))


def mean_center(df, train=None, rating=RATING, out="centered") -> DataFrame:
    """Rating minus the mean rating of the training table."""
    middle = (df if train is None else train).agg(F.avg(rating)).scalar()
    return df.withColumn(out, F.col(rating) - middle)


def sparsity(df, user=USER, item=ITEM, rating=RATING) -> DataFrame:
    """Size of the user x item matrix and the percentage of empty cells, without building it."""
    cells = df.filter(F.col(rating) != 0)
    users = df.select(user).distinct().agg(F.count(F.lit(1)).alias("n_users"))
    items = df.select(item).distinct().agg(F.count(F.lit(1)).alias("n_items"))
    filled = cells.select(user, item).distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    size = filled.select("n_cells", users.scalar().alias("n_users"), items.scalar().alias("n_items"))
    share = 1 - F.col("n_cells") / (F.col("n_users").cast("double") * F.col("n_items"))
    return size.withColumn("sparsity", share * 100)


def user_item_sets(df, user=USER, item=ITEM) -> DataFrame:
    """Distinct items of each user, sorted. One row per user: its array is as long as the user's item set."""
    return df.groupBy(user).agg(F.sort_array(F.collect_set(item)).alias("items"))


def normalize_rating(df, rating=RATING, out="target") -> DataFrame:
    """Rating over the root of the sum of squares of all whole ratings from the lowest to the highest."""
    low = df.agg(F.min(rating).cast("double")).scalar()
    high = df.agg(F.max(rating).cast("double")).scalar()

    def squares(n):
        return n * (n + 1) * (2 * n + 1) / 6

    return df.withColumn(out, F.col(rating) / F.sqrt(squares(high) - squares(low - 1)))


def like_target(rating, threshold: float = 3.0) -> Column:
    """1 when the rating is above the threshold, else 0."""
    return F.when(_c(rating) > threshold, 1).otherwise(0)
