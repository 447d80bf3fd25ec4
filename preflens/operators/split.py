"""Splits of interaction tables. Random order comes from a hash of the row's key, so a split never changes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import (
    ITEM, RATING, ROWS_PER_TASK, SEED, TIMESTAMP, USER, rank_rows, require_columns, top_k, unit_hash, weighted_key,
)
from preflens.operators.prep import min_rating_filter


def split_ratio(ratio: float | Sequence[float]) -> list[float]:
    """Shares of the parts, summing to 1. A float r means [r, 1 - r]."""
    if isinstance(ratio, (list, tuple)):
        if not ratio or any(r <= 0 for r in ratio):
            raise ValueError("split ratios have to be positive")
        whole = sum(ratio)
        return [r / whole for r in ratio]
    if not isinstance(ratio, float):
        raise TypeError("ratio should be a float or a list of floats")
    if not 0 < ratio < 1:
        raise ValueError("ratio has to lie between 0 and 1")
    return [ratio, 1 - ratio]


def _cut(df: DataFrame, share: Column, ratio) -> list[DataFrame]:
    """Parts of a frame by a share in (0, 1]; the last bound is exactly 1."""
    bounds = list(accumulate(split_ratio(ratio)))
    bounds[-1] = 1.0
    marked = df.withColumn("_share", share)
    parts, low = [], 0.0
    for high in bounds:
        part = marked.filter((F.col("_share") > low) & (F.col("_share") <= high))
        parts.append(part.drop("_share", "_rank", "_count", "_order"))
        low = high
    return parts


def random_split(df, ratio, seed=SEED, keys=(USER, ITEM)) -> list[DataFrame]:
    """Each row falls into a part by its own hash: no shuffle."""
    return _cut(df, F.lit(1.0) - unit_hash(seed, *keys), ratio)


def _by_column(by: str, user: str, item: str) -> str:
    if by not in ("user", "item"):
        raise ValueError("by should be 'user' or 'item'")
    return user if by == "user" else item


def _group_split(df, ratio, min_rating, by, order, user, item, limit):
    require_columns(df, user, item)
    group = _by_column(by, user, item)
    if min_rating < 1:
        raise ValueError("min_rating should be at least 1")
    if min_rating > 1:
        df = min_rating_filter(df, min_rating, by, user, item)
    ranked = rank_rows(df, [group], order, "_rank", "_count", limit)
    return _cut(ranked, F.col("_rank") / F.col("_count"), ratio)


def stratified_split(
    df, ratio=0.75, min_rating=1, by="user", seed=SEED, user=USER, item=ITEM, limit=ROWS_PER_TASK
) -> list[DataFrame]:
    """Random split inside each user (or item)."""
    df = df.withColumn("_order", unit_hash(seed, user, item))
    return _group_split(df, ratio, min_rating, by, [("_order", True), (user, True), (item, True)], user, item, limit)


def chrono_split(
    df, ratio=0.75, min_rating=1, by="user", user=USER, item=ITEM, timestamp=TIMESTAMP, limit=ROWS_PER_TASK
) -> list[DataFrame]:
    """Earlier rows of each user (or item) first; equal times are ordered by id."""
    require_columns(df, timestamp)
    tie = item if by == "user" else user
    return _group_split(df, ratio, min_rating, by, [(timestamp, True), (tie, True)], user, item, limit)


def timestamp_split(df, ratio=0.75, user=USER, item=ITEM, timestamp=TIMESTAMP, limit=ROWS_PER_TASK) -> list[DataFrame]:
    """Split along the time order of the whole table, ranked slice by slice."""
    require_columns(df, timestamp)
    order = [(timestamp, True), (user, True), (item, True)]
    ranked = rank_rows(df, [], order, "_rank", "_count", limit)
    return _cut(ranked, F.col("_rank") / F.col("_count"), ratio)


def cell_split(df, ratio=0.75, seed=SEED, user=USER, item=ITEM, rating=RATING, limit=ROWS_PER_TASK) -> list[DataFrame]:
    """Move round(n * whole-percent test share) of each user's non-zero cells to the test part."""
    percent = int((1 - ratio) * 100)
    cells = df.filter(F.col(rating) != 0).withColumn("_order", unit_hash(seed, user, item))
    ranked = rank_rows(cells, [user], [("_order", True), (item, True)], "_rank", "_count", limit)
    n_test = F.bround(F.col("_count") * percent / 100, 0)
    is_test = F.col("_rank") <= n_test
    return [ranked.filter(c).drop("_order", "_rank", "_count") for c in (~is_test, is_test)]


def leave_last_out(df, order: Sequence[str], user=USER, min_rows=3) -> DataFrame:
    """Mark the last row of a user 'test', the one before it 'valid', the rest 'train'.

    Users with fewer than ``min_rows`` rows stay in train (use 1 to switch that off).
    """
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("_count"))
    last = top_k(df.select(user, *order), [user], [F.col(c).desc() for c in order], 2, "_back")
    last = last.join(sizes, user).filter(F.col("_count") >= min_rows)
    marked = df.join(last.select(user, *order, "_back"), [user, *order], "left")
    part = F.when(F.col("_back") == 1, "test").when(F.col("_back") == 2, "valid").otherwise("train")
    return marked.withColumn("part", part).drop("_back")


def sample_items(df, rate: float, seed=SEED, item=ITEM) -> DataFrame:
    """Rows of int(n_items * rate) distinct items drawn in proportion to their frequency."""
    freq = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", weighted_key("_n", seed, item))
    ranked = rank_rows(freq, [], [("_key", True), (item, True)], "_rank", "_total")
    kept = ranked.filter(F.col("_rank") <= F.floor(F.col("_total") * rate)).select(item)
    return df.join(kept, item, "left_semi")
