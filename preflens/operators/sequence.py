"""User histories and features of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preflens.frames import ITEM, ROWS_PER_TASK, SEED, TIMESTAMP, USER, rank_rows, top_k
from preflens.functions.arrays import left_pad, right_pad
from preflens.operators.negatives import draw_unseen
from preflens.operators.prep import index_ids

DAY = 86_400
CHUNK = 10_000  # rows of a user handled together when histories have a length limit


def instances(reviews, meta, default_cate="default_cat", user=USER, item=ITEM, timestamp=TIMESTAMP, cate="cate") -> DataFrame:
    """(label, user, item, timestamp, cate): every review with the category of its item."""
    joined = reviews.select(user, item, timestamp).join(meta.select(item, cate), item, "left")
    return joined.select(F.lit(1).alias("label"), user, item, timestamp, F.coalesce(cate, F.lit(default_cate)).alias(cate))


def expanding_history(
    df, order: Sequence[str], fields: Sequence[str], max_len: int | None = None, min_len=1, user=USER,
    label: str | None = None, limit=ROWS_PER_TASK,
) -> DataFrame:
    """Add ``history``: the earlier rows of the user (array of structs of ``fields``), oldest first.

    With ``max_len`` only that many rows before are kept, and a user is worked on in chunks that overlap
    by as many rows, so a very long history is spread over tasks. Without it the result itself grows with
    the square of a user's rows. Rows with a ``label`` other than 1 enter no history.
    """
    entry = F.struct(*fields)
    if label is not None:
        entry = F.when(F.col(label) == 1, entry)
    sort = [F.col(c) for c in order]
    if max_len is None:
        before = Window.partitionBy(user).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        out = df.withColumn("history", F.collect_list(entry).over(before))
    else:
        size = max(CHUNK, 2 * max_len)
        ranked = rank_rows(df, [user], [(c, True) for c in order], "_pos", limit=limit).withColumn("_pos", F.col("_pos") - 1)
        own = F.floor(F.col("_pos") / size)
        lead_in = F.col("_pos") % size >= size - max_len
        chunks = F.when(lead_in, F.array(own, own + 1)).otherwise(F.array(own))
        copies = ranked.withColumn("_own", own).withColumn("_chunk", F.explode(chunks)).repartition(F.col(user), F.col("_chunk"))
        before = Window.partitionBy(user, "_chunk").orderBy("_pos").rowsBetween(-max_len, -1)
        out = copies.withColumn("history", F.collect_list(entry).over(before)).filter(F.col("_own") == F.col("_chunk"))
        out = out.drop("_pos", "_own", "_chunk")
    return out.filter(F.size("history") >= min_len)


def final_history(
    df, order: Sequence[str], fields: Sequence[str], part="part", max_len: int | None = None, min_len=1, user=USER,
    limit=ROWS_PER_TASK,
) -> DataFrame:
    """Last row of each user in each part, with the user's earlier rows (the last ``max_len``) as history."""
    ranked = rank_rows(df, [user], [(c, True) for c in order], "_pos", limit=limit)
    last = ranked.groupBy(user, part).agg(F.max("_pos").alias("_end"))
    past = ranked.select(user, "_pos", F.struct("_pos", *fields).alias("_e")).join(last, user)
    inside = F.col("_pos") < F.col("_end")
    if max_len is not None:
        inside = inside & (F.col("_pos") >= F.col("_end") - max_len)
    lists = past.filter(inside).groupBy(user, part, "_end").agg(F.sort_array(F.collect_list("_e")).alias("_h"))
    entries = F.transform("_h", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    out = ranked.withColumnRenamed("_pos", "_end").join(lists.withColumn("history", entries).drop("_h"), [user, part, "_end"])
    return out.drop("_end").filter(F.size("history") >= min_len)


# ---------------------------------------------------------------- time features of one instance


def _log_days(seconds: Column) -> Column:
    return F.ln(F.greatest(seconds / DAY, F.lit(0.5)))


def time_diff(times, now) -> Column:
    """Log days from each event to the next one, the current event after the last."""
    nexts = F.concat(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.array(F.col(now)))
    return F.zip_with(F.col(times), nexts, lambda a, b: _log_days(b - a))


def time_from_first(times, now) -> Column:
    """Log days from the first event to every later one and to the current event."""
    later = F.concat(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.array(F.col(now)))
    return F.transform(later, lambda t: _log_days(t - F.col(times)[0]))


def time_to_now(times, now) -> Column:
    return F.transform(times, lambda t: _log_days(F.col(now) - t))


def pad_sequence(values, size: int, fill=0, left=False) -> Column:
    """Last ``size`` values, filled up with ``fill``."""
    last = F.slice(values, F.greatest(F.size(values) - size + 1, F.lit(1)), F.lit(size))
    return left_pad(last, size, F.lit(fill)) if left else right_pad(last, size, F.lit(fill))


def pad_mask(values, size: int, left=False) -> Column:
    """1 where a padded sequence holds a value, else 0."""
    used = F.least(F.size(values), F.lit(size))
    ones, zeros = F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(size) - used)
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def pad_sequences(df, name: str, size: int, fill=0, left=False, min_len=1) -> DataFrame:
    """Cut and pad an array column and add its mask; shorter sequences than ``min_len`` are dropped."""
    kept = df.filter(F.size(name) >= min_len)
    return kept.withColumns({name: pad_sequence(name, size, fill, left), f"{name}_mask": pad_mask(name, size, left)})


def next_item_rows(df, order: Sequence[str], max_len=50, seed=SEED, user=USER, item=ITEM, limit=ROWS_PER_TASK) -> DataFrame:
    """(user, slot, input, pos, neg): the last ``max_len`` steps of a user with the item that follows and an
    unseen item. Slots are those of a left-padded sequence; a user with one row has none."""
    latest = top_k(df.select(user, item, *[c for c in order if c != item]), [user], [F.col(c).desc() for c in order], max_len + 1, "_back")
    steps = latest.select(user, (max_len + 1 - F.col("_back")).alias("slot"), F.col(item).alias("input"))
    follow = steps.select(user, (F.col("slot") - 1).alias("slot"), F.col("input").alias("pos"))
    pairs = steps.join(follow, [user, "slot"])
    need = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    drawn = draw_unseen(need, df, index_ids(df, item), (), seed, True, user, item, limit)
    drawn = drawn.select(user, (F.lit(max_len - 1) - F.col("j")).cast("int").alias("slot"), F.col(item).alias("neg"))
    return pairs.join(drawn, [user, "slot"]).select(user, "slot", "input", "pos", "neg")


def history_padded(df, history, size: int, fill=0) -> Column:
    """First ``size`` entries of a history, filled on the left."""
    kept = F.slice(history, 1, size)
    return F.concat(F.array_repeat(F.lit(fill), F.lit(size) - F.size(kept)), kept)


def attach_item_arrays(
    candidates, clicks, arrays, order: Sequence[str], history_size: int, array_size: int, user=USER, item=ITEM, vec="indices"
) -> DataFrame:
    """Candidates with the array of their item and the arrays of the user's last clicks.

    An unknown item has zeros; a short history is filled on the right with rows of zeros.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), array_size)
    known = arrays.select(item, F.col(vec).cast("array<long>").alias("_a"))
    recent = top_k(clicks.select(user, item, *[c for c in order if c != item]), [user], [F.col(c).desc() for c in order], history_size, "_back")
    cells = F.struct((-F.col("_back")).alias("o"), F.coalesce("_a", zeros).alias("a"))
    rows = recent.join(known, item, "left").groupBy(user).agg(F.sort_array(F.collect_list(cells)).alias("_h"))
    past = rows.select(user, right_pad(F.col("_h.a"), history_size, zeros).alias("history_arrays"))
    out = candidates.join(known, item, "left").withColumn("item_array", F.coalesce("_a", zeros)).drop("_a")
    empty = F.array_repeat(zeros, history_size)
    return out.join(past, user, "left").withColumn("history_arrays", F.coalesce("history_arrays", empty))
