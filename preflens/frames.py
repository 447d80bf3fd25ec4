"""Building blocks shared by all operators: column names, checks, hashes, skew-safe ranks and pairs."""

from __future__ import annotations

import gc
import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER, ITEM, RATING, TIMESTAMP = "userID", "itemID", "rating", "timestamp"
PREDICTION, RELEVANCE, SIMILARITY = "prediction", "relevance", "similarity"
DEFAULT_K, DEFAULT_THRESHOLD, SEED = 10, 10, 42

# A group with more rows than this is never sorted by one task; it is cut into slices.
ROWS_PER_TASK = 4_000_000
# A basket with more items than this is paired block by block.
ITEMS_PER_BLOCK = 2_000


def session(name: str = "preflens", **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, adaptive plans, skew joins split)."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# ---------------------------------------------------------------- checks


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def has_columns(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)


def same_base_type(left: DataFrame, right: DataFrame, names: Sequence[str]) -> bool:
    """Do two frames hold the columns with the same kind of type (any integer, any float, else equal)?"""

    def kind(df: DataFrame, name: str) -> str:
        t = df.schema[name].dataType
        if isinstance(t, T.IntegralType):
            return "integer"
        if isinstance(t, T.FractionalType):
            return "fraction"
        return t.simpleString()

    return all(
        has_columns(df, names) for df in (left, right)
    ) and all(kind(left, n) == kind(right, n) for n in names)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise when the frame is empty (runs a one-row job)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise when both frames hold a common key (stops at the first one found)."""
    if not left.join(right.select(*keys), list(keys), "left_semi").isEmpty():
        raise ValueError(f"frames share rows on {', '.join(keys)}")


# ---------------------------------------------------------------- deterministic randomness


def unit_hash(seed, *keys) -> Column:
    """Uniform number in [0, 1) from md5 of the keys: repeatable, the same after a lost task."""
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def weighted_key(weight, seed, *keys) -> Column:
    """Sort key whose ascending order is a draw without replacement in proportion to the weight."""
    return -F.ln(F.greatest(unit_hash(seed, *keys), F.lit(2.0**-52))) / _col(weight)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------- lineage and size


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, deleted when the driver ends.

    Without that setting: the checkpoint folder of the context, else the warehouse, which every executor reaches too.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/preflens-{context.applicationId}")
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return path.toString()


def share_bytes(spark: SparkSession, data: bytes, name: str) -> tuple[str, bool]:
    """Write a small file to the shared folder; returns its path and whether it is new."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if fs.exists(path):
        return path.toString(), False
    out = fs.create(path, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i:i + (1 << 20)]))
    out.close()
    return path.toString(), True


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started (once per application)."""
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    path, new = share_bytes(spark, packed.getvalue(), f"{root.name}.zip")
    if new:
        spark.sparkContext.addPyFile(path)


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that Spark's own iterative learners can checkpoint, in the folder all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that is read more than once: it is made now, see ``saved``."""
    return saved(df)


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the folder all executors share and read it back, in columns and compressed.

    What the steps before it have shuffled is let go first.
    """
    release(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, keys: Sequence[str]) -> Iterator[DataFrame]:
    """A table that many joins on ``keys`` read: bucketed by them, it stays where it is. It is deleted at the end."""
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    name = f"preflens_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lanes(spark: SparkSession, size: int, per_task: int) -> int:
    """Partitions of about ``per_task`` units of work, one per core at least. Given to ``repartition`` they stay as they are, where
    adaptive execution would merge partitions that are small in bytes but heavy in work."""
    return max(spark.sparkContext.defaultParallelism, -(-int(size) // per_task))


def hot_groups(df: DataFrame, group: Sequence[str], limit: int, size: str | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None (one map-side combined count decides).

    ``size`` names a column of row counts to add up where they are known before the rows exist.
    """
    n = F.count(F.lit(1)) if size is None else F.sum(size)
    big = df.groupBy(*group).agg(n.alias("_n")).filter(F.col("_n") > limit)
    big = big.select(*group)
    return None if big.isEmpty() else big


# ---------------------------------------------------------------- ranks and running sums


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    sums: dict[str, Column],
    total: dict[str, Column] | None = None,
    limit: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums (and group totals) in the given order, safe for hot and for global groups.

    ``order`` lists (column, ascending); together with ``group`` it has to be unique per row.
    A count decides first: groups of at most ``limit`` rows use one window. A group over it - such as the
    whole table when ``group`` is empty, which is checkpointed - is cut along the order columns into ranges of
    about ``limit`` rows; each range is summed by its own task and the sums of the slices before it are added from
    a table of one row per slice. ``sizes`` (group, n) spares the count of costly rows.
    """
    total = total or {}
    group = list(group)
    if not group:
        whole = stable(df).withColumn("_all", F.lit(0))  # counted, sampled for the bounds and read: made once
        add = _running_plain if whole.count() <= limit else partial(_running_sliced, limit=limit)
        return add(whole, ["_all"], order, sums, total).drop("_all")
    hot = hot_groups(df, group, limit) if sizes is None else hot_groups(sizes, group, limit, "n")
    if hot is None:
        return _running_plain(df, group, order, sums, total)
    hot = F.broadcast(hot)  # at most rows / limit keys
    cold_part = _running_plain(same_keys(df, hot, group, "left_anti"), group, order, sums, total)
    hot_part = _running_sliced(same_keys(df, hot, group, "left_semi"), group, order, sums, total, limit)
    return cold_part.unionByName(hot_part)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, where null equals null; the keys of ``right`` are not repeated."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def _sort(order):
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _running_plain(df, keys, order, sums, total, base=None):
    part = Window.partitionBy(*keys)
    upto = part.orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, 0)
    new = {name: F.sum(c).over(upto) for name, c in sums.items()}
    new.update({name: F.sum(c).over(part) for name, c in total.items()})
    return df.withColumns(new)


def _running_sliced(df, group, order, sums, total, limit):
    cut = in_ranges(df, group, order, limit)
    keys = [*group, "_slice"]
    per_slice = cut.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in total.items()],
    )
    # One row per slice: a group has rows / limit of them, so this window is small.
    w = Window.partitionBy(*group)
    before = w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(w).alias(n) for n in total],
    )
    out = same_keys(_running_plain(cut, keys, order, sums, {}), offsets, keys, "inner")
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_slice", *[f"_b_{n}" for n in sums])


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], limit: int) -> DataFrame:
    """Add ``_slice``: the number of the range of (group, order) a row falls in, about ``limit`` rows each.

    Spark draws the bounds from the values of all columns, nulls included, and compares whole rows with them. The table is
    checkpointed: bounds of a second run could differ.
    """
    rows = df.count()
    ranged = df.repartitionByRange(max(1, -(-rows // limit)), *[F.col(g) for g in group], *_sort(order))
    return stable(ranged.withColumn("_slice", F.spark_partition_id()))


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    out: str = "rank",
    count: str | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based position of each row in its group (whole table when ``group`` is empty), optionally the group size."""
    one = F.lit(1).cast("long")
    return running(df, group, order, {out: one}, {count: one} if count else None, limit)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group with their rank; the window limit is applied before and after the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


# ---------------------------------------------------------------- pairs inside baskets


def item_pairs(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    with_self: bool = True,
    block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """Pairs (group, i1, i2) with i1 <= i2 of the distinct items in each group.

    Items are packed into arrays of at most about ``block`` items. A group that fits one array is
    unfolded in place, without a self join. A larger group is hashed into several arrays and every pair
    of arrays becomes its own join key, so the work of a hot group spreads over the cluster.
    """
    group = list(group)
    base = df.select(*group, F.col(item).alias("_i")).dropDuplicates()
    hot = hot_groups(base, group, block)
    if hot is None:
        return _unfold(_pack(base, group), group, with_self)
    sizes = base.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_nb")).filter(F.col("_nb") > 1)
    packed = (
        base.join(sizes, group, "left")
        .withColumn("_nb", F.coalesce("_nb", F.lit(1)))
        .withColumn("_c", F.pmod(F.xxhash64("_i"), F.col("_nb")))
    )
    blocks = _pack(packed, group + ["_nb", "_c"])
    inside = _unfold(blocks, group, with_self)
    many = blocks.filter(F.col("_nb") > 1)
    left = many.filter(F.col("_c") < F.col("_nb") - 1).select(
        *group, F.col("_c").alias("_c1"), F.explode(F.sequence(F.col("_c") + 1, F.col("_nb") - 1)).alias("_c2"),
        F.col("_items").alias("_a"),
    )
    right = many.filter(F.col("_c") > 0).select(
        *group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_c1"),
        F.col("_c").alias("_c2"), F.col("_items").alias("_b"),
    )
    across = left.join(right, group + ["_c1", "_c2"])
    across = across.select(*group, F.explode("_a").alias("_x"), "_b").select(*group, "_x", F.explode("_b").alias("_y"))
    across = across.select(*group, F.least("_x", "_y").alias("i1"), F.greatest("_x", "_y").alias("i2"))
    return inside.unionByName(across)


def _pack(df, keys):
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list("_i")).alias("_items"))


def _unfold(blocks, group, with_self):
    first = blocks.select(*group, "_items", F.posexplode("_items").alias("_p", "i1"))
    start = F.col("_p") + (1 if with_self else 2)
    rest = F.slice("_items", start, F.greatest(F.size("_items") - start + 1, F.lit(0)))
    return first.select(*group, "i1", F.explode(rest).alias("i2"))
