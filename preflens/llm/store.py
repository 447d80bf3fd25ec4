"""Intermediate tables and small files in the folder that the cluster shares."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflens.frames import release, share_bytes, shared_folder  # noqa: F401


MOST_BITS = 1 << 28


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df_or_path) -> None:
    """Delete a kept table that no later result reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    context = spark.sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Give every executor, also one that joins later, a local copy of a small file; returns its name for ``SparkFiles.get``."""
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:16]}"
    path, new = share_bytes(spark, data, name)
    if new:
        spark.sparkContext.addFile(path)
    return name


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Rows of highest ``n``, ``limit`` at most, among those that occur twice.

    A histogram of the logarithm of n gives the cut, so no task sends its own top rows to the driver; a step of the histogram
    is taken whole or not at all.
    """
    counts = keep(counts.filter("n > 1"), "counts")
    step = F.floor(F.log2("n") * 64)
    taken, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # some thousand rows at most
        if taken + r["count"] > limit:
            break
        taken, cut = taken + r["count"], r["step"]
    return counts.filter(step >= cut) if cut is not None else counts.limit(0)


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each number of a column, in a table of ``MOST_BITS`` at most. Others may share it, none is lost."""
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * df.count()).bit_length()))
    folded = F.col(column).bitwiseXOR(F.shiftrightunsigned(column, 32)).bitwiseAND(F.lit(size - 1))
    parts = df.select(folded.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)  # size / 64 rows at most
    bits[parts.column("word").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return bits


def has_bit(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned number is set."""
    at = (numbers ^ (numbers >> np.uint64(32))) & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
