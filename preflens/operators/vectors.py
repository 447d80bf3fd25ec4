"""Measures of vector pairs, their quality as link scores, and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import ROWS_PER_TASK, running
from preflens.functions import arrays
from preflens.operators.rating import auc


def cosine(x="x", y="y") -> Column:
    return arrays.cosine(x, y)


def adjusted_cosine(x="x", y="y") -> Column:
    """Cosine after each vector has lost its own mean."""
    return arrays.cosine(arrays.shift(x, arrays.mean(x)), arrays.shift(y, arrays.mean(y)))


def _differences(x, y) -> Column:
    return F.zip_with(F.col(x), F.col(y), lambda a, b: F.abs(a - b))


def euclidean(x="x", y="y") -> Column:
    return arrays.norm(_differences(x, y))


def manhattan(x="x", y="y") -> Column:
    return arrays.array_sum(_differences(x, y))


def chebyshev(x="x", y="y") -> Column:
    return F.array_max(_differences(x, y))


def hamming(x="x", y="y", threshold=0.5) -> Column:
    """Places where one value is above the threshold and the other is not."""
    return arrays.array_sum(
        F.zip_with(F.col(x), F.col(y), lambda a, b: ((a > threshold) != (b > threshold)).cast("double"))
    )


def jaccard(x="x", y="y") -> Column:
    """Shared over all positive places, 1e-7 added below."""
    both = arrays.array_sum(F.zip_with(F.col(x), F.col(y), lambda a, b: ((a > 0) & (b > 0)).cast("double")))
    either = arrays.array_sum(F.zip_with(F.col(x), F.col(y), lambda a, b: ((a > 0) | (b > 0)).cast("double")))
    return both / (either + 1e-7)


MEASURES = {
    "cosine": cosine, "adjusted_cosine": adjusted_cosine, "euclidean": euclidean, "manhattan": manhattan,
    "chebyshev": chebyshev, "hamming": hamming, "jaccard": jaccard,
}
DISTANCES = ("euclidean", "manhattan", "chebyshev", "hamming")  # small means similar


def pearson_global(pairs: DataFrame, x="x", y="y", out="score") -> DataFrame:
    """Cosine after each side has lost the mean of all its values."""
    def all_mean(c):
        return F.sum(arrays.array_sum(c)) / F.sum(F.size(c))

    # The means join as a one-row table: lambdas cannot hold scalar subqueries.
    means = pairs.agg(all_mean(x).alias("_mx"), all_mean(y).alias("_my")).withColumn("_one", F.lit(1))
    joined = pairs.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")
    score = arrays.cosine(arrays.shift(x, F.col("_mx")), arrays.shift(y, F.col("_my")))
    return joined.withColumn(out, score).drop("_one", "_mx", "_my")


def score_pairs(pairs, measure: str, x="x", y="y", out="score") -> DataFrame:
    if measure == "pearson":
        return pearson_global(pairs, x, y, out)
    return pairs.withColumn(out, MEASURES[measure](x, y))


def link_auc(pairs, measure="cosine", edge="edge", **options) -> DataFrame:
    """AUC of a measure against the edge label; distances are scored as they are, with a flag that small is good."""
    scored = score_pairs(pairs, measure, **options)
    return auc(scored.select(edge, "score"), edge, "score").withColumn("is_distance", F.lit(measure in DISTANCES))


def spearman(df: DataFrame, x: str, y: str, limit=ROWS_PER_TASK) -> DataFrame:
    """Rank correlation with mid-ranks. Equal (x, y) rows are counted first, so ties never travel as rows."""
    cells = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))

    def ranks(name, out):
        counts = cells.groupBy(name).agg(F.sum("_w").alias("_n"))
        upto = running(counts, [], [(name, True)], {"_upto": F.col("_n")}, limit=limit)
        return upto.select(name, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))

    both = cells.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    middle = (df.agg(F.count(F.lit(1))).scalar() + 1) / 2  # mean of all ranks
    dx, dy = rx - middle, ry - middle
    corr = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy)))
    return both.agg(corr.alias("spearman"))


# ---------------------------------------------------------------- vector tables


def l2_normalize(df, vec="vec") -> DataFrame:
    return df.withColumn(vec, arrays.l2_normalize(vec))


def column_center(df, vec="vec") -> DataFrame:
    """Vectors minus the mean vector of the table."""
    from pyspark.ml.stat import Summarizer

    mean = df.agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("_m")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")  # one row
    return joined.withColumn(vec, F.zip_with(vec, "_m", lambda a, m: a - m)).drop("_one", "_m")


def reduce_dims(df, k: int, vec="vec", out="reduced") -> DataFrame:
    """First k principal components, from centred vectors."""
    from pyspark.ml.feature import PCA

    data = column_center(df, vec).withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def one_hot(df, name: str, values: Sequence, out="one_hot") -> DataFrame:
    """0/1 array over given values."""
    return df.withColumn(out, F.array(*[(F.col(name) == v).cast("double") for v in values]))


def vector_lines(df, id_col, vec="vec", sep=" ", digits: int | None = None) -> DataFrame:
    """Text lines 'id<tab>v1 v2 ...'."""
    values = F.transform(vec, lambda v: F.round(v, digits)) if digits is not None else F.col(vec)
    text = F.concat_ws(sep, values.cast("array<string>"))
    return df.select(F.concat_ws("\t", F.col(id_col).cast("string"), text).alias("value"))
