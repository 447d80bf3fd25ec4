"""Rating tables and item tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preflens.frames import ITEM, RATING, SEED, TIMESTAMP, USER, unit_hash

DEFAULT_HEADER = (USER, ITEM, RATING, TIMESTAMP)
TYPES = (T.IntegerType(), T.IntegerType(), T.FloatType(), T.LongType())
# The genre flags of an item file in their order.
GENRES = (
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
    "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
)


def rating_schema(names: Sequence[str] = DEFAULT_HEADER) -> T.StructType:
    """Schema of 2 to 4 columns; more names are cut off with a warning."""
    if not names:
        raise ValueError("at least one column name is needed")
    if len(names) > 4:
        warnings.warn("only the first four columns are used", stacklevel=2)
    return T.StructType([T.StructField(n, t) for n, t in zip(names[:4], TYPES)])


def read_ratings(spark: SparkSession, path: str, sep="\t", header=False, names=DEFAULT_HEADER) -> DataFrame:
    """Delimited rating file ('\\t', '::' or ',') with the given column names."""
    schema = rating_schema(names)
    return spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=True)


def cast_ratings(df: DataFrame, names=DEFAULT_HEADER) -> DataFrame:
    """A table that already has the columns, brought to the rating types."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, TYPES)])


def genres(flags: Sequence[str], labels: Sequence[str] = GENRES) -> Column:
    """Labels of the 0/1 columns that are set, joined by '|'."""
    names = F.array(*[F.when(F.col(c).cast("int") == 1, F.lit(g)) for c, g in zip(flags, labels)])
    return F.array_join(names, "|")


def title_year(title) -> Column:
    """Year in the last pair of brackets of 'name (year)'; null when that is no number."""
    pieces = F.split(title, "[()]")
    piece = F.try_element_at(pieces, F.lit(-2))
    return F.when(piece.rlike("^[0-9]+$"), piece)


def read_items(spark, path, sep="|", with_genres=True, item=ITEM) -> DataFrame:
    """Item file: id, title, release date, video date, url and 19 genre flags."""
    flags = [f"g{i}" for i in range(len(GENRES))]
    fields = [(item, T.IntegerType()), ("title", T.StringType())]
    fields += [(n, T.StringType()) for n in ("release", "video", "url", *flags)]
    raw = spark.read.csv(path, sep=sep, encoding="ISO-8859-1", schema=T.StructType([T.StructField(n, t) for n, t in fields]))
    columns = [F.col(item), F.col("title"), title_year("title").alias("year")]
    return raw.select(*columns, *([genres(flags).alias("genres")] if with_genres else []))


def enrich_items(ratings: DataFrame, items: DataFrame, item=ITEM, how="left") -> DataFrame:
    """Ratings with the columns of their item."""
    return ratings.join(items, item, how)


def mock_interactions(spark: SparkSession, size=100, seed=SEED, n_ids=50, with_genre=False) -> DataFrame:
    """Made-up ratings for tests: unique (user, item), ids 1 .. n_ids, ratings 1 .. 5."""
    if size > n_ids * n_ids:
        raise ValueError(f"at most {n_ids * n_ids} distinct pairs exist")
    cell = F.pmod(F.col("id") * 1_000_003, F.lit(n_ids * n_ids))  # a prime step meets every cell once
    df = spark.range(size).select((F.floor(cell / n_ids) + 1).cast("int").alias(USER), (cell % n_ids + 1).cast("int").alias(ITEM), "id")
    df = df.select(
        USER, ITEM,
        (F.floor(unit_hash(seed, F.lit("rating"), "id") * 5) + 1).cast("float").alias(RATING),
        F.floor(unit_hash(seed, F.lit("time"), "id") * 1_000_000_000).cast("long").alias(TIMESTAMP),
    )
    if not with_genre:
        return df
    pick = F.floor(unit_hash(seed, F.lit("genre"), ITEM) * len(GENRES)).cast("int")
    labels = F.array(*[F.lit(g) for g in GENRES])
    return df.withColumns({"title": F.concat(F.lit("Title "), F.col(ITEM).cast("string")), "genre": F.get(labels, pick)})
