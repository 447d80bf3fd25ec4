"""Click logs, news logs, product reviews and paper metadata; writers of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preflens.operators.text import words

N_INTS, N_CATS = 13, 26


def click_log_schema() -> T.StructType:
    """label, 13 integers, 26 categories."""
    fields = [T.StructField("label", T.IntegerType())]
    fields += [T.StructField(f"int{i:02d}", T.IntegerType()) for i in range(N_INTS)]
    fields += [T.StructField(f"cat{i:02d}", T.StringType()) for i in range(N_CATS)]
    return T.StructType(fields)


def read_click_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=click_log_schema())


# ---------------------------------------------------------------- news


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="imp string, user string, time string, clicks string, impressions string")


def _shown(impressions="impressions"):
    return F.filter(F.split(F.coalesce(impressions, F.lit("")), " "), lambda x: x != "")


def impression_rows(behaviors: DataFrame, keys: Sequence[str] = ("imp", "user")) -> DataFrame:
    """(keys, pos, item, label) for every shown item 'id-0' / 'id-1'; ids may hold '-'."""
    rows = behaviors.select(*keys, F.posexplode(_shown()).alias("pos", "_x"))
    return rows.select(
        *keys, "pos", F.regexp_extract("_x", r"^(.*)-[01]$", 1).alias("item"),
        F.regexp_extract("_x", r"-([01])$", 1).cast("int").alias("label"),
    )


def parse_impressions(behaviors: DataFrame) -> DataFrame:
    """Clicked and not clicked items of each impression, with the history as a list."""
    def with_label(n):
        marked = F.filter(_shown(), lambda x: x.endswith(f"-{n}"))
        return F.transform(marked, lambda x: F.regexp_extract(x, r"^(.*)-[01]$", 1))

    clicks = F.filter(F.split(F.coalesce("clicks", F.lit("")), " "), lambda x: x != "")
    return behaviors.select("imp", "user", "time", clicks.alias("clicks"), with_label(1).alias("pos"), with_label(0).alias("neg"))


def _moment(name: str) -> Column:
    text = F.col(name).cast("string")
    number = F.expr(f"try_cast(cast({name} AS string) AS double)")
    clock = F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(text))
    return F.coalesce(number, F.unix_micros(clock) / 1e6)


def user_history(behaviors: DataFrame, part: str) -> DataFrame:
    """(user, clicks): the last history of each user as a comma list, the user id prefixed with the part.

    Times are numbers, timestamps or text such as ``11/9/2019 11:05:58 PM``; impressions of one time follow their number.
    """
    order = F.struct(_moment("time"), F.expr("try_cast(imp AS bigint)"), F.col("imp").cast("string"))
    last = behaviors.groupBy("user").agg(F.max_by("clicks", order).alias("clicks"))
    commas = F.replace(F.coalesce("clicks", F.lit("")), F.lit(" "), F.lit(","))
    return last.select(F.concat(F.lit(f"{part}_"), F.col("user").cast("string")).alias("user"), commas.alias("clicks"))


ENTITIES = T.ArrayType(T.StructType([
    T.StructField("SurfaceForms", T.ArrayType(T.StringType())), T.StructField("WikidataId", T.StringType()),
]))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Article file with the words of the title and the entities of title and abstract."""
    names = ("id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
    raw = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names))
    return parse_news(raw)


def parse_news(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "words": words("title"),
        "title_entities": F.from_json("title_entities", ENTITIES),
        "abstract_entities": F.from_json("abstract_entities", ENTITIES),
    })


def entity_rows(news: DataFrame, entities="title_entities") -> DataFrame:
    """(id, surface, entity) rows."""
    rows = news.select("id", F.explode(entities).alias("_e"))
    return rows.select("id", F.explode("_e.SurfaceForms").alias("surface"), F.col("_e.WikidataId").alias("entity"))


# ---------------------------------------------------------------- products


def project_json(df: DataFrame, name: str, schema: str) -> DataFrame:
    """Fields of a JSON text column beside the other columns; broken JSON gives nulls."""
    parsed = df.withColumn("_j", F.from_json(name, schema))
    return parsed.select(*[c for c in df.columns if c != name], "_j.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("reviewerID string, asin string, unixReviewTime long").json(path)


def read_product_meta(spark: SparkSession, path: str) -> DataFrame:
    schema = "asin string, title string, categories array<array<string>>, related map<string, array<string>>"
    return spark.read.schema(schema).json(path)


def last_category(meta: DataFrame) -> DataFrame:
    """(asin, cate): the last entry of the first category path."""
    path = F.get("categories", F.lit(0))
    return meta.select("asin", F.try_element_at(path, F.lit(-1)).alias("cate"))


def lower_strings(df: DataFrame) -> DataFrame:
    """All string columns in lower case."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.lower(n) for n in names})


# ---------------------------------------------------------------- papers


def dedupe_then_dropna(df: DataFrame, id_cols: Sequence[str], required: Sequence[str], order: str) -> DataFrame:
    """For each id column in turn keep the row with the smallest ``order`` (unique) per value, then drop rows
    with a null or empty required column. Copies are reduced to one number before the shuffle; long texts are
    compared by their sha-256."""
    out = df
    for name in id_cols:
        key = F.sha2(name, 256) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)
        first = out.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
        out = out.join(first, order, "left_semi")
    for name in required:
        full = F.col(name).isNotNull()
        if isinstance(df.schema[name].dataType, T.StringType):
            full = full & (F.col(name) != "")
        out = out.filter(full)
    return out


def with_text(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a non-empty text, fixed columns."""
    return df.filter(F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0).select(*columns)


# ---------------------------------------------------------------- sinks


def write_table(df: DataFrame, path: str, fmt="parquet", mode="error", partition_by: Sequence[str] = (), **options) -> None:
    """Write a result in parallel as parquet, csv, json, orc or (one column) text."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
