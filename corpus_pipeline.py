"""The training-data pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame with the
columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflens.frames import ship
from preflens.llm import chunks, fourier, jaccard, packing, rules
from preflens.llm.store import new_path

#: The stages learn from labels and hash text; SQL cannot express them, tests compare them with plain versions.
ORACLE_SQL = None


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; null, empty and very short texts are among them."""
    return rules.keep_good(docs, labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the classifier's threshold go; without usable labels all stay."""
    return fourier.keep_good(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays (five words, 0.8 or more); rows without words or id stay, repeated rows of one id stay together."""
    ship(spark)
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that occur earlier; n_chars follows."""
    ship(spark)
    out = chunks.dedupe(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences; null and empty texts are pieces of one token."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages), ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what one returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
