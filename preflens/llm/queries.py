"""The registered queries of the operators in this folder, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflens.frames import ship
from preflens.llm import (
    archive, chunks, classlm, collocations, fourier, jaccard, language, mainblock, packing, resample, rules, transducer, weighted,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.held_out_scores(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("n_removed", F.size("removed").cast("long"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(table(spark, sf_dir, "pages"))


def op10_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_dynamic_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_best_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainblock.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_bitmask": op1_language_bitmask,
    "op2_decision_list": op2_decision_list,
    "op3_brown_classes": op3_brown_classes,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_fourier_quality": op5_fourier_quality,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_transducer_bpe": op8_transducer_bpe,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_trie_jaccard": op10_trie_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_dynamic_itemsets": op12_dynamic_itemsets,
    "op13_best_subsequence": op13_best_subsequence,
}

ORACLE_SQL: dict[str, str] = {"op10_trie_jaccard": jaccard.SQL, "op11_importance_resampling": resample.SQL, "op12_dynamic_itemsets": collocations.SQL}
