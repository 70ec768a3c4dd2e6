"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from saleslens.llm import (
    decontamination,
    hard_negatives,
    language,
    link_trust,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    variants,
)
from saleslens.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("class_fp")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judged(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_decontamination,
        op2_language_id,
        op3_quality_rules,
        op4_simhash,
        op5_pii_surrogates,
        op6_quality_classifier,
        op7_packing,
        op8_secret_scan,
        op9_sharding,
        op10_link_trust,
        op11_spelling_variants,
        op12_mixing,
        op13_hard_negatives,
    )
} | {"pipeline": corpus_pipeline.run}
