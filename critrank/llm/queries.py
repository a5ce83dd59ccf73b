"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (centroids, codes, decontamination, fingerprints, language, mixing, passages, scoring, sharding, simhash,
               templates, toxicity, urls)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.digest(_documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(_documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.digest(_documents(spark, sf_dir))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_documents(spark, sf_dir))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(_documents(spark, sf_dir))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_templates, op2_decontaminate, op3_fingerprints, op4_lm_score, op5_simhash_groups,
        op6_feistel_shards, op7_toxicity, op8_repeated_passages,
        op9_pfair_mix, op10_language, op11_centroids, op12_vector_codes,
        op13_url_filter)}

ORACLES: dict[str, str] = {"op1_line_templates": templates.ORACLE_SQL,
                           "op2_decontaminate": decontamination.ORACLE_SQL,
                           "op13_url_filter": urls.ORACLE_SQL}
