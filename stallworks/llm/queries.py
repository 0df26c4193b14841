"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallworks.llm import (
    hnsw_dedup, line_dedup, merkle_manifest, mixing, ngram_join, oracles, periodic_runs, quality_classifier, quality_rules, secret_scan,
    sentencepiece, substring_dedup, token_counts, url_trust,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language of a source is a repository of its owner, the source."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.secret_scan(_documents(spark, sf_dir), repository=repository, min_repositories=4)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoding_digest(_documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.planted_runs(_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_quality_rules, op3_quality_classifier, op4_embedding_near_dedup, op5_line_dedup,
     op6_ngram_join, op7_substring_dedup, op8_token_counts, op9_source_mixing, op10_sentencepiece, op11_url_filter, op12_periodic_runs, op13_merkle_manifest,
)}
ORACLES = {
    "op1_secret_scan": oracles.SECRETS, "op2_quality_rules": oracles.quality(), "op5_line_dedup": oracles.lines(),
    "op9_source_mixing": oracles.mixing_sql(), "op11_url_filter": oracles.urls(), "op13_merkle_manifest": oracles.MANIFEST,
}
