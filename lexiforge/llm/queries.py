"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, linededup, merkle, mixing, neardup, oracles, pieces, quality, secrets, tokencount, toxicity, urlfilter, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(_documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("text_hash")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_documents(spark, sf_dir), min_exact=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency_rules(_documents(spark, sf_dir)).drop("text_hash")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir), found=merkle.without_line_breaks())


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").alias("n_strict"), F.size("soft_terms").alias("n_soft"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_fingerprints, op3_sentencepiece, op4_token_counts, op5_mixing, op6_secrets, op7_minhash_neardup, op8_toxicity, op9_line_dedup, op10_quality_rules, op11_whitening, op12_merkle_manifest, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {
    "op5_mixing": oracles.MIXING,
    "op6_secrets": oracles.SECRETS,
    "op7_minhash_neardup": oracles.NEAR_DUPLICATES,
    "op10_quality_rules": oracles.QUALITY,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_url_filter": oracles.URL_FILTER,
}
