"""The subpackage's registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import centroids, decontamination, fingerprints, jaccard_join, langid, mixing, quality_rules, row_patterns, secrets, sentencepiece_codec, token_counts, token_files, toxicity
from eventloom.llm.common import documents, labels


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), rule="first")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mixing.WEIGHTS, size=1.0, seed=1)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), decontamination.benchmark(spark, sf_dir))


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_patterns.digest_matches(row_patterns.clicks(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(centroids.embeddings(spark, sf_dir))


ALL = (
    op1_sentencepiece, op2_toxicity, op3_fingerprints, op4_quality_rules, op5_token_counts, op6_language_id, op7_jaccard_join,
    op8_token_files, op9_secret_scan, op10_source_mix, op11_decontamination, op12_row_patterns, op13_centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_source_mix": mixing.mix_sql(mixing.WEIGHTS, 1.0, 1),
        "op11_decontamination": decontamination.DECONTAMINATE_SQL,
        "op12_row_patterns": row_patterns.VALLEY_SQL,
        "op13_centroids": centroids.cluster_sql(),
    }
