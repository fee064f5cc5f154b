"""The corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Quality rules drop what they reject, the join keeps one document of each group of near copies, found
secrets are masked in the text, sources are mixed to target weights, and what is left is encoded and
decoded. Every stage but the last returns the columns of documents; each works on all that it gets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import jaccard_join, mixing, quality_rules, secrets, sentencepiece_codec
from eventloom.llm.common import labels, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels(spark, sf_dir)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.WEIGHTS, size=1.0, seed=1).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", mask_secrets),
    ("source mix", mix_sources),
    ("SentencePiece", encode),
]

#: Learned rules, set similarity and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i}")
    return docs
