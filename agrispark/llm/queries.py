"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark.llm import (
    katz, language, media, mixing, neardup, phrases, pieces, quality, repeats, resampling, sharding, tokencount, veccodes,
)
from agrispark.llm.folds import fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(documents(spark, sf_dir), fold(F.col("doc_id"), 5) == 1)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.scored(documents(spark, sf_dir), labels, threshold=0.3)


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_pairs(documents(spark, sf_dir))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024
    )


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir), fold(F.col("doc_id"), 4) == 2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_resharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.grown(documents(spark, sf_dir))


def op13_importance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_ranks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_source_mix, op3_lm_scores, op4_near_duplicates, op5_quality, op6_phrase_fingerprints,
        op7_repeated_passages, op8_token_counts, op9_media_columns, op10_language, op11_vector_codes, op12_resharded,
        op13_importance_ranks,
    )
}
