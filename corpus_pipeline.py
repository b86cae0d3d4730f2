"""A training-corpus pipeline: every stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark.llm import language, mixing, neardup, pieces, repeats
from agrispark.llm.folds import fold
from agrispark.llm.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; texts without letters and ambiguous ones go."""
    return language.identified(docs, fold(F.col("doc_id"), 4) == 2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8."""
    return neardup.without_copies(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that a document with a smaller doc_id also has."""
    return repeats.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources by weights 5, 2, 1 to 150 % of all words; what is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every text and whether they decode to it again."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup),
    ("source mix", source_mix), ("SentencePiece", sentencepiece),
]
ORACLE_SQL = None  # neither learnt languages nor subword pieces can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
