"""Odd ids, empty tables and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from agrispark.llm import katz, language, media, mixing, neardup, phrases, pieces, quality, repeats, tokencount
from agrispark.llm.folds import fold
from agrispark.llm.queries import QUERIES
from agrispark.llm.sql import SQL

PIECES, MERGES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def labels(frame):
    return frame.select("doc_id", F.lit(1).alias("quality")).limit(0)


OPERATORS = {
    1: lambda d: pieces.round_trip(d, PIECES),
    2: mixing.mix,
    3: lambda d: katz.scores(d, fold(F.col("doc_id"), 5) == 1),
    4: lambda d: neardup.near_duplicates(d, 2, 80),
    5: lambda d: quality.scored(d, labels(d), 0.3),
    6: phrases.fingerprint_pairs,
    8: lambda d: tokencount.count_tokens(d, MERGES, public_tokenizers.PATTERN, 1024),
    9: media.document_media,
    10: lambda d: language.predicted(d, fold(F.col("doc_id"), 4) == 2),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_odd_ids_keep_every_row(with_odd_ids, n):
    got = OPERATORS[n](with_odd_ids)
    wanted = sorted(str(r["doc_id"]) for r in with_odd_ids.collect())
    assert sorted(str(r["doc_id"]) for r in got.collect()) == wanted


def test_odd_ids_in_repeats(with_odd_ids):
    got = repeats.removals(with_odd_ids).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in with_odd_ids.collect())
    unnamed = sorted((r["n_words"], r["n_removed"]) for r in got if r["doc_id"] is None)
    assert unnamed == sorted((len((r["text"] or "").encode().split()), 0) for r in with_odd_ids.filter("doc_id IS NULL").collect())


def test_repeated_rows_without_words_stay_apart(spark):
    rows = [(1, "", "a"), (1, "", "a"), (1, "", "a"), (2, "two words", "a"), (2, "two words", "a"), (None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    assert sum(r["taken"] for r in got) == 6


def test_rows_without_ids_take_and_lose_no_windows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage), (None, passage), (5, "a b " + passage), (7, passage + " c")]
    got = repeats.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("5", 62, 0), ("7", 61, 60), ("None", 60, 0), ("None", 60, 0)]


def test_rest_of_odd_ids_in_repeats(with_odd_ids):
    assert repeats.without_repeats(with_odd_ids).filter("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("n", [*OPERATORS, 7])
def test_empty_tables_give_empty_results(empty, n):
    assert (OPERATORS | {7: repeats.removals})[n](empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_queries_cover_every_document(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    if name == "op11_vector_codes":
        assert sorted(r[0] for r in got.select("vec_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
        return
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in documents.select("doc_id").collect())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_pipeline_stages_keep_columns_and_take_effect(spark, docs, empty):
    stages = dict(corpus_pipeline.STAGES)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = stages["language ID"](spark, plain, SF)
    assert found.columns == plain.columns and found.count() < plain.count()
    assert {r["doc_id"] for r in found.filter("text IS NULL OR text = '' OR text = '...'").collect()} == set()
    unique = stages["MinHash near-dedup"](spark, plain, SF)
    assert unique.count() < plain.count()
    cut = stages["substring dedup"](spark, plain, SF)
    assert cut.select(F.sum(F.length("text"))).first()[0] < plain.select(F.sum(F.length("text"))).first()[0]
    assert cut.filter("length(text) != n_chars").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        if name != "SentencePiece":
            assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.filter("NOT same").count() == 0
    assert os.path.exists(f"{SF}/documents.parquet")
