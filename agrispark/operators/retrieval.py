"""Sparse, dense and fused retrieval for tables of queries.

Corpus rows never meet queries in a Spark cross join. The sparse leg joins postings on terms, co-partitioned by
chunk so that pair scores are summed where they arise; the dense leg multiplies blocks of vectors with
blocks of query vectors and keeps the running best per query. Both legs shuffle only top-n candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.functions.numeric import let
from agrispark.rules import corpus as rc

QUERY_TERMS_PER_BLOCK = 500_000
QUERY_VECTORS_PER_BLOCK = 1_024
CORPUS_VECTORS_PER_BLOCK = 2_048
CHARS_PER_PART = 8_000_000  # text whose words one task counts, about
POSTINGS_PER_PART = 2_000_000  # postings, and pairs of chunk and query, that one task sums, about
MOST_PARTS = 10_000
SCORE_UNITS = 1e9  # sparse contributions are whole numbers of this fraction: their sums don't hang on any order
GRID = float(1 << 26)  # unit vectors are laid on this grid: products and their sums are whole numbers below 2**53, exact


@dataclass
class SparseIndex:
    """Stored postings (chunk_id, doc_len, term, tf), vocabulary (term, df) and the corpus numbers that go with them."""

    postings: DataFrame
    vocabulary: DataFrame
    chunks: int
    mean_length: float
    mean_raw_idf: float


def in_parts(frame: DataFrame, key: str, amount: int, each: int) -> DataFrame:
    """Rows by key in so many partitions that each has about ``each`` of the amount: a task's memory doesn't grow with it."""
    parts = -(-amount // each)
    if parts <= 1:
        return frame.repartition(key)
    return frame.repartition(max(min(parts, MOST_PARTS), frame.sparkSession.sparkContext.defaultParallelism), key)


def text_size(chunks: DataFrame) -> int:
    return chunks.agg(F.sum(F.length("text"))).first()[0] or 0


def build_index(chunks: DataFrame, path: str) -> SparseIndex:
    """Tokenise once and store postings and vocabulary; corpus size and lengths are observed in the same passes.

    Texts are shuffled by chunk id before they are split, so the larger exploded postings are counted in place.
    """
    spark = chunks.sparkSession
    sizes, idfs = Observation(), Observation()
    placed = in_parts(chunks.select("chunk_id", "text"), "chunk_id", text_size(chunks), CHARS_PER_PART)
    lengths = placed.select("chunk_id", tx.tokens(F.col("text")).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))
    counted = lengths.observe(sizes, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length"))
    (
        counted.select("chunk_id", "doc_len", F.explode("tokens").alias("term"))
        .groupBy("chunk_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
        .write.mode("overwrite").parquet(f"{path}/postings")
    )
    postings = spark.read.parquet(f"{path}/postings")
    n, length = sizes.get["n"], sizes.get["length"]
    frequencies = document_frequency(postings).observe(idfs, F.avg(raw_idf(n)).alias("mean"))
    frequencies.write.mode("overwrite").parquet(f"{path}/vocabulary")
    return SparseIndex(postings, spark.read.parquet(f"{path}/vocabulary"), n, length / n if n else 0.0, idfs.get["mean"] or 0.0)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def raw_idf(chunks: int) -> Column:
    return F.log(F.lit(chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf(index: SparseIndex) -> DataFrame:
    """(term, df, idf); a negative idf becomes a quarter of the mean over the whole vocabulary."""
    raw = raw_idf(index.chunks)
    floor = F.lit(index.mean_raw_idf * rc.BM25_EPSILON)
    return index.vocabulary.select("term", "df", F.when(raw < 0, floor).otherwise(raw).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf): repeated terms count again."""
    return (
        queries.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    )


def blocks_by(frame: DataFrame, key: str, rows: int, limit: int) -> list[DataFrame]:
    """Hash blocks by the query's id or number, each expected to stay within the limit."""
    n = max(1, -(-rows // limit))
    if n == 1:
        return [frame]
    return [frame.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def top_n(scored: DataFrame, n: int, score: str) -> DataFrame:
    """First n rows per query by score, then chunk id, with a 1-based rank."""
    best = W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def saturation(index: SparseIndex) -> Column:
    """What term frequency and length make of a posting, before the query's weight."""
    k1, b = rc.BM25_K1, rc.BM25_B
    share = F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / F.lit(index.mean_length or 1.0)
    return F.col("tf") * (k1 + 1.0) / (F.col("tf") + F.lit(k1) * share)


def contribution(term_weight: Column, query_weight: Column) -> Column:
    """A term's part of a score in whole units; it grows with the term's weight if the query's weight is positive."""
    return F.floor(term_weight * query_weight * F.lit(SCORE_UNITS) + F.lit(0.5)).cast("long")


def weighted_terms(index: SparseIndex, counted: DataFrame) -> DataFrame:
    """(query_id, term, query_weight) of the query terms that the corpus has."""
    return counted.join(idf(index), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("query_weight"))


def with_share_of_best(found: DataFrame) -> DataFrame:
    score = F.col("units") / F.lit(SCORE_UNITS)
    best = F.max("units").over(W.partitionBy("query_id")) / F.lit(SCORE_UNITS)
    return found.withColumn("score", score).withColumn("_best", best).select(
        "query_id", "chunk_id", "score",
        (F.col("score") / F.when(F.col("_best") > 0, F.col("_best")).otherwise(F.lit(1.0))).alias("bm25_score"), "rank",
    )


def bm25_search(index: SparseIndex, queries: DataFrame, n: int, terms_per_block: int = QUERY_TERMS_PER_BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, bm25_score, rank): best n matching chunks per query.

    ``score`` is raw, ``bm25_score`` divided by the query's best. Query terms are broadcast in blocks of bounded
    size, one pass over the postings per block.
    """
    counted = query_terms(queries)
    size = counted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    blocks = blocks_by(weighted_terms(index, counted), "query_id", size["terms"], terms_per_block)
    amount = max(int(index.chunks * index.mean_length), index.chunks * -(-size["queries"] // len(blocks)))
    found = []
    for block in blocks:
        vocabulary = F.broadcast(block.select("term").distinct())
        weighed = index.postings.join(vocabulary, "term", "left_semi").select("chunk_id", "term", saturation(index).alias("term_weight"))
        matched = in_parts(weighed, "chunk_id", amount, POSTINGS_PER_PART)
        pairs = matched.join(F.broadcast(block), "term").groupBy("chunk_id", "query_id").agg(
            F.sum(contribution(F.col("term_weight"), F.col("query_weight"))).alias("units")
        )
        found.append(top_n(pairs, n, "units"))
    return with_share_of_best(union_all(found))


def best_per_query(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the n best rows per column; ties go to the smaller id."""
    if len(ids) > n:
        edge = np.partition(scores, len(ids) - n, axis=0)[len(ids) - n]
        row, col = np.nonzero(scores >= edge)
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
    value, name = scores[row, col], ids[row]
    order = np.lexsort((name, -value, col))
    col, name, value = col[order], name[order], value[order]
    first = np.r_[0, np.nonzero(np.diff(col))[0] + 1] if len(col) else np.array([], dtype=int)
    place = np.arange(len(col)) - np.repeat(first, np.diff(np.r_[first, len(col)]))
    keep = place < n
    return col[keep], name[keep], value[keep]


def _vector_blocks(frame: DataFrame, name: str, rows: int) -> DataFrame:
    """Blocks of vectors as (names, vectors): ids and one matrix of whole numbers in little-endian doubles."""
    kind = frame.schema[name].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start:start + rows]
                matrix = np.floor(np.stack(part["embedding"]).astype("<f8") * GRID + 0.5)
                yield pd.DataFrame({f"{name}s": [part[name].to_numpy()], f"{name}_vectors": [matrix.tobytes()]})

    return frame.select(name, "embedding").mapInPandas(pack, f"{name}s array<{kind}>, {name}_vectors binary")


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(1 + cosine) / 2 of all pairs of unit vectors on the grid, the same whatever the order of summation."""
    return np.maximum(0.0, (1.0 + (left @ right.T) / (GRID * GRID)) / 2.0)


def dense_search(vectors: DataFrame, queries: DataFrame, n: int, vectors_per_block: int = QUERY_VECTORS_PER_BLOCK) -> DataFrame:
    """(query_id, chunk_id, dense_score, rank): nearest n vectors per query vector, exact.

    ``vectors`` has chunk_id and embedding, ``queries`` query_id and embedding, all unit length. Both sides are packed
    into blocks, and every block of the corpus meets every block of queries as one matrix product: the corpus is scanned
    once, nothing passes through the driver, and a task returns at most n rows per query.
    """
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    met = _vector_blocks(vectors, "chunk_id", CORPUS_VECTORS_PER_BLOCK).crossJoin(_vector_blocks(queries, "query_id", vectors_per_block))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, tuple[np.ndarray, pd.DataFrame]] = {}  # by the first query of a block
        for batch in batches:
            for ids, matrix, names, asked in batch.itertuples(index=False):
                left, right = np.frombuffer(matrix, "<f8").reshape(len(ids), -1), np.frombuffer(asked, "<f8").reshape(len(names), -1)
                scores = likeness(left, right)
                col, found, value = best_per_query(scores, np.asarray(ids), n)
                fresh = pd.DataFrame({"col": col, "chunk_id": found, "dense_score": value})
                if names[0] in kept:
                    merged = pd.concat([kept[names[0]][1], fresh]).sort_values(["col", "dense_score", "chunk_id"], ascending=[True, False, True])
                    fresh = merged.groupby("col", sort=False).head(n)
                kept[names[0]] = (np.asarray(names), fresh)
        for names, best in kept.values():
            yield pd.DataFrame({"query_id": names[best["col"]], "chunk_id": best["chunk_id"].to_numpy(), "dense_score": best["dense_score"].to_numpy()})

    return top_n(met.mapInPandas(nearest, f"query_id {query_type}, chunk_id {id_type}, dense_score double"), n, "dense_score")


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of the two legs; each chunk once per query with both leg scores."""
    zero = F.lit(0.0)
    legs = dense.select("query_id", "chunk_id", "rank", "dense_score", zero.alias("bm25_score")).unionByName(
        sparse.select("query_id", "chunk_id", "rank", zero.alias("dense_score"), "bm25_score")
    )
    return legs.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(float(rc.RRF_K)) + F.col("rank"))).alias("rrf_score"),
        F.max("dense_score").alias("dense_score"), F.max("bm25_score").alias("bm25_score"),
    )


def attach_text(candidates: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("text", "source", "page")) -> DataFrame:
    """Text of ranked candidates only; candidates no longer stored drop out."""
    return candidates.join(chunks.select("chunk_id", *columns), "chunk_id")


Scorer = Callable[[list[str], list[str]], "np.ndarray"]
Encoder = Callable[[list[str]], "np.ndarray"]


def rescore(candidates: DataFrame, load_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """Adds ``rerank_score`` from a pair scorer on (query_text, text); without one, or where it fails, the fused score.

    ``load_scorer`` runs once per task, so a model is loaded once per task.
    """
    if load_scorer is None:
        return candidates.withColumn("rerank_score", F.col("rrf_score"))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load_scorer()
        for queries, texts in batches:
            try:
                yield pd.Series(np.asarray(scorer(queries.tolist(), texts.tolist()), dtype="float64"), index=queries.index)
            except Exception:  # a failed batch keeps the fused order
                yield pd.Series(np.nan, index=queries.index)

    raw = score(F.col("query_text"), F.col("text"))
    return candidates.withColumn("_raw", raw).withColumn(
        "rerank_score", F.coalesce(F.when(~F.isnan("_raw"), F.col("_raw")), F.col("rrf_score"))
    ).drop("_raw")


def final_ranking(rescored: DataFrame, n: int = rc.FINAL_TOP_N) -> DataFrame:
    """Final n per query; the fused score, then the chunk id break ties."""
    best = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rrf_score").desc(), F.col("chunk_id"))
    return rescored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def embed(chunks: DataFrame, load_encoder: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """Adds unit-length ``embedding`` from a pluggable text encoder, loaded once per task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch):
                vectors = np.asarray(encoder(texts.iloc[start:start + batch].tolist()), dtype="float64")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                rows.extend((vectors / np.where(norms == 0, 1.0, norms)).astype("float32"))
            yield pd.Series(rows, index=texts.index)

    return chunks.withColumn("embedding", encode(F.col("text")))


def hashing_embeddings(chunks: DataFrame, others: list[DataFrame], dimensions: int = 256) -> list[DataFrame]:
    """Default encoder without a model download: hashed term frequencies, IDF of the corpus, unit length.

    Fitted on ``chunks`` and applied to it and to ``others`` (query tables).
    """
    words = lambda f: f.withColumn("_tokens", tx.tokens(F.col("text")))
    model = Pipeline(stages=[
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(words(chunks))
    return [
        model.transform(words(f)).withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_tfidf", "_unit")
        for f in [chunks, *others]
    ]


def letter_profiles(frame: DataFrame) -> DataFrame:
    """A tiny deterministic encoder in plain expressions: ``embedding`` is the unit vector of the 26 letter counts."""
    low = F.col("_low")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(26)])
    norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda acc, v: acc + v * v))
    unit = let(norm, lambda n: F.transform("_counts", lambda v: F.coalesce(v / F.nullif(n, F.lit(0.0)), F.lit(0.0))))
    return frame.withColumn("_low", F.lower("text")).withColumn("_counts", counts).withColumn("embedding", unit).drop("_low", "_counts")


def write_once(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
