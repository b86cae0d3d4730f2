"""Registered queries over documents, postings, vectors and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.operators import cells, cleanse, context, corpus, pruned, retrieval
from agrispark.plans import flows
from agrispark.rules import corpus as rc
from agrispark.session import staging_path
from agrispark.sources.corpus import read_chunks, read_documents, write_chunks


def _documents(spark, sf):
    return read_documents(spark, sf)


def _document_chunks(spark, sf):
    """Whole documents as single chunks, so that every engine can build the same ones."""
    return _documents(spark, sf).select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"), "text", "source", "page"
    )


def _benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def _line_chunks(spark, sf):
    """Lines of cleaned documents as chunks."""
    lines = corpus.clean_documents(_documents(spark, sf)).select(
        "source", "origin", "page", F.posexplode(F.split("text", "\\n")).alias("chunk_index", "text")
    )
    return lines.where(F.col("text") != "").select(
        tx.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text", "source",
        "origin", "page", "chunk_index", F.length("text").alias("char_count"), F.lit("markdown").alias("extraction_method"),
    )


def clean_documents(spark, sf):
    """Documents with control characters and blank runs added, then cleaned."""
    dirty = F.concat(F.lit(" \t "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n")), F.lit(" \u0007​ \r\n"))
    return corpus.clean_documents(_documents(spark, sf).withColumn("text", dirty)).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


# Boilerplate mixed into documents: a paragraph of its own, a line inside a paragraph, or none.
BOILERPLATE_EXPR = (
    "case doc_id%5 when 0 then 'Here are the key points extracted from the text:'||chr(10)||chr(10)||text "
    "when 1 then text||chr(10)||chr(10)||'In summary, nothing more.'||chr(10)||'A second line.' "
    "when 2 then 'First line stays.'||chr(10)||'Key Points:'||chr(10)||'Third line stays.'||chr(10)||chr(10)||text "
    "when 3 then text||chr(10)||chr(10)||chr(10)||'  THE SECTION DISCUSSES lime.'||chr(10)||chr(10)||'Well, please let me know if you have any specific questions. ' "
    "else text end"
)


def boilerplate_removed(spark, sf):
    mixed = _documents(spark, sf).withColumn("text", F.expr(BOILERPLATE_EXPR))
    return corpus.remove_boilerplate(mixed).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


def chunk_ids(spark, sf):
    return _line_chunks(spark, sf).select("chunk_id", "source", F.col("chunk_index").cast("long").alias("chunk_index"))


def long_enough_chunks(spark, sf):
    return corpus.long_enough(_line_chunks(spark, sf)).groupBy("origin").agg(F.count(F.lit(1)).alias("kept"))


def ingest_stats(spark, sf):
    docs = corpus.clean_documents(_documents(spark, sf)).withColumn("source", F.col("origin"))
    return corpus.ingest_stats(docs, _line_chunks(spark, sf).withColumn("source", F.col("origin")))


def document_chunks(spark, sf):
    chunks = corpus.chunk_documents(corpus.clean_documents(_documents(spark, sf)))
    return chunks.select("chunk_id", "source", "chunk_index", "char_count")


def chunk_coverage(spark, sf):
    """What the chunks of a document must have in common with it: unbroken numbering, bounded lengths, all its words."""
    chunks = corpus.chunk_documents(corpus.clean_documents(_documents(spark, sf)))
    most = rc.CHUNK_SIZE + 2 * (rc.CHUNK_OVERLAP + 2) + 2  # a chunk may carry an overlap beyond its size
    words = F.array_distinct(F.flatten(F.collect_list(F.array_distinct(tx.tokens(F.col("text"))))))
    return chunks.groupBy("source").agg(
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") + 1 == F.count(F.lit(1))) & (F.countDistinct("chunk_index") == F.count(F.lit(1)))).alias("unbroken"),
        (F.max("char_count") <= most).alias("bounded"), F.size(words).cast("long").alias("words"),
    )


def chunk_store(spark, sf):
    """Chunks stored twice: the second ingest adds nothing."""
    chunks = corpus.long_enough(_line_chunks(spark, sf)).drop("origin")
    path = staging_path(spark, "chunks")
    write_chunks(spark, chunks, path, clear=True)
    write_chunks(spark, chunks, path)
    stored = spark.read.parquet(path)
    return corpus.store_size(read_chunks(spark, path)).withColumn("stored_rows", stored.agg(F.count(F.lit(1))).scalar())


def token_stats(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"), tx.token_estimate(F.col("text")).alias("token_estimate")
    )


def _index(spark, sf):
    return retrieval.build_index(_document_chunks(spark, sf), staging_path(spark, "postings"))


def term_frequencies(spark, sf):
    return retrieval.idf(_index(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, sf):
    lengths = _documents(spark, sf).select(F.size(tx.tokens(F.col("text"))).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("mean_length"))


def bm25_topk(spark, sf):
    found = retrieval.bm25_search(_index(spark, sf), _benchmark(spark, sf), rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR)
    return found.select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("long").alias("rank")
    )


def _pruned(spark, sf):
    path, index = staging_path(spark, "pruned"), _index(spark, sf)
    bounds = pruned.impact_bounds(index, f"{path}/bounds")
    return index, pruned.pruned_search(index, bounds, _benchmark(spark, sf), rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR, path)


def bm25_pruned_topk(spark, sf):
    """The rows of ``bm25_topk`` from a search that skips what can't be among them."""
    found = _pruned(spark, sf)[1].rows
    return found.select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("long").alias("rank")
    )


def bm25_pruned_pairs(spark, sf):
    """Pairs of chunk and query term in the corpus, and whether fewer had to be formed to find candidates."""
    index, search = _pruned(spark, sf)
    every = retrieval.query_terms(_benchmark(spark, sf)).join(index.vocabulary, "term").agg(F.sum("df").alias("all_pairs"))
    formed = search.pairs.where("step = 'essential'").agg(F.sum("formed").alias("formed"))
    return every.join(formed).select("all_pairs", (F.col("formed") < F.col("all_pairs")).alias("fewer"))


def dense_topk(spark, sf):
    """Vectors nearest to the unit-length mean vector of each label."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    )
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, v: acc + v * v))
    queries = means.select(F.col("label").alias("query_id"), F.transform("mean", lambda v: v / norm).alias("embedding"))
    corpus_vectors = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = retrieval.dense_search(corpus_vectors, queries, rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR)
    return found.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), F.col("rank").cast("long").alias("rank"))


def _cells(spark, sf):
    """Vectors by cell, and as queries those whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    path = staging_path(spark, "cells")
    return vectors, queries, cells.build_cells(vectors, path, cells.fit_centres(vectors)), path


def cells_topk(spark, sf):
    """The vectors nearest to each query, from an inverted file searched until no other cell can have a nearer one."""
    _, queries, index, path = _cells(spark, sf)
    found = cells.cell_search(index, queries, rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR, 1, path, exact=True)
    return found.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), F.col("rank").cast("long").alias("rank"))


def cells_recall(spark, sf):
    """Vectors in the inverted file, rows asked for, and whether the probed cells alone have nine tenths of them."""
    vectors, queries, index, path = _cells(spark, sf)
    n = rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR
    found = cells.cell_search(index, queries, n, cells.enough_probes(index, n), path).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    whole = retrieval.dense_search(vectors, queries, n).join(found, ["query_id", "chunk_id"], "left")
    recall = whole.agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"))
    return index.cells.agg(F.sum("rows").alias("indexed")).join(recall).select(
        "indexed", "asked", (F.col("hits") >= 0.9 * F.col("asked")).alias("recalled")
    )


def _candidates(spark, sf):
    chunks, queries = _document_chunks(spark, sf), _benchmark(spark, sf)
    return flows.hybrid_candidates(_index(spark, sf), retrieval.letter_profiles(chunks), queries, retrieval.letter_profiles(queries))


def rrf_topk(spark, sf):
    final = retrieval.final_ranking(retrieval.rescore(_candidates(spark, sf)), rc.DEFAULT_TOP_K * rc.CANDIDATE_FACTOR)
    return final.select(
        "query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("dense_score", 6).alias("dense_score"),
        F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("long").alias("rank"),
    )


def retrieval_context(spark, sf):
    contexts = flows.grounded_contexts(_candidates(spark, sf), _document_chunks(spark, sf), _benchmark(spark, sf))
    return contexts.select(
        "query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.array_join("sources", "|").alias("sources"),
        "chunks_used", "truncated", "grounded",
    )


def context_budget(spark, sf):
    """Every document as a context for a question as long as its source name."""
    kept = context.within_budget(_documents(spark, sf).select("doc_id", "origin", "text"), "text", "origin")
    return kept.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars"), "truncated")


def relevance_cut(spark, sf):
    """Vectors whose first coordinate, stretched to a logit, passes the relevance cut."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    scored = vectors.select("vec_id", (F.element_at("embedding", 1).cast("double") * 20.0).alias("score"))
    return cleanse.relevant_only(scored).select("vec_id", F.round("score", 6).alias("score"))


def hashed_retrieval(spark, sf):
    """Hybrid retrieval over real chunks with the default hashed encoder."""
    chunks = retrieval.write_once(spark, flows.ingest(_documents(spark, sf)), staging_path(spark, "chunks"))
    chunk_vectors, query_vectors = retrieval.hashing_embeddings(chunks, [_benchmark(spark, sf)])
    index = retrieval.build_index(chunks, staging_path(spark, "postings"))
    fused = flows.hybrid_candidates(index, chunk_vectors, _benchmark(spark, sf), query_vectors)
    contexts = flows.grounded_contexts(fused, chunks, _benchmark(spark, sf))
    return contexts.select("query_id", "chunks_used", F.array_join("sources", "|").alias("sources"), "truncated", "grounded")


QUERIES = {f.__name__: f for f in [
    clean_documents, boilerplate_removed, chunk_ids, long_enough_chunks, ingest_stats, document_chunks, chunk_coverage, chunk_store,
    token_stats, term_frequencies, corpus_stats, bm25_topk, bm25_pruned_topk, bm25_pruned_pairs, dense_topk, cells_topk, cells_recall, rrf_topk, retrieval_context, context_budget,
    relevance_cut, hashed_retrieval,
]}
