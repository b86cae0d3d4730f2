"""An index that grows by segments: postings and vectors of new and changed chunks, and what they do to the statistics.

A batch of chunks becomes one segment, in a folder of its batch number below each table:

* ``log``: one row for each chunk that is new, changed or deleted, with the batch that held it before;
* ``postings`` and ``vectors``: of the new and changed chunks only; unchanged ones are neither split nor encoded again;
* ``deltas``: by how much the document frequency of each term rises or falls;
* ``commits``: written last. Readers see whole segments only, and a batch that is tried again overwrites its own folders.

A chunk's rows in older segments are dead as soon as a newer log row names it; compacting drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.operators import retrieval
from agrispark.operators.retrieval import Encoder, SparseIndex
from agrispark.sources.commits import all_batches, commit, commits, committed, is_committed, write_batch

LOG = "chunk_id string, content_hash long, doc_len long, live boolean, old_batch long, old_len long, batch long"
POSTINGS = "chunk_id string, doc_len long, term string, tf long, batch long"
VECTORS = "chunk_id string, embedding array<float>, batch long"
DELTAS = "term string, df long, batch long"


def _newest(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c != "chunk_id"]
    return log.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("chunk_id", "r.*")


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, doc_len, batch) of the chunks that are in the index, with the segment that holds them."""
    return _newest(committed(spark, path, "log", LOG)).where("live").select("chunk_id", "doc_len", "batch")


def add_segment(chunks: DataFrame, path: str, batch: int, load_encoder: Callable[[], Encoder]) -> None:
    """Index a batch (chunk_id, text, deleted) on top of the segments before it.

    Of rows with one id the one with the greatest content hash counts, a deletion only if it is alone. A batch that is
    committed already changes nothing.
    """
    spark = chunks.sparkSession
    if is_committed(spark, path, batch):
        return
    marked = chunks.select(
        "chunk_id", F.coalesce("text", F.lit("")).alias("text"), (~F.col("deleted")).alias("live"), F.xxhash64("text").alias("content_hash")
    )
    one = F.max_by(F.struct("text", "live", "content_hash"), F.struct("live", "content_hash")).alias("r")
    write_batch(marked.groupBy("chunk_id").agg(one).select("chunk_id", "r.*"), path, "incoming", batch)
    incoming = spark.read.parquet(f"{path}/incoming/batch={batch}")
    log = committed(spark, path, "log", LOG).where(F.col("batch") < batch).join(incoming.select("chunk_id"), "chunk_id", "left_semi")
    before = _newest(log).where("live").select(
        "chunk_id", F.col("content_hash").alias("old_hash"), F.col("batch").alias("old_batch"), F.col("doc_len").alias("old_len")
    )
    changed = incoming.join(before, "chunk_id", "left").where("(live AND NOT (old_hash <=> content_hash)) OR (NOT live AND old_batch IS NOT NULL)")
    tokens = F.when(F.col("live"), tx.tokens(F.col("text"))).otherwise(F.array().cast("array<string>"))
    words = changed.withColumn("tokens", tokens).withColumn("doc_len", F.size("tokens").cast("long"))
    write_batch(words.select("chunk_id", "content_hash", "doc_len", "live", "old_batch", "old_len"), path, "log", batch)
    # Texts are dealt by chunk before they are split, so the larger exploded postings are counted in place.
    placed = retrieval.in_parts(changed.where("live").select("chunk_id", "text"), "chunk_id", retrieval.text_size(incoming), retrieval.CHARS_PER_PART)
    split = placed.select("chunk_id", tx.tokens(F.col("text")).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))
    fresh = split.select("chunk_id", "doc_len", F.explode("tokens").alias("term"))
    write_batch(fresh.groupBy("chunk_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")), path, "postings", batch)
    counted = Observation()
    encoded = retrieval.embed(changed.where("live").select("chunk_id", "text"), load_encoder).select("chunk_id", "embedding")
    write_batch(encoded.observe(counted, F.count(F.lit(1)).alias("n")), path, "vectors", batch)
    postings = all_batches(spark, path, "postings", POSTINGS)
    dead = spark.read.parquet(f"{path}/log/batch={batch}").where("old_batch IS NOT NULL").select("chunk_id", F.col("old_batch").alias("batch")).hint("shuffle_hash")
    moves = (
        postings.where(F.col("batch") == batch).select("term", F.lit(1).alias("step"))
        .unionByName(postings.where(F.col("batch") < batch).join(dead, ["chunk_id", "batch"], "left_semi").select("term", F.lit(-1).alias("step")))
    )
    write_batch(moves.groupBy("term").agg(F.sum("step").alias("df")).where("df != 0"), path, "deltas", batch)
    commit(spark, path, batch, counted.get["n"])


def read_index(spark: SparkSession, path: str) -> SparseIndex:
    """The sparse index of all committed segments: live postings, and frequencies from the summed deltas."""
    live = live_chunks(spark, path)
    sizes = live.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first()
    postings = committed(spark, path, "postings", POSTINGS).join(
        live.select("chunk_id", "batch").hint("shuffle_hash"), ["chunk_id", "batch"], "left_semi"  # postings are not sorted for it
    ).drop("batch")
    vocabulary = committed(spark, path, "deltas", DELTAS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    mean = vocabulary.agg(F.avg(retrieval.raw_idf(sizes["n"]))).first()[0] or 0.0
    return SparseIndex(postings, vocabulary, sizes["n"], sizes["length"] / sizes["n"] if sizes["n"] else 0.0, mean)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of the live chunks."""
    live = live_chunks(spark, path).select("chunk_id", "batch")
    return committed(spark, path, "vectors", VECTORS).join(live, ["chunk_id", "batch"], "left_semi").drop("batch")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, times): how often each chunk was encoded over all segments."""
    return committed(spark, path, "vectors", VECTORS).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("times"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The live rows of an index as one segment of a new index, under the number of the last batch.

    The old index stays as it is; the new one is visible once its commit is written, and later batches continue it.
    """
    last = commits(spark, path).agg(F.max("batch")).first()[0]
    if last is None:
        return
    index, newest = read_index(spark, path), _newest(committed(spark, path, "log", LOG)).where("live")
    nothing = F.lit(None).cast("long")
    write_batch(newest.select("chunk_id", "content_hash", "doc_len", "live", nothing.alias("old_batch"), nothing.alias("old_len")), target, "log", last)
    write_batch(index.postings, target, "postings", last)
    write_batch(read_vectors(spark, path), target, "vectors", last)
    write_batch(index.vocabulary, target, "deltas", last)
    commit(spark, target, last, index.chunks)
