"""Registered queries that drain a stream over the given tables and return its result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from agrispark.operators import retrieval, segments
from agrispark.plans.telemetry_queries import ALERT_COLUMNS, READING_COLUMNS
from agrispark.session import staging_path
from agrispark.sources.corpus import read_chunks
from agrispark.streaming import corpus as sc
from agrispark.streaming import readings as sr


def stream_alerts(spark, sf):
    return sr.run_to_end(sr.alert_stream(sr.event_stream(spark, sf)), staging_path(spark, "alerts")).select(*ALERT_COLUMNS)


def stream_deduplicated(spark, sf):
    """The events replayed once: every reading arrives twice and passes once."""
    def once(events):
        return sr.deduplicated(events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"))

    return sr.drain_in_order(spark, sf, once, staging_path(spark, "readings")).select("event_id", "node_id", "moisture_pct")


def stream_latest(spark, sf):
    return sr.run_latest_to_end(sr.latest_stream(sr.event_stream(spark, sf)), staging_path(spark, "latest")).select(*READING_COLUMNS)


def stream_windows(spark, sf):
    """Windows of all readings that the watermark, ten minutes behind the newest, has passed."""
    windows = sr.drain_in_order(spark, sf, lambda r: sr.rolling_windows(r, sr.WATERMARK), staging_path(spark, "windows"))
    return windows.select(
        "node_id", "event_id", F.size("window").cast("long").alias("length"),
        F.element_at("window", 1)[3].alias("first_moisture"), F.element_at("window", -1)[3].alias("last_moisture"),
    )


def _silence_events(spark, sf):
    silent = sr.drain_in_order(spark, sf, lambda r: sr.silence_stream(r, 12 * 3600), staging_path(spark, "silent"))
    return silent.select("node_id", "event", F.col("at").cast("timestamp_ntz").alias("at"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


def stream_silence_events(spark, sf):
    """When nodes fell silent for twelve hours and came back, as far as the watermark, ten minutes behind, has come."""
    return _silence_events(spark, sf)


def stream_silent_nodes(spark, sf):
    """Nodes whose last event says that they are silent."""
    last = _silence_events(spark, sf).groupBy("node_id").agg(F.max_by(F.struct("event", "last_seen"), "at").alias("r"))
    return last.where("r.event = 'silent'").select("node_id", "r.last_seen")


def stream_chunk_store(spark, sf):
    """Documents ingested as a stream into a chunk store."""
    table = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
    docs = table.parquet(sr.table_pattern(f"{sf}/documents.parquet")).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), F.lit(0).alias("page"), "text")
    path = staging_path(spark, "chunks")
    sc.ingest_stream(docs, f"{path}/store", f"{path}/checkpoint")
    return read_chunks(spark, f"{path}/store").select("chunk_id", "source", "chunk_index", "char_count")


CHUNK_STREAM = "chunk_id string, text string, deleted boolean"


def _increments(spark, sf):
    """Documents as chunks in three increments: first versions of most, changes and the rest and repeats, deletions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"), "text", F.lit(False).alias("deleted")
    )
    changed, late = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 4
    first = docs.where(~late).withColumn("text", F.when(changed, F.concat(F.lit("old version "), F.substring("text", 1, 50))).otherwise(F.col("text")))
    second = docs.where(changed | late | (F.col("doc_id") % 3 == 1))
    third = docs.where(F.col("doc_id") % 7 == 3).withColumn("deleted", F.lit(True)).withColumn("text", F.lit(None).cast("string"))
    return [f.select("chunk_id", "text", "deleted") for f in (first, second, third)]


def _letter_counts():
    return lambda texts: np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)


def _grown_index(spark, sf):
    path = staging_path(spark, "segments")
    for increment in _increments(spark, sf):
        increment.write.mode("append").parquet(f"{path}/arrived")
        stream = spark.readStream.schema(CHUNK_STREAM).parquet(f"{path}/arrived")
        sc.index_stream(stream, f"{path}/index", f"{path}/checkpoint", _letter_counts)
    return f"{path}/index"


def incremental_index(spark, sf):
    """Terms of an index that grew by three increments, as if it had been built at once from what is left."""
    index = segments.read_index(spark, _grown_index(spark, sf))
    return retrieval.idf(index).select("term", "df", F.round("idf", 6).alias("idf"))


def incremental_topk(spark, sf):
    """Best chunks of the benchmark texts in an index that grew by three increments and was compacted."""
    path = _grown_index(spark, sf)
    segments.compact(spark, path, f"{path}-compact")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.bm25_search(segments.read_index(spark, f"{path}-compact"), queries, 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def incremental_encodings(spark, sf):
    """How often each chunk was encoded, and the most frequent letter that its live vector says."""
    path = _grown_index(spark, sf)
    letter = F.array_position("embedding", F.array_max("embedding")).cast("long")
    live = segments.read_vectors(spark, path).select("chunk_id", letter.alias("letter"))
    return segments.encodings(spark, path).join(live, "chunk_id", "left")


QUERIES = {f.__name__: f for f in [
    stream_alerts, stream_deduplicated, stream_latest, stream_windows, stream_silence_events, stream_silent_nodes, stream_chunk_store,
    incremental_index, incremental_topk, incremental_encodings,
]}
