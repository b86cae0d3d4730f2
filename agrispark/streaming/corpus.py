"""Incremental corpus ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark.operators import corpus as oc
from agrispark.operators import segments
from agrispark.operators.retrieval import Encoder
from agrispark.sources.corpus import write_chunks


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    return stream.select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.lit(0).alias("page"), F.col("value").alias("text")
    )


def ingest_stream(documents: DataFrame, store: str, checkpoint: str) -> None:
    """Chunk new documents and add only chunks the store does not hold yet."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write_chunks(batch.sparkSession, oc.long_enough(oc.chunk_documents(oc.clean_documents(batch))), store)

    documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def index_stream(chunks: DataFrame, path: str, checkpoint: str, load_encoder: Callable[[], Encoder]) -> None:
    """Index what has arrived of a stream of (chunk_id, text, deleted): each micro-batch is a segment of its own.

    Only new and changed chunks are split and encoded, and a micro-batch that is tried again adds nothing twice.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        segments.add_segment(batch, path, batch_id, load_encoder)

    chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
