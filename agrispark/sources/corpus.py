"""Corpus readers and the chunk store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.session import spread, staging_path


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.md`` file directly in the folder: source (file name), page 0, text."""
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
        .select(
            F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"),
            F.lit(0).alias("page"),
            F.col("value").alias("text"),
        )
    )


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in corpus shape; each document is page 0 of its own source."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return docs.select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"),
        F.col("source").alias("origin"), F.lit(0).alias("page"), "text",
    )


def _store_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(schemas.CHUNKS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


_STORE_COLUMNS = schemas.CHUNKS.fieldNames()


def write_chunks(spark: SparkSession, chunks: DataFrame, path: str, clear: bool = False) -> None:
    """Idempotent upsert keyed by chunk id into an append-only parquet store.

    Only rows whose id is new, or whose text or place changed, are written, so a repeated ingest writes nothing and
    an incremental one costs the size of the increment: the increment is staged once, and the store is read for
    its ids only; Spark broadcasts the increment's ids where it measures them as small. Of rows with one id the one
    with the greatest content hash is taken. ``clear`` rebuilds the store.
    """
    incoming = (
        chunks.select(*_STORE_COLUMNS).withColumn("content_hash", F.xxhash64("text", "source", "page", "chunk_index"))
    )
    rest = [c for c in incoming.columns if c != "chunk_id"]
    incoming = (
        incoming.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "content_hash").alias("r")).select("chunk_id", "r.*")
        .withColumn("stored_at", F.current_timestamp())
    )
    if clear or not _store_exists(spark, path):
        incoming.write.mode("overwrite").parquet(path)
        return
    stage = staging_path(spark, "increment")
    incoming.write.parquet(stage)
    staged, stored = spark.read.parquet(stage), spark.read.parquet(path)
    keys = ["chunk_id"]
    if "buckets" in stored.columns and (first := stored.select("buckets").head()):  # a compacted store: only the increment's folders are read
        staged, keys = _bucketed(staged, first["buckets"]), ["bucket", "chunk_id"]
    present = stored.select(*keys, "content_hash", "stored_at").join(staged.select(*keys), keys, "left_semi")
    current = latest_chunks(present).select("chunk_id", "content_hash")
    fresh = staged.join(current, ["chunk_id", "content_hash"], "left_anti").write.mode("append")
    (fresh.partitionBy("bucket") if len(keys) > 1 else fresh).parquet(path)


def latest_chunks(stored: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Newest row per chunk id; other keys must follow from it."""
    rest = [c for c in stored.columns if c not in keys]
    return (
        stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("stored_at", "content_hash")).alias("r"))
        .select(*keys, "r.*")
    )


def read_chunks(spark: SparkSession, path: str, *columns: Column | str) -> DataFrame:
    """The newest row of every chunk: all store columns, or the given expressions of them, which alone are shuffled."""
    stored = spark.read.parquet(path)
    if columns:
        return latest_chunks(stored.select("chunk_id", "stored_at", "content_hash", *columns)).drop("stored_at", "content_hash")
    return latest_chunks(stored).select(*_STORE_COLUMNS)


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
    return chunks.withColumn("buckets", F.lit(buckets)).withColumn("bucket", place)


def compact_chunks(spark: SparkSession, path: str, target: str, buckets: int = 64) -> None:
    """The newest row of every chunk in a new store, dealt to folders by a hash of its id; the old store stays.

    The new store appears as a whole, and ``write_chunks`` goes on with it, reading the folders of its increment only.
    The number of buckets should grow with the store.
    """
    newest_by_bucket(spark.read.parquet(path), buckets).write.mode("overwrite").partitionBy("bucket").parquet(target)


def newest_by_bucket(stored: DataFrame, buckets: int) -> DataFrame:
    """The newest row of every chunk with its bucket: rows are dealt once, and the newest is found where they lie."""
    return latest_chunks(_bucketed(stored, buckets).repartition("bucket"), ("bucket", "chunk_id"))
