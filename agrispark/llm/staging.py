"""Tables kept in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agrispark.session import staging_path


def staged(frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame written as Parquet below ``spark.checkpoint.dir`` and read again: later jobs don't repeat its work.

    ``agrispark.session.clear_staging`` deletes what an application has staged.
    """
    path = staging_path(frame.sparkSession, f"llm-{name}")
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions so that each holds about ``each``, and no fewer than the session's shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each)))
