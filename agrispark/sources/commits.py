"""Tables that grow by numbered batches and are read by whole batches.

A batch is written to a folder of its own, and a row in ``commits`` then makes it visible. A batch that fails leaves no
trace for readers, and one that is tried again overwrites its own folder or, once committed, does nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "rows long, batch long"


def all_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of all batches with their number, committed or not; no rows before the first."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(rows, batch), one row a batch."""
    return all_batches(spark, path, "commits", COMMITS)


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return bool(commits(spark, path).where(F.col("batch") == batch).head(1))


def committed(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of committed batches, with their number."""
    return all_batches(spark, path, name, schema).join(commits(spark, path).select("batch"), "batch", "left_semi")


def write_batch(frame: DataFrame, path: str, name: str, batch: int) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def commit(spark: SparkSession, path: str, batch: int, rows: int) -> None:
    write_batch(spark.createDataFrame([(rows,)], "rows long").coalesce(1), path, "commits", batch)
