"""Persisted results: filtered logs, scaler parameters and label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agrispark.operators.cleanse import time_range
from agrispark.sources import dims


def export_log_csv(readings: DataFrame, path: str, start: str | None = None, end: str | None = None,
                   inclusive_end_day: bool = False) -> None:
    """Historical log between two dates as CSV with a header, newest first within each part."""
    log = time_range(readings, start, end, inclusive_end_day)
    # Microseconds survive, and columns are written in schema order for an explicit read.
    log.sortWithinPartitions("ts", ascending=False).write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    ).csv(path)


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_label_map(spark: SparkSession, path: str) -> None:
    dims.suitability_labels(spark).write.mode("overwrite").parquet(path)


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
