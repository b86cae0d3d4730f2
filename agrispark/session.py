"""Session construction and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "agrispark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the checkpoint folder named by the session.

    Only a local session without one gets a temporary folder; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="agrispark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _staging_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/agrispark/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a part of it that belongs to this application."""
    return f"{_staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staging(spark: SparkSession) -> bool:
    """Delete what this application has staged; call it when no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staging_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when the scan yields fewer partitions than there are cores, for heavy work per row.

    A file with one row group is one partition however large the cluster is. The keys should be unique together.
    Inputs with enough partitions pass through without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame._jdf.rdd().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, *keys)
