"""Counts of distinct nodes for any range of time from stored sketches.

A sketch is a few kilobytes for each slice of time and can be merged with others, so readings are scanned once and a
range costs as many rows as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.operators.cleanse import with_node_id
from agrispark.operators.sequences import time_bucket

LG_CONFIG = 12  # 4096 registers
RELATIVE_ERROR = 1.04 / 2 ** (LG_CONFIG / 2)  # one standard deviation of an estimate


def node_sketches(readings: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(slice, sketch, readings): the nodes heard in each slice of time; readings without a time are left out."""
    slices = with_node_id(readings).where("ts IS NOT NULL").groupBy(time_bucket("ts", seconds).alias("slice"))
    return slices.agg(F.hll_sketch_agg("node_id", F.lit(LG_CONFIG)).alias("sketch"), F.count(F.lit(1)).alias("readings"))


def merged(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Estimated nodes and readings of every range (name, first, last): slices from first to last, both included."""
    inside = (F.col("slice") >= F.col("first")) & (F.col("slice") <= F.col("last"))
    return ranges.join(sketches, inside).groupBy("name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("nodes"), F.sum("readings").alias("readings")
    )
