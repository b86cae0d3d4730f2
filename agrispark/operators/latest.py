"""Latest state per node and the live network views.

Latest-per-key is an aggregation, not a window: partial results are combined before the shuffle, so a node
that owns a third of all rows costs one row per input task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark.functions import views
from agrispark.operators.cleanse import to_long, with_node_id
from agrispark.rules import limits
from agrispark.sources import dims


def latest_per_node(readings: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    rest = [c for c in readings.columns if c != "node_id"]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return with_node_id(readings).groupBy("node_id").agg(newest).select("node_id", "r.*").select(*readings.columns)


def newest_rows(readings: DataFrame, n: int) -> DataFrame:
    return readings.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def latest_in_recent_rows(readings: DataFrame, recent_rows: int) -> DataFrame:
    """Latest per node among the newest rows overall; quiet nodes drop out of view."""
    return latest_per_node(newest_rows(readings, recent_rows))


def last_n_per_key(frame: DataFrame, key: str, order: list[Column], n: int, spread: Column, slices: int = 64) -> DataFrame:
    """The first n rows per key in the given order, with ``rank`` starting at 1.

    Ranked per (key, slice) first so that a hot key is cut down in parallel; each side of the shuffle keeps at
    most n rows per group.
    """
    sliced = frame.withColumn("_slice", F.pmod(F.hash(spread), F.lit(slices)))
    near = W.partitionBy(key, "_slice").orderBy(*order)
    far = W.partitionBy(key).orderBy(*order)
    return (
        sliced.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= n).drop("_near", "_slice")
        .withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= n)
    )


def last_readings(readings: DataFrame, n: int) -> DataFrame:
    """Newest n readings per node."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return last_n_per_key(with_node_id(readings), "node_id", order, n, F.col("event_id"))


def history_windows(readings: DataFrame, n: int, features: list[str]) -> DataFrame:
    """One row per node: its last n readings oldest first, how many there are, and whether that is enough."""
    kept = last_readings(readings.select("node_id", "ts", "event_id", *features), n)
    step = F.struct("ts", "event_id", *features)
    return (
        kept.groupBy("node_id")
        .agg(F.sort_array(F.collect_list(step)).alias("rows"), F.count(F.lit(1)).alias("readings_used"))
        .withColumn("status", F.when(F.col("readings_used") >= n, "ok").otherwise("insufficient_data"))
    )


def history_status(readings: DataFrame, required: int) -> DataFrame:
    counts = with_node_id(readings).groupBy("node_id").agg(F.count(F.lit(1)).alias("readings"))
    return counts.withColumn("status", F.when(F.col("readings") >= required, "ok").otherwise("insufficient_data"))


def node_count(readings: DataFrame, approximate: bool = False) -> DataFrame:
    nodes = with_node_id(readings)
    count = F.approx_count_distinct("node_id") if approximate else F.countDistinct("node_id")
    return nodes.agg(count.alias("node_count"))


def network_averages(readings: DataFrame, columns: tuple[str, ...] = ("moisture_pct", "temperature_c")) -> DataFrame:
    """Averages over all rows with missing counted as zero, next to the averages that skip missing."""
    rows = F.count(F.lit(1))
    out = [rows.alias("rows")]
    for c in columns:
        out.append((F.coalesce(F.sum(c), F.lit(0.0)) / F.nullif(rows, F.lit(0))).alias(f"avg_{c}_zero_filled"))
        out.append(F.avg(c).alias(f"avg_{c}"))
    return readings.agg(*out)


def node_states(latest: DataFrame) -> DataFrame:
    online = views.is_online(F.col("communication_ok"))
    nitrogen, moisture = F.col("nitrogen_mg_kg"), F.col("moisture_pct")
    return latest.select(
        "node_id", "event_id", "ts", online.alias("online"), views.node_status(online, nitrogen, moisture).alias("status"),
        *views.map_layers(online, nitrogen, moisture),
    )


def attention_count(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("status") != "GOOD").alias("needing_attention")
    )


def metric_tones(latest: DataFrame) -> DataFrame:
    """Tone and bar length of every card metric; missing counts as zero."""
    columns = [row[0] for row in limits.METRIC_RANGES]
    v = F.coalesce("value", F.lit(0.0))
    ranges = F.broadcast(dims.metric_ranges(latest.sparkSession))
    bounds = [F.col(c) for c in ("good_lo", "good_hi", "fair_lo", "fair_hi")]
    return to_long(latest, ["node_id"], columns).join(ranges, "column").select(
        "node_id", "column", v.alias("value"), views.metric_tone(v, *bounds).alias("tone"),
        views.fill_percent(v, bounds[2], bounds[3]).alias("fill_percent"),
    )


SNAPSHOT_FIELDS = [
    "node_id", "ts", "target_crop", "nitrogen_mg_kg", "phosphorus_mg_kg", "potassium_mg_kg",
    "moisture_pct", "temperature_c", "humidity_pct", "communication_ok",
]


def node_documents(latest: DataFrame) -> DataFrame:
    """One JSON document per node: the whole network without gathering it in one row."""
    return latest.select("node_id", F.to_json(F.struct(*SNAPSHOT_FIELDS)).alias("document"))


def farm_snapshot(readings: DataFrame, recent_rows: int = limits.RECENT_ROWS["snapshot"]) -> DataFrame:
    """One JSON document of the latest node states within the newest rows, which bound its size."""
    latest = latest_in_recent_rows(readings, recent_rows).select(*SNAPSHOT_FIELDS)
    return latest.agg(F.sort_array(F.collect_list(F.struct(*SNAPSHOT_FIELDS))).alias("nodes")).select(
        F.size("nodes").cast("long").alias("node_count"),
        F.to_json(F.struct(F.lit("online").alias("status"), F.size("nodes").alias("node_count"), "nodes")).alias("document"),
    )


def silent_nodes(readings: DataFrame, now: Column, gap: str) -> DataFrame:
    """Nodes whose newest reading is older than now minus the gap."""
    seen = with_node_id(readings).groupBy("node_id").agg(F.max("ts").alias("last_seen"))
    return seen.where(F.col("last_seen") < now - F.expr(f"interval {gap}"))
