"""Registered queries over readings: live views, alerts, filters and coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark.functions.numeric import to_number
from agrispark.operators import alerts, cleanse, latest, sequences, sketches
from agrispark.plans import flows
from agrispark.rules import limits
from agrispark.schemas import MEASURES, TELEMETRY
from agrispark.session import staging_path
from agrispark.sources import dims, exports
from agrispark.sources.telemetry import readings_from_events

ALERT_COLUMNS = [
    "alert_id", "node_id", "event_id", "ts", "metric", "severity", "direction", "value", "threshold",
    "title", "message", "recommendation",
]
READING_COLUMNS = ["node_id", "event_id", "ts", *MEASURES, "target_crop", "communication_ok"]


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return readings_from_events(spark, sf)


def threshold_alerts(spark, sf):
    return flows.current_alerts(_readings(spark, sf), ordered=False).select(*ALERT_COLUMNS)


def threshold_alerts_recent(spark, sf):
    return flows.current_alerts(_readings(spark, sf), limits.RECENT_ROWS["alerts"], ordered=False).select(*ALERT_COLUMNS)


def threshold_alerts_null_as_zero(spark, sf):
    newest = latest.latest_per_node(_readings(spark, sf))
    return alerts.threshold_alerts(newest, null_as_zero=True).select(*ALERT_COLUMNS)


# User limits derived from the region table: every region overrides one metric, some of them with invalid limits.
OVERRIDE_EXPRS = [
    "cast(r_regionkey as bigint) as user_id",
    "case r_regionkey when 0 then 'nitrogen' when 1 then 'moisture' when 2 then 'moisture' when 3 then 'humidity' else 'potassium' end as metric",
    "case r_regionkey when 3 then '5d' else cast(10+r_regionkey*5 as {STR}) end as min_text",
    "case r_regionkey when 2 then '3' else cast(40+r_regionkey*10 as {STR}) end as max_text",
]


def alerts_with_overrides(spark, sf):
    overrides = spark.read.parquet(f"{sf}/region.parquet").selectExpr(*[e.format(STR="string") for e in OVERRIDE_EXPRS])
    table = alerts.effective_limits(dims.alert_limits(spark), overrides)
    newest = latest.latest_per_node(_readings(spark, sf))
    return alerts.threshold_alerts(newest, table).select("user_id", *ALERT_COLUMNS)


def alert_counts(spark, sf):
    return alerts.alert_counts(alerts.threshold_alerts(_readings(spark, sf)))


def latest_per_node(spark, sf):
    return latest.latest_per_node(_readings(spark, sf)).select(*READING_COLUMNS)


def latest_in_recent_rows(spark, sf):
    return latest.latest_in_recent_rows(_readings(spark, sf), limits.RECENT_ROWS["nodes"]).select(*READING_COLUMNS)


def newest_readings(spark, sf):
    return latest.newest_rows(_readings(spark, sf), limits.RECENT_ROWS["dashboard"]).select(*READING_COLUMNS)


def last_24_per_node(spark, sf):
    return latest.last_readings(_readings(spark, sf), limits.SUITABILITY_HISTORY).select(
        "node_id", "event_id", "ts", "moisture_pct", F.col("rank").cast("long").alias("rank")
    )


def history_windows(spark, sf):
    rows = latest.history_windows(_readings(spark, sf), limits.FORECAST_HISTORY, ["moisture_pct"])
    return rows.select(
        "node_id", "readings_used", "status", F.element_at("rows", 1)["ts"].alias("oldest_ts"),
        F.element_at("rows", -1)["ts"].alias("newest_ts"), F.element_at("rows", 1)["moisture_pct"].alias("oldest_moisture"),
    )


def history_status(spark, sf):
    return latest.history_status(_readings(spark, sf), limits.FORECAST_HISTORY + limits.FORECAST_HORIZON)


def node_count(spark, sf):
    return latest.node_count(_readings(spark, sf))


def network_averages(spark, sf):
    averages = latest.network_averages(_readings(spark, sf))
    return averages.select("rows", *[F.round(c, 6).alias(c) for c in averages.columns if c != "rows"])


def node_status(spark, sf):
    return latest.node_states(latest.latest_per_node(_readings(spark, sf))).select("node_id", "ts", "online", "status")


def map_layers(spark, sf):
    return latest.node_states(latest.latest_per_node(_readings(spark, sf))).select(
        "node_id", "moisture_layer", "nitrogen_layer", "coverage_layer", "health_layer"
    )


def nodes_needing_attention(spark, sf):
    return latest.attention_count(latest.node_states(latest.latest_per_node(_readings(spark, sf))))


def metric_tone(spark, sf):
    tones = latest.metric_tones(latest.latest_per_node(_readings(spark, sf)))
    return tones.withColumn("fill_percent", F.round("fill_percent", 6)).withColumnRenamed("column", "metric")


def trend_series(spark, sf):
    return cleanse.chart_series(_readings(spark, sf))


def date_range_log(spark, sf):
    return cleanse.time_range(_readings(spark, sf), "2024-01-05", "2024-01-20").select(*READING_COLUMNS)


def date_range_whole_days(spark, sf):
    return cleanse.time_range(_readings(spark, sf), "2024-01-05", "2024-01-20", inclusive_end_day=True).select(*READING_COLUMNS)


def readings_with_node(spark, sf):
    return cleanse.with_node_id(_readings(spark, sf)).groupBy("node_id").agg(F.count(F.lit(1)).alias("readings"))


# Measures as a sensor gateway might write them: padded, with unit letters, grouped digits or NaN.
DIRTY_EXPR = (
    "case event_id%13 when 0 then cast(moisture_pct as {STR})||'d' when 1 then 'NaN' when 2 then '  '||cast(moisture_pct as {STR})||' ' "
    "when 3 then '1_000' when 4 then 'ERROR' when 5 then '+'||cast(moisture_pct as {STR}) when 6 then 'inf' else cast(moisture_pct as {STR}) end"
)


def coerced_measures(spark, sf):
    dirty = _readings(spark, sf).select("event_id", F.expr(DIRTY_EXPR.format(STR="string")).alias("moisture_text"))
    return dirty.withColumn("moisture", to_number(F.col("moisture_text")))


def raw_readings_renamed(spark, sf):
    """Readings written back under their raw names, then read through the canonical projection."""
    from agrispark.schemas import RAW_COLUMNS
    from agrispark.sources.telemetry import canonical

    names = {v: k for k, v in RAW_COLUMNS.items()}
    base = _readings(spark, sf)
    raw = base.select(*[
        (F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if c == "ts" else F.col(c).cast("string")).alias(names[c])
        for c in base.columns if c in names
    ])
    return canonical(raw).select("node_id", "ts", *MEASURES, "latitude", "satellites", "communication_ok")


def filled_features(spark, sf):
    return cleanse.fill_features(_readings(spark, sf)).select("event_id", *MEASURES)


def complete_readings(spark, sf):
    return cleanse.complete_rows(_readings(spark, sf), MEASURES).select("event_id", "node_id", *MEASURES)


def feature_columns(spark, sf):
    return cleanse.select_features(_readings(spark, sf), ["event_id"], MEASURES)


def crop_normalised(spark, sf):
    return cleanse.normalise_crop(_readings(spark, sf)).select("event_id", "target_crop", "crop_key", "crop_recognised")


def unknown_crops(spark, sf):
    return cleanse.unknown_crops(_readings(spark, sf))


def online_flags(spark, sf):
    from agrispark.functions.views import is_online

    return _readings(spark, sf).select("event_id", "communication_ok", is_online(F.col("communication_ok")).alias("online"))


POSITION_EXPR = "case when satellites = 'ERR' then 'no fix' else cast(latitude as {STR}) end"


def positioned_nodes(spark, sf):
    text = _readings(spark, sf).withColumn("latitude", F.expr(POSITION_EXPR.format(STR="string")))
    return cleanse.with_position(text).select("event_id", "node_id", "latitude", "longitude")


def readings_long(spark, sf):
    return cleanse.to_long(_readings(spark, sf), ["event_id"], MEASURES, "parameter")


def silent_nodes(spark, sf):
    readings = _readings(spark, sf)
    now = readings.agg(F.max("ts")).scalar()
    return latest.silent_nodes(readings, now, "12 hours")


def farm_snapshot(spark, sf):
    snapshot = latest.farm_snapshot(_readings(spark, sf))
    nodes = F.get_json_object("document", "$.nodes")
    return snapshot.select(
        "node_count", F.json_array_length(nodes).cast("long").alias("nodes_in_document"),
        F.get_json_object("document", "$.nodes[0].node_id").alias("first_node"), F.get_json_object("document", "$.status").alias("status"),
    )


def busiest_node_log(spark, sf):
    """All readings of the node that reports most."""
    readings = _readings(spark, sf)
    counts = cleanse.with_node_id(readings).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.agg(F.max_by("node_id", F.struct("n", "node_id"))).scalar()
    return cleanse.for_node(readings, busiest).select(*READING_COLUMNS)


def exported_log(spark, sf):
    """The filtered log written as CSV and read back with an explicit schema."""
    path = staging_path(spark, "log")
    exports.export_log_csv(_readings(spark, sf), path, "2024-01-05", "2024-01-20")
    back = spark.read.schema(TELEMETRY).option("header", True).csv(path)
    return back.select("event_id", "node_id", "ts", *MEASURES, "satellites", "communication_ok")


def node_documents(spark, sf):
    docs = latest.node_documents(latest.latest_per_node(_readings(spark, sf)))
    return docs.select(
        "node_id", F.get_json_object("document", "$.moisture_pct").cast("double").alias("moisture_pct"),
        F.get_json_object("document", "$.target_crop").alias("target_crop"),
    )


def nodes_by_week(spark, sf):
    """Nodes heard in each week and in all, exactly, and whether merged daily sketches come within three deviations."""
    path, readings = staging_path(spark, "sketches"), _readings(spark, sf)
    sketches.node_sketches(readings).write.parquet(path)
    stored = spark.read.parquet(path)
    week = lambda day: F.concat(F.lit("week "), F.floor(day / 7).cast("string"))
    first = (F.floor(F.col("slice") / 7) * 7).cast("long")
    weeks = stored.select(week(F.col("slice")).alias("name"), first.alias("first"), (first + 6).alias("last")).distinct()
    whole = stored.agg(F.min("slice").alias("first"), F.max("slice").alias("last")).select(F.lit("all").alias("name"), "first", "last")
    estimated = sketches.merged(stored, weeks.unionByName(whole))
    heard = cleanse.with_node_id(readings).where("ts IS NOT NULL")
    names = F.explode(F.array(F.lit("all"), week(sequences.time_bucket("ts"))))
    exact = heard.withColumn("name", names).groupBy("name").agg(F.count_distinct("node_id").alias("exact"))
    close = F.abs(F.col("nodes") - F.col("exact")) <= 3 * sketches.RELATIVE_ERROR * F.col("exact")
    return exact.join(estimated, "name").select("name", "exact", "readings", close.alias("close"))


QUERIES = {f.__name__: f for f in [
    threshold_alerts, threshold_alerts_recent, threshold_alerts_null_as_zero, alerts_with_overrides, alert_counts,
    latest_per_node, latest_in_recent_rows, newest_readings, last_24_per_node, history_windows, history_status,
    node_count, network_averages, node_status, map_layers, nodes_needing_attention, metric_tone, trend_series,
    date_range_log, date_range_whole_days, readings_with_node, coerced_measures, raw_readings_renamed,
    filled_features, complete_readings, feature_columns, crop_normalised, unknown_crops, online_flags,
    positioned_nodes, readings_long, silent_nodes, farm_snapshot, node_documents, busiest_node_log, exported_log, nodes_by_week,
]}
