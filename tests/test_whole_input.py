"""No row may vanish: folder-form tables, healthy payloads, several users, missing keys, further crops, time zones."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from agrispark.functions.numeric import one_decimal
from agrispark.operators import alerts, scoring, sequences
from agrispark.plans import flows, stream_queries, telemetry_queries
from agrispark.rules import actions as ra
from agrispark.sources import dims
from agrispark.sources.telemetry import readings_from_events
from agrispark.streaming import readings

SF = "/root/testdata/sf0.001"
PAYLOAD = "id long, soil_ph double, soil_moisture double, soil_temperature double, nitrogen_ppm double, phosphorus_ppm double, potassium_ppm double, electrical_conductivity double, organic_matter_percent double"


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("folder")
    for name in ("events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return str(base)


@pytest.mark.parametrize("query", [stream_queries.stream_alerts, stream_queries.stream_latest, stream_queries.stream_chunk_store])
def test_streams_read_folders_like_files(spark, folder_tables, query):
    count = query(spark, SF).count()
    assert count > 0 and query(spark, folder_tables).count() == count


@pytest.fixture(scope="module")
def shuffled_parts(spark, tmp_path_factory):
    """The events in over 300 part files, each from all times; Spark drops late rows from the third micro-batch on."""
    base = tmp_path_factory.mktemp("parts")
    spark.read.parquet(f"{SF}/events.parquet").repartition(320, F.xxhash64("event_id")).write.parquet(f"{base}/events.parquet")
    assert len(list((base / "events.parquet").glob("*.parquet"))) > 200
    return str(base)


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_windows", "stream_silent_nodes"])
def test_streams_behind_a_watermark_read_every_part(spark, shuffled_parts, name, monkeypatch):
    """Over more part files than a micro-batch takes, and in several slices of time, the result is the batch result."""
    monkeypatch.setattr(readings, "SLICE_ROWS", 300, raising=False)
    events = readings_from_events(spark, SF)
    end = events.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    if name == "stream_deduplicated":
        expected = events.select("event_id", "node_id", "moisture_pct")
    elif name == "stream_silent_nodes":
        last = events.groupBy("node_id").agg(F.max("ts").alias("last_seen"))
        expected = last.where(F.col("last_seen") <= F.lit(end - dt.timedelta(hours=12)).cast("timestamp_ntz"))
    else:
        order = Window.partitionBy("node_id").orderBy("ts", "event_id")
        old, new = F.coalesce(F.lag("moisture_pct", 23).over(order), F.lit(0.0)), F.coalesce("moisture_pct", F.lit(0.0))
        numbered = events.select("node_id", "event_id", F.lit(24).alias("length"), old.alias("a"), new.alias("b"), "ts", F.row_number().over(order).alias("rn"))
        expected = numbered.where((F.col("rn") >= 24) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))).drop("rn", "ts")
    wanted = sorted(map(str, map(tuple, expected.collect())))
    got = sorted(map(str, map(tuple, getattr(stream_queries, name)(spark, shuffled_parts).collect())))
    assert wanted and got == wanted


def test_healthy_payloads_have_a_plan(spark):
    payloads = spark.createDataFrame([(1, 6.5, 22.0, 24.0, None, None, None, None, None), (2, 3.0, 22.0, 24.0, None, None, None, None, None), (3, *[None] * 8)], PAYLOAD)
    _, summary = flows.plans_for(payloads, ["id"])
    rows = {r["id"]: r for r in summary.collect()}
    assert set(rows) == {1, 2, 3} and rows[2]["issues_count"] == 1
    for i in (1, 3):
        assert (rows[i]["issues_count"], rows[i]["overall_severity"], rows[i]["expected_timeline"]) == (0, "Low", ra.TIMELINES["Low"])
        assert rows[i]["critical_first_steps"] == [] and rows[i]["monitoring_parameters"] == ["Moisture", "Temperature"]


def test_every_user_has_every_limit(spark):
    overrides = spark.createDataFrame([(1, "nitrogen", "1", "2"), (2, "moisture", "30", "3")], "user_id long, metric string, min_text string, max_text string")
    more = spark.createDataFrame([(3,)], "user_id long")
    got = {(r["user_id"], r["metric"]): (r["limit_min"], r["limit_max"]) for r in alerts.effective_limits(dims.alert_limits(spark), overrides, more).collect()}
    defaults = {r["metric"]: (r["limit_min"], r["limit_max"]) for r in dims.alert_limits(spark).collect()}
    assert len(got) == 18
    for user in (1, 2, 3):
        assert {m: got[user, m] for m in defaults} == {**defaults, **({"nitrogen": (1.0, 2.0)} if user == 1 else {})}


def test_flags_of_an_unknown_crop_fail(spark):
    payload = spark.createDataFrame([(1, "teff", 6.0)], "id long, crop_key string, soil_ph double")
    with pytest.raises(Exception, match="no threshold profile"):
        scoring.param_flags(payload, dims.crop_profiles(spark), ["id"]).collect()


def test_suitability_knows_every_profile(spark):
    maize = dims.crop_profiles(spark)
    both = maize.unionByName(maize.withColumn("crop_key", F.lit("cassava")))
    readings = spark.createDataFrame([("Cassava", 30.0), ("teff", 30.0)], "target_crop string, moisture_pct double").withColumns(
        {c: F.lit(None).cast("double") for c in ("nitrogen_mg_kg", "phosphorus_mg_kg", "potassium_mg_kg", "temperature_c", "humidity_pct")}
    )
    assert [r["crop_key"] for r in scoring.suitability(readings, both).orderBy("target_crop").collect()] == ["cassava", "maize_corn"]


def test_positions_keep_rows_without_key_or_time(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, 1), ("a", None, 2), (None, at, 3), ("a", at + dt.timedelta(days=2), 4)]
    frame = spark.createDataFrame(rows, "node_id string, ts timestamp_ntz, event_id long")
    got = sequences.chronological_split(frame, ["node_id"]).collect()
    assert {r["event_id"]: (r["seq"], r["key_rows"]) for r in got} == {2: (0, 3), 1: (1, 3), 4: (2, 3), 3: (0, 1)}


def test_positions_do_not_depend_on_the_session_zone(spark):
    times = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 0), dt.datetime(2024, 3, 10, 3, 45)]
    frame = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "node_id string, ts timestamp_ntz, event_id long")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        placed = sequences.with_position_in_key(frame, ["node_id"], ["ts", "event_id"], sequences.time_bucket("ts", 3600))
        assert {r["event_id"]: r["seq"] for r in placed.collect()} == {0: 0, 1: 1, 2: 2}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers_in_alert_texts(spark):
    cases = [(24.45, "24.4"), (-0.04, "0"), (0.25, "0.3"), (-0.25, "-0.3"), (0.75, "0.8"), (3.0, "3"), (1234.56, "1234.6"), (29.85, "29.9"), (0.05, "0.1")]
    frame = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    got = [r["t"] for r in frame.select("i", one_decimal(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [t for _, t in cases]


def test_override_query_covers_all_users(spark):
    users = {r["user_id"] for r in telemetry_queries.alerts_with_overrides(spark, SF).select("user_id").distinct().collect()}
    assert users == {0, 1, 2, 3, 4}
