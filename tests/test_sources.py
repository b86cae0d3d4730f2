"""Readers and writers: raw telemetry, forecast files, profiles, conversations, exports and saved parameters."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.operators import cleanse, models, scoring, sequences
from agrispark.rules import crop_profile as cp
from agrispark.session import shared_dir, spread, staging_path
from agrispark.sources import conversations, dims, exports, profiles, telemetry

SF = "/root/testdata/sf0.001"


def test_raw_json(spark, tmp_path):
    rows = [
        {"Timestamp": "2024-01-01 10:00:00", "Node_ID": "N1", "Moisture_%": 31.5, "Nitrogen_mg_k": "5d", "Satellites": "ERR", "communication_ok": False},
        {"Timestamp": "bad", "Node_ID": "", "Moisture_%": "1e1", "Temperature_C": None, "Satellites": 6},
    ]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = telemetry.read_telemetry(spark, str(tmp_path), "json").orderBy(F.col("node_id").desc()).collect()
    assert (got[0]["moisture_pct"], got[0]["nitrogen_mg_kg"], got[0]["satellites"], got[0]["communication_ok"]) == (31.5, None, "ERR", "false")
    assert got[1]["ts"] is None and got[1]["moisture_pct"] == 10.0 and got[1]["altitude_m"] is None
    assert cleanse.with_node_id(telemetry.read_telemetry(spark, str(tmp_path), "json")).count() == 1


def test_forecast_csv(spark, tmp_path):
    header = "timestamp," + ",".join(schemas.FORECAST_FEATURES + schemas.FORECAST_STATICS)
    (tmp_path / "f.csv").write_text(f"{header}\n2024-01-01 00:00:00,20,50,30,1,2,3,0.5,8.4,4.5,Maize,Clay,V1\n2024-01-01 01:00:00,21,,30,1,2,3,0,8.4,4.5,Maize,Clay,V1\n")
    frame = telemetry.read_forecast_csv(spark, str(tmp_path / "f.csv"))
    slim = cleanse.select_features(frame, ["timestamp"], schemas.FORECAST_FEATURES)
    seen = Observation()
    kept = cleanse.complete_rows(slim, schemas.FORECAST_FEATURES, seen)
    assert kept.count() == 1 and kept.columns == ["timestamp", *schemas.FORECAST_FEATURES]
    assert seen.get == {"rows": 2, "dropped": 1}


def profile_json():
    names = ["optimal_min", "optimal_max", "critical_min", "critical_max"]
    return {"crop_profiles": {"maize_corn": {
        "parameters": {row[0]: {
            "display_name": row[1], "unit": row[2], **dict(zip(names, row[3:7])),
            "direction_labels": {"low": row[7], "high": row[8], "none": cp.NOMINAL_LABEL},
            "intervention_hints": {"low": row[9], "high": row[10], "none": row[11]},
        } for row in cp.MAIZE_PARAMETERS},
        "composite_health_scoring": {
            "weights": {k: 1.0 for k in cp.PARAM_KEYS},
            "score_bands": {b: {"min": lo, "max": hi, "label": label, "color": color} for b, lo, hi, label, color in cp.SCORE_BANDS},
        },
    }}}


def test_profile_file_equals_the_built_in_profile(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(profile_json()))
    thresholds, weights, bands = profiles.read_profile_dims(spark, str(path))
    assert (thresholds.count(), weights.count(), bands.count()) == (10, 10, 5)
    nested = profiles.nest_profiles(thresholds, weights, bands)
    payloads = telemetry.payloads_from_events(spark, SF).withColumn("crop_key", F.lit("maize_corn"))
    columns = ["event_id", "field_health_score", "health_band", "critical_parameters"]
    from_file = scoring.evaluate(payloads, nested, ["event_id"]).select(*columns).collect()
    built_in = scoring.evaluate(payloads, dims.crop_profiles(spark), ["event_id"]).select(*columns).collect()
    assert sorted(map(tuple, from_file)) == sorted(map(tuple, built_in))
    path.write_text('{"crop_profiles": {}}')
    with pytest.raises(ValueError):
        profiles.read_profile_dims(spark, str(path))


def test_conversations(spark, tmp_path):
    for i, name in enumerate(["conv-00001", "conv-00002"]):
        messages = [{"role": "user", "content": f"q{j}"} for j in range(i + 2)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"conversation_id": name, "messages": messages, "updated_at": "x"}, indent=2))
    stored = conversations.read_conversations(spark, str(tmp_path))
    assert stored.count() == 5
    new = spark.createDataFrame([("conv-00002", "user", "again", 1), ("conv-00002", "assistant", "yes", 2), ("conv-00003", "user", "hi", 1)], "conv_id string, role string, text string, n int")
    got = sorted((r["conv_id"], r["turn"], r["text"]) for r in conversations.append_turns(stored, new, "n").collect())
    assert got == [("conv-00002", 3, "again"), ("conv-00002", 4, "yes"), ("conv-00003", 0, "hi")]


def turns_of(spark, path):
    return sorted(map(tuple, conversations.read_turns(spark, path, "string").collect()))


def test_batches_of_turns_are_stored_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "turns")
    batch = lambda *rows: spark.createDataFrame(list(rows), "conv_id string, role string, text string, n long")
    conversations.store_turns(spark, batch(("a", "user", "hi", 1), ("a", "assistant", "yes", 2)), path, "n", 0)
    second = batch(("a", "user", "more", 3), ("b", "user", "new", 1))
    conversations.store_turns(spark, second, path, "n", 1)
    stored = turns_of(spark, path)
    assert stored == [("a", 0, "user", "hi"), ("a", 1, "assistant", "yes"), ("a", 2, "user", "more"), ("b", 0, "user", "new")]
    conversations.store_turns(spark, second, path, "n", 1)  # tried again
    assert turns_of(spark, path) == stored
    failing = batch(("b", "user", "late", 2)).withColumn("text", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        conversations.store_turns(spark, failing, path, "n", 2)
    spark.createDataFrame([("b", 9, "user", "half")], "conv_id string, turn long, role string, text string").write.mode("overwrite").parquet(f"{path}/turns/batch=2")
    assert turns_of(spark, path) == stored  # what was written without a commit is not seen
    conversations.store_turns(spark, batch(("b", "user", "late", 2)), path, "n", 2)
    assert turns_of(spark, path) == [*stored, ("b", 1, "user", "late")]


def test_a_conversation_is_a_line(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "user", f"{c} {t}\nline") for c in range(30) for t in range(c % 4 + 1)], "conv_id long, turn long, role string, text string")
    conversations.write_conversations(turns.repartition(3), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 30
    back = conversations.read_conversations(spark, str(tmp_path / "c"), lines=True)
    assert sorted((int(r["conv_id"]), r["turn"], r["text"]) for r in back.collect()) == sorted((r["conv_id"], r["turn"], r["text"]) for r in turns.collect())


def test_compacted_store_goes_on(spark, tmp_path):
    from agrispark.sources import corpus

    chunk = lambda i, text: (f"c{i}", text, "s", 0, i, len(text), "markdown")
    frame = lambda rows: spark.createDataFrame(rows, schemas.CHUNKS)
    path, target = str(tmp_path / "s"), str(tmp_path / "t")
    corpus.write_chunks(spark, frame([chunk(i, "old") for i in range(20)]), path)
    corpus.write_chunks(spark, frame([chunk(i, "new") for i in range(5)]), path)
    assert spark.read.parquet(path).count() == 25
    corpus.compact_chunks(spark, path, target, 4)
    assert spark.read.parquet(target).count() == 20
    before = sorted(map(tuple, corpus.read_chunks(spark, path).collect()))
    assert sorted(map(tuple, corpus.read_chunks(spark, target).collect())) == before
    corpus.write_chunks(spark, frame([chunk(i, "new") for i in range(5)]), target)
    assert spark.read.parquet(target).count() == 20
    corpus.write_chunks(spark, frame([chunk(3, "newest"), chunk(77, "more")]), target)
    got = {r["chunk_id"]: r["text"] for r in corpus.read_chunks(spark, target).collect()}
    assert (spark.read.parquet(target).count(), len(got), got["c3"], got["c77"], got["c9"]) == (22, 21, "newest", "more", "old")


@pytest.mark.parametrize("name, ok", [("abcd-1234", True), (" abcd_1234 ", True), ("short", False), ("has space 1", False), ("x" * 65, False), (None, False)])
def test_conversation_id(spark, name, ok):
    accepted, quarantined = cleanse.split_by_conversation_id(spark.createDataFrame([(name,)], "cid string"), "cid")
    assert (accepted.count(), quarantined.count()) == ((1, 0) if ok else (0, 1))


def test_export_and_node_filter(spark, tmp_path):
    readings = telemetry.readings_from_events(spark, SF)
    exports.export_log_csv(readings, str(tmp_path / "log"), "2024-01-03", "2024-01-04")
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert back.count() == cleanse.time_range(readings, "2024-01-03", "2024-01-04").count() > 0
    assert cleanse.time_range(readings, None, None).count() == readings.count()
    whole_day = cleanse.time_range(readings, "2024-01-03", "2024-01-04", inclusive_end_day=True)
    assert whole_day.count() > back.count()
    node = readings.first()["node_id"]
    assert {r["node_id"] for r in cleanse.for_node(readings, node).collect()} == {node}


def test_saved_parameters_and_models(spark, tmp_path):
    readings = telemetry.readings_from_events(spark, SF)
    params = sequences.scaler_params(readings)
    exports.save_scaler(params, str(tmp_path / "scaler"))
    assert sorted(map(tuple, exports.load_scaler(spark, str(tmp_path / "scaler")).collect())) == sorted(map(tuple, params.collect()))
    exports.save_label_map(spark, str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 3
    scaled = cleanse.fill_features(sequences.scale(readings, params))
    samples = models.as_features(sequences.sliding_windows(scaled, 6, horizon=2, target="moisture_pct"), 6)
    model = models.fit_forecast(samples)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    predict = lambda m: {r["event_id"]: r["prediction"] for r in m.transform(samples).collect()}
    assert predict(again) == predict(model)
    assert models.as_features(samples.select("event_id", "window"), 7).count() == 0  # wrong window length


def test_spread_only_when_needed(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_staged_tables_belong_to_the_application(spark):
    path = staging_path(spark, "some")
    assert path.startswith(f"{shared_dir(spark).rstrip('/')}/agrispark/{spark.sparkContext.applicationId}/some-")
    assert path != staging_path(spark, "some")


def test_compaction_deals_rows_once_and_reads_only_what_is_asked(spark, tmp_path):
    """One shuffle finds the newest rows and brings them to their folders; expressions of the newest rows can be read."""
    from agrispark.sources import corpus

    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, schemas.CHUNKS)
    row = lambda i, text: (f"c{i}", text, "s", 0, i, len(text), "markdown")
    corpus.write_chunks(spark, frame([row(i, "old") for i in range(12)]), path)
    corpus.write_chunks(spark, frame([row(i, "new") for i in range(4)]), path)
    newest = corpus.newest_by_bucket(spark.read.parquet(path), 3)
    assert newest._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["chunk_id"], r["text"]) for r in newest.collect()} == {(f"c{i}", "new" if i < 4 else "old") for i in range(12)}
    short = corpus.read_chunks(spark, path, (F.col("text") == "new").alias("is_new"))
    assert sorted(map(tuple, short.collect())) == sorted((f"c{i}", i < 4) for i in range(12))
