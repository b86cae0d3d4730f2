"""Windows, positions, splits and latest state against plain Python, with hot nodes and tiny blocks."""

import math
import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agrispark.operators import latest, models, sequences
from agrispark.rules.crop_profile import FEATURES

SCHEMA = "event_id long, node_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in FEATURES)
START = dt.datetime(2024, 1, 1)


def readings(spark, counts, seed=0, step_hours=5):
    """Rows per node as given, in shuffled order, with repeated timestamps."""
    rng, rows, n = random.Random(seed), [], 0
    for node, count in counts.items():
        for i in range(count):
            rows.append((n, node, START + dt.timedelta(hours=step_hours * (i // 2)), *[float(n * k % 17) if n % 11 else None for k in range(1, 7)]))
            n += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


def by_node(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("block_rows, bucket_seconds", [(4096, 86400), (7, 3600), (3, 7200)])
def test_windows_match_plain_slices(spark, block_rows, bucket_seconds):
    rows, frame = readings(spark, {"hot": 60, "a": 9, "b": 5, "c": 1})
    got = sequences.sliding_windows(
        frame, 5, FEATURES, horizon=3, target="moisture_pct", bucket_seconds=bucket_seconds, block_rows=block_rows
    ).collect()
    expected = {}
    for node, series in by_node(rows).items():
        for i in range(4, len(series) - 3):
            expected[series[i][0]] = ([list(r[3:]) for r in series[i - 4:i + 1]], series[i + 3][6], i)
    assert {r["event_id"]: ([list(s) for s in r["window"]], r["target_value"], r["seq"]) for r in got} == expected


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(1, 30), min_size=1, max_size=4), length=st.integers(1, 8), block=st.integers(1, 9))
def test_window_count(spark, counts, length, block):
    _, frame = readings(spark, {f"n{i}": c for i, c in enumerate(counts)})
    got = sequences.sliding_windows(frame, length, ["moisture_pct"], block_rows=block)
    assert got.count() == sum(max(0, c - length + 1) for c in counts)
    assert got.where(F.size("window") != length).count() == 0


def test_positions_are_dense(spark):
    rows, frame = readings(spark, {"hot": 40, "a": 3})
    placed = sequences.with_position_in_key(frame, ["node_id"], ["ts", "event_id"], sequences.time_bucket("ts", 3600)).collect()
    expected = {r[0]: (i, len(series)) for series in by_node(rows).values() for i, r in enumerate(series)}
    assert {r["event_id"]: (r["seq"], r["key_rows"]) for r in placed} == expected


def test_latest_and_last_n(spark):
    rows, frame = readings(spark, {"hot": 50, "a": 4, "b": 1})
    series = by_node(rows)
    assert {r["node_id"]: r["event_id"] for r in latest.latest_per_node(frame).collect()} == {n: s[-1][0] for n, s in series.items()}
    got = latest.last_readings(frame, 7).collect()
    assert {(r["node_id"], r["rank"]): r["event_id"] for r in got} == {
        (n, k + 1): r[0] for n, s in series.items() for k, r in enumerate(reversed(s[-7:]))}
    history = {r["node_id"]: r for r in latest.history_windows(frame, 7, ["moisture_pct"]).collect()}
    assert [x["event_id"] for x in history["hot"]["rows"]] == [r[0] for r in series["hot"][-7:]]
    assert history["hot"]["status"] == "ok" and history["a"]["status"] == "insufficient_data"


def test_quiet_nodes_leave_the_recent_view(spark):
    rows, frame = readings(spark, {"hot": 50, "a": 4})
    newest = sorted(rows, key=lambda r: (r[2], r[0]))[-10:]
    assert {r["node_id"] for r in latest.latest_in_recent_rows(frame, 10).collect()} == {r[1] for r in newest}


def test_split_shares(spark):
    _, frame = readings(spark, {"x": 101})
    got = {r["split"]: r["count"] for r in sequences.chronological_split(frame, []).groupBy("split").count().collect()}
    assert got == {"train": 70, "validation": 15, "test": 16}


def test_scaling(spark):
    frame = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, None, 5.0)], "id long, a double, b double")
    params = sequences.scaler_params(frame, ["a", "b"])
    got = sequences.scale(frame, params, ["a", "b"]).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_class_weights(spark):
    frame = spark.createDataFrame([("Poor",)] * 6 + [("Fair",)] * 2, "suitability_label string")
    got = {r["label"]: r["class_weight"] for r in sequences.class_weights(frame).collect()}
    assert got == {"Poor": pytest.approx(8 / 18), "Fair": pytest.approx(8 / 6), "Good": 1.0}


def test_metrics(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (5.0, 3.0)], "p double, y double")
    m = models.regression_metrics(frame, "p", "y").first()
    assert m["mae"] == pytest.approx(1.0) and m["rmse"] == pytest.approx((5 / 3) ** 0.5) and m["r2"] == pytest.approx(1 - (5 / 3) / (2 / 9))
    bins = models.residual_histogram(frame, "p", "y", 3).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(0, 1), (2, 2)]
    c = spark.createDataFrame([([0.7, 0.2, 0.1], 0), ([0.2, 0.5, 0.3], 2)], "probs array<double>, label int")
    assert models.classification_metrics(c, "probs", "label").first()["accuracy"] == 0.5
    label, confidence = models.argmax_class(F.col("probs"))
    assert [tuple(r) for r in c.select(label, confidence).collect()] == [("Poor", 0.7), ("Fair", 0.5)]


def test_boosted_trees_stop_early_and_metrics_equal_sql(spark, tmp_path):
    """Targets that a step of the window decides: trees stop before their limit and beat the mean by far."""
    import random

    import duckdb

    from agrispark.operators import models

    rng = random.Random(3)
    rows = []
    for i in range(600):
        window = [[rng.random()] for _ in range(4)]
        split = "train" if i < 400 else "validation" if i < 500 else "test"
        rows.append((i, window, float(window[2][0] > 0.5) + rng.gauss(0, 0.05), split))
    samples = models.as_features(spark.createDataFrame(rows, "event_id long, window array<array<double>>, target_value double, split string"), 4)
    model = models.fit_boosted_forecast(samples, most_trees=60)
    assert 0 < model.stages[-1].getNumTrees < 60
    model.transform(samples.where("split = 'test'")).select("event_id", "prediction", "target_value").write.parquet(str(tmp_path / "p"))
    got = models.regression_metrics(spark.read.parquet(str(tmp_path / "p")), "prediction", "target_value").first()
    wanted = duckdb.sql(f"""WITH b AS (SELECT target_value - prediction AS r, target_value AS y FROM '{tmp_path}/p/*.parquet')
        SELECT count(*), avg(abs(r)), sqrt(avg(r * r)), 1 - avg(r * r) / var_pop(y), avg(r) FROM b""").fetchall()[0]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, wanted)) and got["r2"] > 0.8


def test_sketches_of_ranges(spark):
    import datetime as dt

    from agrispark.operators import sketches

    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(days=d), f"n{d * 500 + i}" if i % 2 else f"s{i}") for d in range(4) for i in range(3000)] + [(9, None, "x"), (9, day, None)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, node_id string").repartition(3)
    stored = sketches.node_sketches(frame)
    assert stored.count() == 4
    first = stored.agg({"slice": "min"}).first()[0]
    ranges = spark.createDataFrame([("one", first, first), ("two", first + 1, first + 2), ("all", first, first + 9)], "name string, first long, last long")
    for r in sketches.merged(stored, ranges).collect():
        days = {"one": range(1), "two": range(1, 3), "all": range(4)}[r["name"]]
        exact = len({n for _, t, n in rows if t is not None and n is not None and (t - day).days in days})
        assert abs(r["nodes"] - exact) <= 4 * sketches.RELATIVE_ERROR * exact and r["readings"] == 3000 * len(days)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_stored_windows_are_the_same_and_their_number_decides_on_partitions(spark, tmp_path, monkeypatch, block_rows):
    """Blocks read back give the windows of blocks that aren't stored, in partitions that the windows' values fill."""
    monkeypatch.setattr(sequences, "VALUES_PER_PART", 200)
    rows, frame = readings(spark, {"hot": 60, "a": 9, "b": 5, "c": 1, None: 8})
    given = {"length": 5, "features": FEATURES, "horizon": 3, "target": "moisture_pct", "block_rows": block_rows}
    stored = sequences.sliding_windows(frame, **given, path=str(tmp_path / "blocks"))
    key = lambda r: r["event_id"]
    assert sorted(stored.collect(), key=key) == sorted(sequences.sliding_windows(frame, **given).collect(), key=key)
    assert stored.rdd.getNumPartitions() >= len(rows) * 5 * len(FEATURES) // 200


def test_split_of_windows_by_their_positions(spark, tmp_path):
    _, frame = readings(spark, {"hot": 90, "a": 30, "b": 9, "c": 2, None: 12})
    windows = sequences.sliding_windows(frame, 5, FEATURES, horizon=3, target="moisture_pct", path=str(tmp_path / "blocks"))
    columns = ["node_id", "event_id", "seq", "key_rows", "split"]
    got = sequences.split_windows(windows, 5, 3).select(*columns)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    wanted = sequences.chronological_split(windows, ["node_id"]).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
