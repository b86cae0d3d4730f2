"""Severity boundaries, diagnosis, actions and alerts against plain restatements."""

import itertools

import pytest
from pyspark.sql import functions as F

from agrispark.operators import alerts, diagnosis, prescriptions
from agrispark.rules import severity as rs
from agrispark.sources import dims

COLUMNS = [c for _, c, _, _ in rs.DIAGNOSIS_PARAMETERS]
SCHEMA = "id long, " + ", ".join(f"{c} double" for c in COLUMNS)


def plain_severity(parameter, v):
    key = (parameter, "default")
    if key in rs.ORGANIC_CUTS:
        return "Low" if v >= 2.0 else "Moderate" if v >= 1.5 else "High" if v >= 1.0 else "Critical"
    if key in rs.SALINITY_CUTS:
        return "Low" if v <= 1.0 else "Moderate" if v <= 1.5 else "High" if v <= 2.5 else "Critical"
    for bound, name in zip(rs.TWO_SIDED_CUTS[key], rs.TWO_SIDED):
        if v <= bound:
            return name
    return "Critical"


def test_boundaries(spark):
    rows, n = [], itertools.count()
    cuts = {p: c for (p, v), c in {**rs.TWO_SIDED_CUTS, **rs.SALINITY_CUTS, **rs.ORGANIC_CUTS}.items() if v == "default"}
    for i, (parameter, *_rest) in enumerate(rs.DIAGNOSIS_PARAMETERS):
        for cut in cuts[parameter]:
            for v in (cut - 0.1, cut, cut + 0.1):
                rows.append((next(n), *[v if j == i else None for j in range(len(COLUMNS))]))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = diagnosis.severities(frame, ["id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["severity"] == plain_severity(r["parameter"], r["value"]), r
    overall = {r["id"]: r["overall_severity"] for r in diagnosis.overall_severity(frame, ["id"]).collect()}
    assert all(overall[r["id"]] == r["severity"] for r in got)


@pytest.mark.parametrize("column, value, issue", [
    ("soil_ph", 6.0, "Alkaline Soil"), ("soil_ph", 4.0, "Critically Acidic Soil"), ("soil_ph", 4.1, "Acidic Soil"),
    ("soil_ph", 8.5, "Critically Alkaline Soil"), ("nitrogen_ppm", 20.0, "Nitrogen Excess"), ("nitrogen_ppm", 19.9, "Nitrogen Deficiency"),
    ("soil_moisture", 15.0, "Waterlogging"), ("soil_moisture", 8.0, "Severe Drought"), ("soil_moisture", 8.1, "Drought Stress"),
    ("soil_moisture", 35.0, "Severe Waterlogging"), ("soil_temperature", 18.0, "Heat Stress"), ("soil_temperature", 17.9, "Cold Stress"),
    ("electrical_conductivity", 1.5, "Mild Salinity"), ("electrical_conductivity", 2.6, "High Salinity"),
    ("organic_matter_percent", 1.5, "Low Organic Matter"), ("organic_matter_percent", 0.9, "Critically Low Organic Matter"),
])
def test_issue_names(spark, column, value, issue):
    frame = spark.createDataFrame([(1, *[value if c == column else None for c in COLUMNS])], SCHEMA)
    assert [r["issue"] for r in diagnosis.soil_issues(frame, ["id"]).collect()] == [issue]


def test_optimal_values_raise_nothing(spark):
    frame = spark.createDataFrame([(1, 6.5, 30.0, 20.0, 150.0, 20.0, 25.0, 0.5, 3.0)], SCHEMA)
    assert diagnosis.soil_issues(frame, ["id"]).count() == 0
    assert diagnosis.overall_severity(frame, ["id"]).first()["overall_severity"] == "Low"


def test_action_plan(spark):
    # pH critical, N deficient, dry, hot and saline
    frame = spark.createDataFrame([(1, 3.9, 4.0, None, None, 4.0, 36.0, 3.0, None), (2, 7.6, 50.0, None, None, None, None, None, None)], SCHEMA)
    issues = diagnosis.soil_issues(frame, ["id"])
    ranked = prescriptions.ranked_issues(issues, ["id"])
    plan = prescriptions.action_plan(ranked, ["id"])
    first = plan.where("id = 1").orderBy("priority").collect()
    assert [r["parameter"] for r in first] == ["pH", "Moisture", "Salinity (EC)", "Nitrogen", "Temperature"]
    assert [r["points"] for r in first] == [-50, -15, -15, 50, 65]
    assert first[0]["dosage"] == "8.0–9.0 tons/ha" and first[3]["dosage"] == "70 kg/ha of urea"
    second = plan.where("id = 2").collect()
    assert [(r["parameter"], r["dosage"]) for r in second] == [("pH", "500–1000 kg/ha")]  # excess nitrogen has no action
    summary = {r["id"]: r for r in prescriptions.plan_summary(ranked, ["id"]).collect()}
    assert summary[1]["overall_severity"] == "Critical" and len(summary[1]["critical_first_steps"]) == 3
    assert summary[2]["issues_count"] == 2 and summary[2]["monitoring_parameters"] == ["Moisture", "Nitrogen", "Temperature", "pH"]


def test_interactions(spark):
    frame = spark.createDataFrame([(1, 4.9, 21.0, None, None, 14.0, 31.0, None, None), (2, 5.0, 21.0, None, None, 15.0, 31.0, None, None)], SCHEMA)
    got = diagnosis.interactions(frame, ["id"]).collect()
    assert sorted((r["id"], r["interaction"]) for r in got) == [(1, "drought_heat"), (1, "drought_salt"), (1, "ph_nitrogen")]


READING = "event_id long, node_id string, ts timestamp_ntz, nitrogen_mg_kg double, phosphorus_mg_kg double, potassium_mg_kg double, moisture_pct double, temperature_c double, humidity_pct double"


def test_alert_severity_edges(spark):
    import datetime as dt

    ts = dt.datetime(2024, 1, 1, 6, 30)
    rows = [(i, "NODE_0001", ts, n, 50.0, 200.0, 40.0, 25.0, 50.0) for i, n in enumerate([16.0, 16.1, 20.0, 50.0, 59.9, 60.0, None])]
    got = {r["event_id"]: r for r in alerts.threshold_alerts(spark.createDataFrame(rows, READING)).collect()}
    assert {k: (v["severity"], v["direction"]) for k, v in got.items()} == {
        0: ("critical", "low"), 1: ("warning", "low"), 4: ("warning", "high"), 5: ("critical", "high")}
    assert got[0]["alert_id"] == "NODE_0001-nitrogen-2024-01-01 06:30:00"
    assert got[1]["message"] == "16.1 mg/kg is below your 20 mg/kg alert threshold."
    zero = alerts.threshold_alerts(spark.createDataFrame(rows, READING), null_as_zero=True).where("event_id = 6").collect()
    assert [r["severity"] for r in zero] == ["critical"]


def test_override_validity(spark):
    overrides = spark.createDataFrame([
        ("nitrogen", "10", "30"), ("moisture", "50", "40"), ("humidity", "x", "40"), ("potassium", "NaN", "900"),
    ], "metric string, min_text string, max_text string")
    got = {r["metric"]: (r["limit_min"], r["limit_max"]) for r in alerts.effective_limits(dims.alert_limits(spark), overrides).collect()}
    assert got["nitrogen"] == (10.0, 30.0) and got["moisture"] == (25.0, 65.0)
    assert got["humidity"] == (30.0, 85.0) and got["potassium"] == (150.0, 260.0) and got["temperature"] == (18.0, 30.0)


def test_severity_table_has_every_variant(spark):
    table = dims.severity_bands(spark)
    assert table.select(F.countDistinct("parameter", "variant")).first()[0] == 13
