"""Scenario payloads, score anchors and missing-value rules of evaluation and suitability."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agrispark.functions import soil
from agrispark.functions.numeric import fixed, rounded, to_number
from agrispark.operators import cleanse, scoring
from agrispark.rules.crop_profile import PARAM_KEYS
from agrispark.sources import dims

SCENARIOS = {
    "acid_soil": (4.6, 52.0, 26.0, 17.0, 11.0, 95.0, 0.7, 1.8, 68.0, 28.0),
    "drought_stress": (6.4, 16.0, 38.0, 24.0, 19.0, 165.0, 1.2, 2.8, 22.0, 37.0),
    "waterlogged": (6.2, 88.0, 22.0, 8.5, 14.0, 100.0, 0.4, 7.5, 92.0, 24.0),
    "saline_soil": (7.8, 55.0, 28.0, 50.0, 40.0, 420.0, 3.5, 2.0, 55.0, 30.0),
    "fertile_optimal": (6.4, 58.0, 26.0, 32.0, 22.0, 195.0, 1.2, 4.2, 62.0, 28.0),
    "nutrient_poor": (5.6, 45.0, 25.0, 9.0, 5.0, 55.0, 0.3, 0.9, 57.0, 27.0),
}
EXPECTED = {
    "acid_soil": (68.4, "FAIR", 1, 4), "drought_stress": (65.3, "FAIR", 2, 3), "waterlogged": (56.6, "FAIR", 2, 5),
    "saline_soil": (59.8, "FAIR", 2, 4), "fertile_optimal": (97.3, "EXCELLENT", 0, 0), "nutrient_poor": (58.7, "FAIR", 4, 2),
}


def payload_frame(spark, rows):
    schema = "scenario string, crop_key string, " + ", ".join(f"{k} double" for k in PARAM_KEYS)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def scenarios(spark):
    return payload_frame(spark, [(name, "maize_corn", *values) for name, values in SCENARIOS.items()])


@pytest.fixture(scope="module")
def evaluated(spark, scenarios):
    return {r["scenario"]: r for r in scoring.evaluate(scenarios, dims.crop_profiles(spark), ["scenario"]).collect()}


@pytest.fixture(scope="module")
def flags(spark, scenarios):
    rows = scoring.param_flags(scenarios, dims.crop_profiles(spark), ["scenario"]).collect()
    return {(r["scenario"], r["param_key"]): r for r in rows}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_scenario_scores(evaluated, name):
    r = evaluated[name]
    assert (r["field_health_score"], r["health_band"], r["critical_count"], r["warning_count"]) == EXPECTED[name]
    assert len(r["critical_parameters"]) == r["critical_count"]
    assert r["requires_intervention"] == (r["critical_count"] + r["warning_count"] > 0)


@pytest.mark.parametrize("key, status, side", [
    (("acid_soil", "soil_ph"), "CRITICAL", "LOW"), (("drought_stress", "soil_moisture"), "CRITICAL", "LOW"),
    (("saline_soil", "electrical_conductivity"), "CRITICAL", "HIGH"), (("nutrient_poor", "nitrogen_ppm"), "CRITICAL", "LOW"),
    (("nutrient_poor", "phosphorus_ppm"), "CRITICAL", "LOW"), (("nutrient_poor", "potassium_ppm"), "CRITICAL", "LOW"),
])
def test_scenario_flags(flags, key, status, side):
    assert (flags[key]["status"], flags[key]["direction"]) == (status, side)


def test_flags_and_scores_agree(evaluated, flags):
    for name, r in evaluated.items():
        for f in r["flags"]:
            assert [x for x in flags.values() if x["scenario"] == name and x["display_name"] == f["display_name"]][0]["status"] == f["status"]


def test_report_text(spark, scenarios):
    profiles = dims.crop_profiles(spark)
    reports = scoring.report_block(
        scoring.evaluate(scenarios, profiles, ["scenario"]), scoring.param_flags(scenarios, profiles, ["scenario"]), ["scenario"]
    )
    texts = {r["scenario"]: r["report"] for r in reports.collect()}
    for text in texts.values():
        assert text.startswith("=== FIELD EVALUATION REPORT ===") and text.endswith("=== END EVALUATION REPORT ===")
        assert "Field Health" in text
    assert "CRITICAL FLAGS" in texts["acid_soil"] and "68.4" in texts["acid_soil"]
    assert "NOMINAL PARAMETERS" in texts["fertile_optimal"] and "CRITICAL FLAGS" not in texts["fertile_optimal"]
    assert "irrigation" in texts["drought_stress"].lower()


def test_reports_of_placed_payloads_move_no_text(spark, scenarios):
    """Once payloads lie by their keys, neither their lines nor their scores are shuffled; repeated keys keep all lines."""
    profiles, keys = dims.crop_profiles(spark), ["scenario"]
    twice = scenarios.unionByName(scenarios.where("scenario = 'acid_soil'"))
    report = lambda p: scoring.report_block(scoring.evaluate(p, profiles, keys), scoring.param_flags(p, profiles, keys), keys)
    placed = report(scoring.placed_by_payload(twice, keys))
    moved = [x for x in placed._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(scenario" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)
    assert sorted(map(str, placed.collect())) == sorted(map(str, report(twice).collect()))


def bounds(*values):
    return [F.lit(x) for x in values]


def on_ph(spark, values, *expressions):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    return frame.select("v", *expressions).orderBy("v").collect()


def test_anchors(spark):
    v, PH = F.col("v"), bounds(5.8, 7.0, 5.0, 8.0)
    rows = on_ph(
        spark, [6.4, 5.8, 7.0, 5.4, 7.5, 5.0, 8.0, 1.0], soil.status(v, *PH).alias("s"), soil.direction(v, *PH).alias("d"),
        soil.deviation(v, *PH[:2]).alias("a"), soil.relative_deviation(v, *PH[:2]).alias("r"), soil.health_score(v, *PH).alias("p"),
    )
    got = {r["v"]: r for r in rows}
    assert (got[6.4]["s"], got[6.4]["d"], got[6.4]["p"]) == ("OK", "NONE", pytest.approx(100.0))
    for edge in (5.8, 7.0):
        assert (got[edge]["s"], got[edge]["a"], got[edge]["p"]) == ("OK", 0.0, pytest.approx(70.0))
    assert (got[5.4]["s"], got[5.4]["d"]) == ("WARNING", "LOW")
    assert got[5.4]["a"] == pytest.approx(0.4) and got[5.4]["r"] == pytest.approx(33.333, abs=0.01) and got[5.4]["p"] == pytest.approx(50.0)
    assert (got[7.5]["s"], got[7.5]["d"]) == ("WARNING", "HIGH") and got[7.5]["p"] == pytest.approx(50.0)
    for edge, side in ((5.0, "LOW"), (8.0, "HIGH")):
        assert (got[edge]["s"], got[edge]["d"], got[edge]["p"]) == ("CRITICAL", side, pytest.approx(30.0))
    assert got[1.0]["p"] == 0.0


def test_score_falls_away_from_the_midpoint(spark):
    v, PH = F.col("v"), bounds(5.8, 7.0, 5.0, 8.0)
    rows = on_ph(spark, [x / 20 for x in range(0, 281)], soil.health_score(v, *PH).alias("p"), soil.suitability_score(v, *PH).alias("q"))
    assert all(0.0 <= r["p"] <= 100.0 and 0.0 <= r["q"] <= 100.0 for r in rows)
    low = [r["p"] for r in rows if r["v"] <= 6.4]
    high = [r["p"] for r in rows if r["v"] >= 6.4]
    assert low == sorted(low) and high == sorted(high, reverse=True)


def test_degenerate_ranges(spark):
    v = F.col("v")
    point = bounds(5.0, 5.0, 5.0, 5.0)
    rows = on_ph(spark, [4.0, 5.0, 6.0], soil.health_score(v, *point).alias("p"), soil.relative_deviation(v, *point[:2]).alias("r"))
    assert [r["p"] for r in rows] == [30.0, 100.0, 30.0] and [r["r"] for r in rows] == [0.0, 0.0, 0.0]
    inverted = bounds(5.0, 7.0, 6.0, 6.5)
    rows = on_ph(spark, [4.0, 6.8, 8.0], soil.suitability_score(v, *inverted).alias("q"))
    assert [r["q"] for r in rows] == [0.0, 100.0, 0.0]


def test_missing_parameters(spark):
    values = list(SCENARIOS["fertile_optimal"])
    absent = payload_frame(spark, [("none", "maize_corn", *[None] * 10), ("one", "maize_corn", None, *values[1:])])
    got = {r["scenario"]: r for r in scoring.evaluate(absent, dims.crop_profiles(spark), ["scenario"]).collect()}
    assert got["none"]["field_health_score"] == 0.0 and got["none"]["missing_count"] == 10 and got["none"]["health_band"] == "CRITICAL"
    assert got["one"]["missing_parameters"] == ["Soil pH"] and got["one"]["field_health_score"] < 97.3
    without_column = absent.drop("soil_ph")
    got = scoring.evaluate(without_column, dims.crop_profiles(spark), ["scenario"]).where("scenario = 'one'").first()
    assert "Soil pH" in got["missing_parameters"]


def test_unknown_crop(spark):
    rows = payload_frame(spark, [("x", "quinoa", *SCENARIOS["acid_soil"])])
    with pytest.raises(PySparkException, match="quinoa"):
        scoring.evaluate(rows, dims.crop_profiles(spark), ["scenario"]).collect()
    assert scoring.evaluate(rows, dims.crop_profiles(spark), ["scenario"], strict=False).count() == 0


def test_suitability_skips_missing(spark):
    schema = ("target_crop string, nitrogen_mg_kg double, phosphorus_mg_kg double, potassium_mg_kg double, "
              "moisture_pct double, temperature_c double, humidity_pct double")
    rows = spark.createDataFrame([
        ("Maize", 30.0, 20.0, 200.0, 50.0, 25.0, 60.0), ("Quinoa", 15.0, None, None, None, None, None), (None, None, None, None, None, None, None),
    ], schema)
    got = scoring.suitability(rows, dims.crop_profiles(spark)).orderBy(F.col("suitability_score").desc()).collect()
    assert (got[0]["suitability_score"], got[0]["suitability_label"]) == (100.0, "Good")
    assert (got[1]["suitability_score"], got[1]["suitability_label"], got[1]["crop_key"]) == (50.0, "Fair", "maize_corn")
    assert (got[2]["suitability_score"], got[2]["suitability_label"]) == (0.0, "Poor")


@pytest.mark.parametrize("text, number", [
    ("5.2", 5.2), (" 5.2 ", 5.2), ("+1e2", 100.0), (".5", 0.5), ("5.", 5.0), ("5d", None), ("1_000", None), ("NaN", None),
    ("inf", None), ("ERROR", None), ("", None), ("1e999", None),
])
def test_number_text(spark, text, number):
    assert spark.range(1).select(to_number(F.lit(text)).alias("n")).first()["n"] == number


def test_rounding_follows_the_binary_value(spark):
    for value, digits in [(2.675, 2), (6.25, 1), (6.35, 1), (29.85, 1), (0.125, 2), (-0.5, 0), (1234567.891, 1)]:
        row = spark.range(1).select(rounded(F.lit(value), digits).alias("r"), fixed(F.lit(value), digits).alias("f")).first()
        assert row["r"] == round(value, digits)
        assert row["f"] == f"{value:.{digits}f}"


def test_crop_names(spark):
    names = ["Maize", " corn ", "MAIZE/CORN", "maize corn", "maize-corn", "", None, "Cassava"]
    rows = cleanse.normalise_crop(spark.createDataFrame([(n,) for n in names], "target_crop string")).collect()
    assert [r["crop_recognised"] for r in rows] == [True] * 7 + [False]
    assert {r["crop_key"] for r in rows} == {"maize_corn"}
