"""Registered queries over payloads: evaluation, suitability, diagnosis and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.operators import cleanse, diagnosis, prescriptions, scoring
from agrispark.plans import flows
from agrispark.rules import severity as rs
from agrispark.session import staging_path
from agrispark.sources import dims, profiles
from agrispark.sources.telemetry import payloads_from_events, readings_from_events

KEYS = ["event_id"]


def _payloads(spark, sf):
    return payloads_from_events(spark, sf)


def _with_crop(spark, sf):
    return cleanse.normalise_crop(_payloads(spark, sf))


def _evaluated(spark, sf):
    return scoring.evaluate(_with_crop(spark, sf), dims.crop_profiles(spark), KEYS)


def _flags(spark, sf):
    return scoring.param_flags(_with_crop(spark, sf), dims.crop_profiles(spark), KEYS)


def param_flags(spark, sf):
    return _flags(spark, sf).drop("intervention_hint", "ord")


def flagged_params(spark, sf):
    return scoring.flagged_only(_flags(spark, sf)).select("event_id", "param_key", "status", "direction", "intervention_hint")


def missing_params(spark, sf):
    return _flags(spark, sf).where("status = 'MISSING'").select("event_id", "param_key", "display_name")


def field_health(spark, sf):
    lists = ["ok_parameters", "warning_parameters", "critical_parameters", "missing_parameters"]
    return _evaluated(spark, sf).select(
        "event_id", "field_health_score", "health_band", "health_band_label", "health_color", "requires_intervention",
        "warning_count", "critical_count", "missing_count", *[F.array_join(c, "|").alias(c) for c in lists],
    )


def health_band_distribution(spark, sf):
    return _evaluated(spark, sf).groupBy("health_band").agg(
        F.count(F.lit(1)).alias("n"), F.min("field_health_score").alias("lowest"), F.max("field_health_score").alias("highest")
    )


def field_health_from_file(spark, sf):
    """The same scores with limits, weights and bands read from a profile file."""
    path = staging_path(spark, "profiles")
    profiles.profile_document(spark, dims.crop_profiles(spark)).write.text(path)
    nested = profiles.nest_profiles(*profiles.read_profile_dims(spark, path))
    return scoring.evaluate(_with_crop(spark, sf), nested, KEYS).select("event_id", "field_health_score", "health_band", "health_color")


def evaluation_reports(spark, sf):
    payloads, crops = scoring.placed_by_payload(_with_crop(spark, sf), KEYS), dims.crop_profiles(spark)
    return scoring.report_block(scoring.evaluate(payloads, crops, KEYS), scoring.param_flags(payloads, crops, KEYS), KEYS)


def _suitability(spark, sf):
    return scoring.suitability(readings_from_events(spark, sf, heavy=True), dims.crop_profiles(spark))


def suitability_scores(spark, sf):
    return _suitability(spark, sf).select(
        "event_id", "crop_key", "suitability_score", "suitability_label",
        F.col("parameter_scores")["nitrogen_ppm"].alias("nitrogen_score"), F.col("parameter_scores")["soil_moisture"].alias("moisture_score"),
    )


def suitability_distribution(spark, sf):
    return scoring.class_distribution(_suitability(spark, sf))


def severity_classes(spark, sf):
    return diagnosis.severities(_payloads(spark, sf), KEYS).select("event_id", "parameter", "value", "severity")


def severity_classes_variants(spark, sf):
    variants = {"pH": "acid_loving", "Moisture": "clay", "Temperature": "cool_season", "Salinity (EC)": "tolerant"}
    return diagnosis.severities(_payloads(spark, sf), KEYS, variants).groupBy("parameter", "severity").agg(F.count(F.lit(1)).alias("n"))


def severity_bands(spark, sf):
    """How many payload values fall in each band of each variant table."""
    long = _payloads(spark, sf).unpivot(KEYS, diagnosis.PAYLOAD_COLUMNS, "column", "value").where("value is not null")
    names = F.create_map(*[F.lit(x) for name, column, _, _ in rs.DIAGNOSIS_PARAMETERS for x in (column, name)])
    counted = long.groupBy(names[F.col("column")].alias("parameter"), "value").agg(F.count(F.lit(1)).alias("n"))
    bands = F.broadcast(dims.severity_bands(spark))
    fits = F.col("upper_bound").isNull() | (F.col("value") < F.col("upper_bound")) | (F.col("inclusive") & (F.col("value") == F.col("upper_bound")))
    placed = counted.join(bands, "parameter").where(fits).groupBy("parameter", "variant", "value", "n").agg(F.min_by("severity", "ord").alias("severity"))
    return placed.groupBy("parameter", "variant", "severity").agg(F.sum("n").alias("n"))


def soil_issues(spark, sf):
    return diagnosis.soil_issues(_payloads(spark, sf), KEYS).select(
        "event_id", "parameter", "issue", "measured_value", "optimal_low", "optimal_high", "severity", "side", "description", "root_cause"
    )


def overall_severity(spark, sf):
    return diagnosis.overall_severity(_payloads(spark, sf), KEYS)


def interactions(spark, sf):
    return diagnosis.interactions(_payloads(spark, sf), KEYS).select("event_id", "interaction", "text")


def candidate_actions(spark, sf):
    issues = diagnosis.soil_issues(_payloads(spark, sf), KEYS)
    return prescriptions.candidate_actions(issues, KEYS).select(
        "event_id", "parameter", "severity", "action", "impact", "dosage", "timeline", "depends_on"
    )


def action_plan(spark, sf):
    plan, _ = flows.plans_for(_payloads(spark, sf), KEYS)
    return plan.select("event_id", "priority", "parameter", "severity", "action", "dosage", F.col("points").cast("long").alias("points"))


def plan_summary(spark, sf):
    _, summary = flows.plans_for(_payloads(spark, sf), KEYS)
    return summary.select(
        "event_id", "issues_count", "overall_severity", "expected_timeline",
        F.array_join("critical_first_steps", "|").alias("first_steps"), F.array_join("monitoring_parameters", "|").alias("monitoring"),
    )


QUERIES = {f.__name__: f for f in [
    param_flags, flagged_params, missing_params, field_health, health_band_distribution, field_health_from_file,
    evaluation_reports,
    suitability_scores, suitability_distribution, severity_classes, severity_classes_variants, severity_bands,
    soil_issues, overall_severity, interactions, candidate_actions, action_plan, plan_summary,
]}
