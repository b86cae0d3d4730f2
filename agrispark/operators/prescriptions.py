"""Corrective actions, dosages and ranked plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark.functions.numeric import fixed
from agrispark.rules import actions as ra
from agrispark.sources import dims


def _clamp(value: Column, rule: dict[str, float]) -> Column:
    return F.greatest(F.lit(rule["least"]), F.least(F.lit(rule["most"]), value * rule["per_unit"]))


def dosage(rule: Column, parameter: Column, value: Column, optimal_low: Column, optimal_high: Column) -> Column:
    """Dosage text; rules compute it, any other text is the dosage itself."""
    lime = _clamp(optimal_low - value, ra.LIME)
    sulfur = _clamp(value - optimal_high, ra.SULFUR)
    pure = (optimal_low - value) * ra.KG_PER_PPM
    share, product = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (fraction, text) in ra.FERTILIZERS.items():
        share = F.when(parameter == name, fraction).otherwise(share)
        product = F.when(parameter == name, text).otherwise(product)
    return (
        F.when(rule == "lime", F.concat(fixed(lime, 1), F.lit("–"), fixed(lime + ra.LIME["span"], 1), F.lit(" tons/ha")))
        .when(rule == "sulfur", F.concat(fixed(sulfur, 0), F.lit("–"), fixed(sulfur + ra.SULFUR["span"], 0), F.lit(" kg/ha")))
        .when(rule == "fertilizer", F.concat(fixed(pure / share, 0), F.lit(" kg/ha of "), product))
        .otherwise(rule)
    )


def _mentions(action: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(action), F.lit(word))
    return hit


def ranking_points(severity: Column, action: Column, ph_critical: Column) -> Column:
    base = F.lit(999)
    for name, points in ra.SEVERITY_POINTS.items():
        base = F.when(severity == name, points).otherwise(base)
    return (
        base
        + F.when(_mentions(action, ra.PH_WORDS), F.when(ph_critical, ra.PH_POINTS_CRITICAL).otherwise(ra.PH_POINTS)).otherwise(0)
        + F.when(_mentions(action, ra.STRUCTURE_WORDS), ra.STRUCTURE_POINTS).otherwise(0)
        + F.when(_mentions(action, ra.WATER_WORDS), ra.WATER_POINTS).otherwise(0)
        + F.when(_mentions(action, ra.FERTILIZER_WORDS), ra.FERTILIZER_POINTS).otherwise(0)
    )


def candidate_actions(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Every registered action of every issue; nutrient excess has none."""
    registry = F.broadcast(dims.corrective_actions(issues.sparkSession))
    return issues.join(registry, ["parameter", "side"]).select(
        *keys, "parameter", "param_ord", "severity", "severity_rank", "action_ord", "action", "impact",
        dosage(F.col("dosage_rule"), F.col("parameter"), F.col("measured_value"), F.col("optimal_low"), F.col("optimal_high")).alias("dosage"),
        "timeline", "depends_on", "reasoning",
    )


def ranked_issues(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Every issue with the first registered action for its parameter, ranked 1..n among the actions of its payload.

    Only the first registered action of a parameter can be first for its target, and a payload has one issue per
    parameter, so keeping order 1 is the whole de-duplication. A payload has at most eight issues: every window
    group is that small, and the summary below groups by the same keys without another shuffle.
    """
    registry = dims.corrective_actions(issues.sparkSession).where("action_ord = 1")
    joined = issues.join(F.broadcast(registry), ["parameter", "side"], "left")
    per_payload = W.partitionBy(*keys)
    ph_critical = F.max((F.col("parameter") == "pH") & (F.col("severity") == "Critical")).over(per_payload)
    points = ranking_points(F.col("severity"), F.col("action"), F.col("_ph_critical"))
    order = per_payload.orderBy(F.col("action").isNull(), "points", "severity_rank", "param_ord")
    priority = F.when(F.col("action").isNotNull(), F.row_number().over(order).cast("long"))
    return (
        joined.withColumn("_ph_critical", ph_critical).withColumn("points", points).withColumn("priority", priority)
        .drop("_ph_critical", "action_ord")
    )


def action_plan(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked actions; an issue without a registered action has no row."""
    return ranked.where(F.col("priority").isNotNull()).select(
        *keys, "priority", "parameter", "severity", "action", "impact",
        dosage(F.col("dosage_rule"), F.col("parameter"), F.col("measured_value"), F.col("optimal_low"), F.col("optimal_high")).alias("dosage"),
        "timeline", "depends_on", "reasoning", "points",
    )


def plan_summary(ranked: DataFrame, keys: list[str], healthy: DataFrame | None = None) -> DataFrame:
    """One row per payload: timeline, first steps, parameters to monitor.

    ``healthy`` holds the keys of payloads without issues, which have no row in ``ranked``; their plan is to go on
    monitoring.
    """
    step = F.when(F.col("priority") <= ra.FIRST_STEPS, F.struct("priority", "action"))
    per_payload = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("issues_count"), F.min("severity_rank").alias("_worst"),
        F.collect_set("parameter").alias("_parameters"), F.sort_array(F.collect_list(step)).alias("_steps"),
    )
    worst = F.element_at(F.array(*[F.lit(s) for s in ra.SEVERITY_POINTS]), F.col("_worst"))
    timeline = F.lit(ra.TIMELINES["Low"])
    for name, text in ra.TIMELINES.items():
        timeline = F.when(F.col("overall_severity") == name, text).otherwise(timeline)
    always = F.array(*[F.lit(p) for p in ra.ALWAYS_MONITORED])
    summary = per_payload.withColumn("overall_severity", worst).select(
        *keys, "issues_count", "overall_severity", timeline.alias("expected_timeline"),
        F.transform("_steps", lambda s: s["action"]).alias("critical_first_steps"),
        F.array_sort(F.array_union("_parameters", always)).alias("monitoring_parameters"),
    )
    if healthy is None:
        return summary
    return summary.unionByName(healthy.select(
        *keys, F.lit(0).cast("long").alias("issues_count"), F.lit("Low").alias("overall_severity"),
        F.lit(ra.TIMELINES["Low"]).alias("expected_timeline"), F.array().cast("array<string>").alias("critical_first_steps"),
        F.array_sort(always).alias("monitoring_parameters"),
    ))


__all__ = ["action_plan", "candidate_actions", "dosage", "plan_summary", "ranked_issues", "ranking_points"]
