"""Severity classes, diagnosed issues and parameter interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.functions.numeric import fixed
from agrispark.operators.cleanse import to_long
from agrispark.rules import severity as rs
from agrispark.sources import dims

PAYLOAD_COLUMNS = [row[1] for row in rs.DIAGNOSIS_PARAMETERS]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in rs.SEVERITIES]), severity).cast("int")


def severities(payloads: DataFrame, keys: list[str], variants: dict[str, str] | None = None) -> DataFrame:
    """One row per (payload, parameter) that has a value, with its severity: the number of cuts passed picks it."""
    rules = F.broadcast(dims.diagnosis_rules(payloads.sparkSession, variants))
    cuts = [f"cut_{k + 1}" for k in range(dims.CUTS)]
    passed = sum(((F.col("value") > F.col(c)).cast("int") for c in cuts), F.lit(0))
    return (
        to_long(payloads, keys, PAYLOAD_COLUMNS).where(F.col("value").isNotNull()).join(rules, "column")
        .withColumn("severity", F.get("severities", passed)).drop("severities", *cuts)
    )


def soil_issues(payloads: DataFrame, keys: list[str], variants: dict[str, str] | None = None) -> DataFrame:
    """Diagnosed issues; values in the optimal class raise none. A value on the optimal lower edge is named as excess."""
    v = F.col("value")
    side = F.when(v < F.col("opt_low"), "low").otherwise("high")
    strong = (v <= F.col("low_edge")) | (v >= F.col("high_edge"))
    grade = F.when(F.col("graded"), F.col("severity")).when(strong, "strong").otherwise("plain")
    texts = F.broadcast(dims.issue_texts(payloads.sparkSession))
    number = F.when(F.col("decimals") == 2, fixed(v, 2)).otherwise(fixed(v, 1))
    return (
        severities(payloads, keys, variants).where(F.col("severity") != "Low")
        .withColumn("side", side).withColumn("grade", grade)
        .join(texts, ["parameter", "side", "grade"])
        .select(
            *keys, "parameter", "param_ord", "issue", F.col("value").alias("measured_value"),
            F.col("opt_low").alias("optimal_low"), F.col("opt_high").alias("optimal_high"), "severity",
            severity_rank(F.col("severity")).alias("severity_rank"), "side",
            F.concat("text_before", number, "text_after").alias("description"), "root_cause",
        )
    )


def overall_severity(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Worst severity per payload, Low when nothing is wrong.

    Each parameter's severity is looked up inside the row, so no shuffle is needed.
    """
    worst = F.array_min(F.array(*[severity_rank(_literal_severity(name, F.col(column))) for name, column, _, _ in rs.DIAGNOSIS_PARAMETERS]))
    return payloads.select(
        *keys, F.element_at(F.array(*[F.lit(s) for s in rs.SEVERITIES]), F.coalesce(worst, F.lit(len(rs.SEVERITIES)))).alias("overall_severity")
    )


def _literal_severity(parameter: str, value: Column) -> Column:
    key = (parameter, "default")
    if key in rs.SALINITY_CUTS:
        cuts, names = rs.SALINITY_CUTS[key], rs.SALINITY_SEVERITIES
    elif key in rs.ORGANIC_CUTS:
        cuts, names = rs.ORGANIC_CUTS[key], rs.ORGANIC_SEVERITIES
    else:
        cuts, names = rs.TWO_SIDED_CUTS[key], rs.TWO_SIDED
    out = F.when(value.isNull(), None)
    for bound, name in zip(cuts, names):
        out = out.when(value < bound if key in rs.ORGANIC_CUTS else value <= bound, name)
    return out.otherwise(names[-1])


def interactions(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """One row per interaction that holds in a payload."""
    lim = rs.INTERACTION_LIMITS
    dry = F.col("soil_moisture") < lim["moisture_below"]
    conditions = {
        "ph_nitrogen": (F.col("soil_ph") < lim["ph_below"]) & (F.col("nitrogen_ppm") > lim["nitrogen_above"]),
        "drought_heat": dry & (F.col("soil_temperature") > lim["temperature_above"]),
        "drought_salt": dry,
    }
    found = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("interaction"), F.lit(rs.INTERACTION_TEXTS[name]).alias("text")))
        for i, (name, hit) in enumerate(conditions.items())
    ]))
    return payloads.select(*keys, F.inline(found))
