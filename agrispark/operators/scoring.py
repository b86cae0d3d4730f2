"""Threshold evaluation, field health and suitability.

A reading and its crop profile meet in one broadcast join. Composite scores zip the reading's values with the
profile's parameters inside the row, flags unpivot into generated code; neither needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.functions import soil
from agrispark.functions.numeric import fixed, let, rounded
from agrispark.operators.cleanse import normalise_crop
from agrispark.rules import crop_profile as cp

PAYLOADS_PER_PART = 100_000  # payloads whose report lines one task collects, about


def _bounds(p: Column) -> list[Column]:
    return [p["optimal_min"], p["optimal_max"], p["critical_min"], p["critical_max"]]


def _aligned(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles with their parameters in the order of the given keys, NULL where a profile lacks one.

    Runs on the profile table, one row per crop, so that each reading only zips two arrays.
    """
    slot = lambda k: F.try_element_at(F.filter("params", lambda p: p["param_key"] == k), F.lit(1))
    others = F.filter("params", lambda p: ~p["param_key"].isin(keys))
    return profiles.withColumn("params", F.concat(F.array(*[slot(k) for k in keys]), others))


def _joined(payloads: DataFrame, profiles: DataFrame, crop: str, strict: bool) -> tuple[DataFrame, Column]:
    """Payloads with their profile, and the parameter array; a strict join fails on a crop without a profile."""
    renamed = F.broadcast(profiles.withColumnRenamed("crop_key", "_profile"))
    joined = payloads.join(renamed, F.col(crop) == F.col("_profile"), "left" if strict else "inner")
    if not strict:
        return joined, F.col("params")
    unknown = F.raise_error(F.concat(F.lit("no threshold profile for crop "), F.coalesce(F.col(crop), F.lit("NULL"))))
    return joined, F.when(F.col("_profile").isNull(), unknown).otherwise(F.col("params"))


def evaluate(payloads: DataFrame, profiles: DataFrame, keys: list[str], columns: dict[str, str] | None = None,
             crop: str = "crop_key", strict: bool = True) -> DataFrame:
    """One row per payload with its flags and field-health score.

    ``flags`` holds name, value, status and score per profile parameter. A missing parameter adds its weight with
    score 0. ``strict`` fails the job on a crop without a profile.
    """
    columns = columns or {k: k for k in cp.PARAM_KEYS if k in payloads.columns}
    slim = _aligned(profiles, list(columns)).select(
        "crop_key", "bands",
        F.transform("params", lambda p: F.struct(
            p["ord"].alias("ord"), p["display_name"].alias("display_name"), F.coalesce(p["weight"], F.lit(0.0)).alias("weight"),
            *[b.alias(n) for n, b in zip(("optimal_min", "optimal_max", "critical_min", "critical_max"), _bounds(p))],
        )).alias("params"),
    )
    joined, params = _joined(payloads, slim, crop, strict)
    values = F.array(*[F.col(c) for c in columns.values()])

    def flag(p: Column, v: Column) -> Column:
        return F.struct(
            p["ord"].alias("ord"), p["display_name"].alias("display_name"), v.alias("value"),
            soil.status(v, *_bounds(p)).alias("status"), soil.health_score(v, *_bounds(p)).alias("score"), p["weight"].alias("weight"),
        )

    flags = F.filter(F.zip_with(params, values, flag), lambda f: f["ord"].isNotNull())
    flagged = joined.select(*keys, F.col(crop).alias("crop_key"), "bands", F.sort_array(flags).alias("flags"))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"))
    sums = F.aggregate("flags", zero, lambda acc, f: F.struct(
        (acc["score"] + F.coalesce(f["score"], F.lit(0.0)) * f["weight"]).alias("score"), (acc["weight"] + f["weight"]).alias("weight"),
    ), lambda acc: acc["score"] / F.nullif(acc["weight"], F.lit(0.0)))
    named = lambda s: F.transform(F.filter("flags", lambda f: f["status"] == s), lambda f: f["display_name"])
    fitting = let(F.col("field_health_score"), lambda score: F.filter("bands", lambda b: (score >= b["min"]) & (score <= b["max"])))
    lowest = F.filter("bands", lambda b: b["band"] == "CRITICAL")
    return (
        flagged.select(
            "*", F.coalesce(rounded(sums, 1), F.lit(0.0)).alias("field_health_score"),
            *[named(s).alias(f"{s.lower()}_parameters") for s in ("OK", "WARNING", "CRITICAL", "MISSING")],
        )
        .withColumn("_band", F.coalesce(F.try_element_at(fitting, F.lit(1)), F.try_element_at(lowest, F.lit(1))))
        .select(
            *keys, "crop_key", "flags", "field_health_score", "ok_parameters", "warning_parameters", "critical_parameters", "missing_parameters",
            F.coalesce(F.col("_band")["band"], F.lit("CRITICAL")).alias("health_band"),
            F.coalesce(F.col("_band")["label"], F.lit("")).alias("health_band_label"),
            F.coalesce(F.col("_band")["color"], F.lit("#95a5a6")).alias("health_color"),
            *[F.size(f"{s}_parameters").cast("long").alias(f"{s}_count") for s in ("warning", "critical", "missing")],
            (F.size("warning_parameters") + F.size("critical_parameters") > 0).alias("requires_intervention"),
        )
    )


_CLASSES = [("OK", "NONE"), ("WARNING", "LOW"), ("WARNING", "HIGH"), ("CRITICAL", "LOW"), ("CRITICAL", "HIGH")]


def flag_texts(profiles: DataFrame) -> DataFrame:
    """Label, hint and the fixed pieces of the summary sentence per (crop, parameter, class): five rows a parameter."""
    classes = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(d).alias("direction")) for s, d in _CLASSES])
    rows = profiles.select("crop_key", F.inline("params")).withColumn("_class", F.explode(classes)).select("*", "_class.*")
    side = F.col("direction")
    pick = lambda low, high, ok: F.when(side == "LOW", F.col(low)).when(side == "HIGH", F.col(high)).otherwise(F.col(ok))
    label = pick("low_label", "high_label", "nominal_label")
    span = F.concat(F.col("optimal_min").cast("string"), F.lit("–"), F.col("optimal_max").cast("string"), F.lit(" "), F.col("unit"))
    ok = F.col("status") == "OK"
    return rows.select(
        "crop_key", "param_key", "status", "direction", label.alias("direction_label"),
        pick("low_hint", "high_hint", "nominal_hint").alias("intervention_hint"),
        F.concat(F.lit("["), "status", F.lit("] "), "display_name", F.when(ok, ": ").otherwise(": Observed ")).alias("_before_value"),
        F.when(ok, F.concat(F.lit(" "), "unit", F.lit(" (within optimal range "), span, F.lit(").")))
        .otherwise(F.concat(F.lit(" "), "unit", F.lit(" (optimal: "), span, F.lit("). Deviation: "))).alias("_after_value"),
        F.concat(F.lit(" "), "unit", F.lit(" "), F.lower("direction"), F.when(label != "", F.concat(F.lit(" — "), label)).otherwise(""), F.lit(" (")).alias("_after_deviation"),
    )


def param_flags(payloads: DataFrame, profiles: DataFrame, keys: list[str], columns: dict[str, str] | None = None,
                crop: str = "crop_key") -> DataFrame:
    """Long form: one row per (payload, parameter), missing parameters included.

    The values exploded, a broadcast join with the parameter limits to class the value, and one with the texts of that
    class: all in generated code, small enough to be compiled, and rows stay in the partition of their payload, which
    an unpivot would not tell Spark. A crop without a profile fails the job, as in ``evaluate``.
    """
    columns = columns or {k: k for k in cp.PARAM_KEYS if k in payloads.columns}
    named, profile = _joined(payloads, profiles.select("crop_key", "params"), crop, strict=True)
    known_crop = F.when(F.size(profile) >= 0, F.col(crop))  # raises for an unknown crop
    values = F.posexplode(F.array(*[F.col(c) for c in columns.values()])).alias("_pos", "value")
    names = F.array(*[F.lit(k) for k in columns])
    limits = F.broadcast(profiles.select("crop_key", F.inline("params")).select(
        "crop_key", "param_key", "ord", "display_name", "unit", "optimal_min", "optimal_max", "critical_min", "critical_max"
    ))
    exploded = named.select(*keys, known_crop.alias("crop_key"), values)
    long = exploded.withColumn("param_key", F.get(names, F.col("_pos"))).drop("_pos").join(limits, ["crop_key", "param_key"])
    v = F.col("value")
    bounds = [F.col(c) for c in ("optimal_min", "optimal_max", "critical_min", "critical_max")]
    known = lambda c: F.when(v.isNotNull(), c)
    classed = long.select(
        *keys, "crop_key", "param_key", "ord", "display_name", "unit", "value", soil.status(v, *bounds).alias("status"),
        known(soil.direction(v, *bounds)).alias("direction"), known(soil.deviation(v, *bounds[:2])).alias("_dev"),
        known(soil.relative_deviation(v, *bounds[:2])).alias("_rel"), soil.health_score(v, *bounds).alias("_score"),
    )
    described = classed.join(F.broadcast(flag_texts(profiles)), ["crop_key", "param_key", "status", "direction"], "left")
    outside = F.concat(fixed(F.col("_dev"), 3), "_after_deviation", fixed(F.col("_rel"), 1), F.lit("% outside optimal range)."))
    return described.select(
        *keys, "crop_key", "ord", "param_key", "display_name", "unit", "value", "status", "direction",
        rounded(F.col("_dev"), 3).alias("absolute_deviation"), rounded(F.col("_rel"), 1).alias("relative_deviation"), "direction_label",
        F.concat("_before_value", v.cast("string"), "_after_value", F.when(F.col("status") == "OK", "").otherwise(outside)).alias("alert_summary"),
        "intervention_hint", rounded(F.col("_score"), 1).alias("parameter_score"),
    )


def flagged_only(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("status").isin("WARNING", "CRITICAL"))


def placed_by_payload(payloads: DataFrame, keys: list[str], crop: str = "crop_key") -> DataFrame:
    """Payloads dealt by their keys before anything is made of them: ``report_block`` then moves no text.

    A payload is some hundred bytes, its lines are thousands, so the number of payloads decides on the partitions.
    """
    columns = [k for k in cp.PARAM_KEYS if k in payloads.columns]
    parts = max(-(-payloads.count() // PAYLOADS_PER_PART), payloads.sparkSession.sparkContext.defaultParallelism)
    return payloads.select(*keys, crop, *columns).repartition(parts, *keys)


def report_block(evaluated: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """The evaluation as one text block per payload, from the score rows and the long flags of the same payloads."""
    line = (
        F.when(F.col("status").isin("CRITICAL", "WARNING"), F.concat(
            F.lit("  • "), "alert_summary", F.lit("\n    Hint: "), "intervention_hint"))
        .when(F.col("status") == "OK", F.concat(
            F.lit("  ✓ "), "display_name", F.lit(": "), F.col("value").cast("string"), F.lit(" "), "unit"))
        .otherwise(F.concat(F.lit("  ? "), "display_name", F.lit(": No reading received")))
    )
    titles = {
        "CRITICAL": "--- CRITICAL FLAGS (Immediate action required) ---",
        "WARNING": "--- WARNING FLAGS (Action recommended) ---",
        "OK": "--- NOMINAL PARAMETERS ---",
        "MISSING": "--- MISSING SENSOR DATA ---",
    }
    # A payload has one flag per parameter, so the collected groups are that small.
    lines = flags.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "status", line.alias("line")))).alias("_lines"))

    def section(status: str, title: str) -> Column:
        body = F.transform(F.filter("_lines", lambda x: x["status"] == status), lambda x: x["line"])
        return F.when(F.size(body) > 0, F.concat(F.array(F.lit(title)), body, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    head = F.array(
        F.lit("=== FIELD EVALUATION REPORT ==="),
        F.concat(F.lit("Crop Profile  : "), "crop_key"),
        F.concat(F.lit("Field Health  : "), F.col("field_health_score").cast("string"), F.lit("/100 ("), "health_band", F.lit(")")),
        F.concat(F.lit("Status        : "),
                 F.when(F.col("requires_intervention"), "INTERVENTION REQUIRED").otherwise("ALL PARAMETERS NOMINAL")),
        F.lit(""),
    )
    report = F.concat(head, *[section(s, t) for s, t in titles.items()], F.array(F.lit("=== END EVALUATION REPORT ===")))
    return evaluated.drop("flags").join(lines, keys).select(*keys, F.array_join(report, "\n").alias("report"))


def suitability(readings: DataFrame, profiles: DataFrame, columns: dict[str, str] | None = None,
                crop_names: list[str] | None = None) -> DataFrame:
    """Suitability of each reading for its crop: missing parameters are skipped, unknown crops use the default.

    The known crops are those of the profile table, one small row each, unless ``crop_names`` lists them.

    Adds crop_key, parameter_scores, suitability_score and suitability_label.
    """
    columns = columns or {param: column for column, param in cp.SENSOR_PARAMETERS.items()}
    slim = _aligned(profiles, list(columns)).select("crop_key", F.transform(
        F.slice("params", 1, len(columns)), lambda p: F.struct(
            p["ord"].alias("ord"), p["param_key"].alias("param_key"), F.coalesce(p["weight"], F.lit(1.0)).alias("weight"),
            *[b.alias(n) for n, b in zip(("optimal_min", "optimal_max", "critical_min", "critical_max"), _bounds(p))],
        )).alias("params"))
    values = F.array(*[F.col(c) for c in columns.values()])
    crop_names = crop_names or [r["crop_key"] for r in profiles.select("crop_key").distinct().orderBy("crop_key").collect()]
    joined = normalise_crop(readings, crop_names).join(F.broadcast(slim), "crop_key", "left")
    scored = F.filter(
        F.zip_with("params", values, lambda p, v: F.struct(
            p["ord"].alias("ord"), p["param_key"].alias("param_key"), soil.suitability_score(v, *_bounds(p)).alias("score"), p["weight"].alias("weight"),
        )),
        lambda s: s["score"].isNotNull(),
    )
    parts = F.sort_array(F.coalesce(scored, F.array().cast("array<struct<ord:int,param_key:string,score:double,weight:double>>")))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"))
    composite = F.aggregate("_parts", zero, lambda acc, s: F.struct(
        (acc["score"] + s["score"] * s["weight"]).alias("score"), (acc["weight"] + s["weight"]).alias("weight"),
    ), lambda acc: F.coalesce(acc["score"] / F.nullif(acc["weight"], F.lit(0.0)), F.lit(0.0)))
    return joined.withColumn("_parts", parts).withColumn("_composite", composite).withColumns({
        "parameter_scores": F.map_from_entries(F.transform("_parts", lambda s: F.struct(s["param_key"], rounded(s["score"], 2)))),
        "suitability_score": rounded(F.col("_composite"), 2),
        "suitability_label": soil.suitability_band(F.col("_composite")),
    }).drop("_parts", "_composite", "params", "crop_recognised")


def class_distribution(scored: DataFrame, label: str = "suitability_label") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
