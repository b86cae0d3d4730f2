"""Threshold profile files as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.rules.crop_profile import PARAM_KEYS, SCORE_BANDS


def read_profile_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dim_threshold, dim_weight, dim_band) of a profile file; a file without profiles is an error."""
    raw = spark.read.schema(schemas.CROP_PROFILES).option("multiLine", True).json(path)
    crops = raw.select(F.explode("crop_profiles").alias("crop_key", "profile"))
    if crops.isEmpty():
        raise ValueError(f"{path} contains no crop_profiles")
    thresholds = crops.select(
        "crop_key", F.explode("profile.parameters").alias("param_key", "p")
    ).select("crop_key", "param_key", "p.*")
    weights = crops.select("crop_key", F.explode("profile.composite_health_scoring.weights").alias("param_key", "weight"))
    bands = crops.select(
        "crop_key", F.explode("profile.composite_health_scoring.score_bands").alias("band", "b")
    ).select("crop_key", "band", "b.*")
    return thresholds, weights, bands


def nest_profiles(thresholds: DataFrame, weights: DataFrame, bands: DataFrame) -> DataFrame:
    """One row per crop with parameter and band arrays. Parameters keep the standard order, extras follow by name."""
    standard = F.array(*[F.lit(k) for k in PARAM_KEYS])
    position = F.array_position(standard, F.col("param_key"))
    order = F.when(position > 0, position - 1).otherwise(len(PARAM_KEYS)).cast("int")
    label = lambda column, side: F.coalesce(F.col(column)[side], F.lit(""))
    hint = lambda side: F.coalesce(
        F.col("intervention_hints")[side], F.lit("No specific intervention hint available.")
    )
    params = (
        thresholds.join(weights, ["crop_key", "param_key"], "left")
        .groupBy("crop_key")
        .agg(F.sort_array(F.collect_list(F.struct(
            order.alias("ord"), "param_key", "display_name", "unit",
            "optimal_min", "optimal_max", "critical_min", "critical_max", "weight",
            label("direction_labels", "low").alias("low_label"),
            label("direction_labels", "high").alias("high_label"),
            label("direction_labels", "none").alias("nominal_label"),
            hint("low").alias("low_hint"), hint("high").alias("high_hint"), hint("none").alias("nominal_hint"),
        ))).alias("params"))
    )
    names = F.array(*[F.lit(b[0]) for b in SCORE_BANDS])
    nested_bands = bands.groupBy("crop_key").agg(F.sort_array(F.collect_list(F.struct(
        F.array_position(names, F.col("band")).cast("int").alias("ord"), "band", "min", "max", "label", "color",
    ))).alias("bands"))
    return params.join(nested_bands, "crop_key", "left")


def profile_document(spark: SparkSession, nested: DataFrame) -> DataFrame:
    """Nested profiles as one JSON document in the file shape that ``read_profile_dims`` reads."""
    parameter = lambda p: F.struct(p["param_key"], F.struct(
        p["display_name"].alias("display_name"), p["unit"].alias("unit"),
        *[p[n].alias(n) for n in ("optimal_min", "optimal_max", "critical_min", "critical_max")],
        F.create_map(F.lit("low"), p["low_label"], F.lit("high"), p["high_label"], F.lit("none"), p["nominal_label"]).alias("direction_labels"),
        F.create_map(F.lit("low"), p["low_hint"], F.lit("high"), p["high_hint"], F.lit("none"), p["nominal_hint"]).alias("intervention_hints"),
    ))
    band = lambda b: F.struct(b["band"], F.struct(*[b[n].alias(n) for n in ("min", "max", "label", "color")]))
    crop = F.struct("crop_key", F.struct(
        F.map_from_entries(F.transform("params", parameter)).alias("parameters"),
        F.struct(
            F.map_from_entries(F.transform("params", lambda p: F.struct(p["param_key"], p["weight"]))).alias("weights"),
            F.map_from_entries(F.transform("bands", band)).alias("score_bands"),
        ).alias("composite_health_scoring"),
    ))
    # One row per crop: the table of profiles is small by nature.
    return nested.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(crop)).alias("crop_profiles"))).alias("value"))
