"""Small dimension tables built from the rule constants.

Their size is fixed by the rules (at most a few hundred rows), which is what makes broadcasting them safe.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from agrispark.rules import actions, crop_profile as cp, lexicon, limits, severity


def _local(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType] | None = None) -> DataFrame:
    types = types or {}
    return spark.createDataFrame(pa.table({k: pa.array(v, type=types.get(k)) for k, v in columns.items()}))


def _by_column(names: list[str], rows: list[tuple]) -> dict[str, list]:
    return {name: [row[i] for row in rows] for i, name in enumerate(names)}


_PARAMETER_STRUCT = pa.struct([
    ("ord", pa.int32()), ("param_key", pa.string()), ("display_name", pa.string()), ("unit", pa.string()),
    ("optimal_min", pa.float64()), ("optimal_max", pa.float64()),
    ("critical_min", pa.float64()), ("critical_max", pa.float64()), ("weight", pa.float64()),
    ("low_label", pa.string()), ("high_label", pa.string()), ("nominal_label", pa.string()),
    ("low_hint", pa.string()), ("high_hint", pa.string()), ("nominal_hint", pa.string()),
])
_BAND_STRUCT = pa.struct([
    ("ord", pa.int32()), ("band", pa.string()), ("min", pa.float64()), ("max", pa.float64()),
    ("label", pa.string()), ("color", pa.string()),
])


def crop_profiles(spark: SparkSession) -> DataFrame:
    """One row per crop: crop_key, params array, bands array."""
    params = [
        dict(zip(_PARAMETER_STRUCT.names, (
            i, key, name, unit, lo, hi, clo, chi, cp.PARAMETER_WEIGHT, low, high, cp.NOMINAL_LABEL, low_hint, high_hint, ok_hint,
        )))
        for i, (key, name, unit, lo, hi, clo, chi, low, high, low_hint, high_hint, ok_hint) in enumerate(cp.MAIZE_PARAMETERS)
    ]
    bands = [dict(zip(_BAND_STRUCT.names, (i, *row))) for i, row in enumerate(cp.SCORE_BANDS)]
    return _local(
        spark,
        {"crop_key": [cp.DEFAULT_CROP], "params": [params], "bands": [bands]},
        {"params": pa.list_(_PARAMETER_STRUCT), "bands": pa.list_(_BAND_STRUCT)},
    )


def alert_limits(spark: SparkSession) -> DataFrame:
    names = ["metric", "label", "unit", "column", "limit_min", "limit_max", "low_advice", "high_advice"]
    columns = _by_column(names, limits.ALERT_LIMITS)
    columns["metric_ord"] = list(range(len(limits.ALERT_LIMITS)))
    return _local(spark, columns, {"metric_ord": pa.int32()})


def metric_ranges(spark: SparkSession) -> DataFrame:
    return _local(spark, _by_column(["column", "good_lo", "good_hi", "fair_lo", "fair_hi"], limits.METRIC_RANGES))


def severity_bands(spark: SparkSession) -> DataFrame:
    """(parameter, variant, ord, upper_bound, inclusive, severity); the last band has no upper bound."""
    rows = []
    families = [
        (severity.TWO_SIDED_CUTS, severity.TWO_SIDED, True),
        (severity.SALINITY_CUTS, severity.SALINITY_SEVERITIES, True),
        (severity.ORGANIC_CUTS, severity.ORGANIC_SEVERITIES, False),
    ]
    for cuts, names, inclusive in families:
        for (parameter, variant), bounds in cuts.items():
            for i, name in enumerate(names):
                upper = bounds[i] if i < len(bounds) else None
                rows.append((parameter, variant, i, upper, inclusive, name))
    return _local(
        spark, _by_column(["parameter", "variant", "ord", "upper_bound", "inclusive", "severity"], rows),
        {"ord": pa.int32(), "upper_bound": pa.float64()},
    )


CUTS = 7


def diagnosis_rules(spark: SparkSession, variants: dict[str, str] | None = None) -> DataFrame:
    """One row per diagnosed parameter for the chosen variants: seven ascending cuts and the severities between them.

    A value lies past a cut when it is greater. A cut that belongs to the class above it is stored as the next
    smaller double; parameters with fewer cuts are padded with infinity.
    """
    variants = variants or {}
    rows = []
    for i, (parameter, column, lo, hi) in enumerate(severity.DIAGNOSIS_PARAMETERS):
        key = (parameter, variants.get(parameter, "default"))
        if key in severity.SALINITY_CUTS:
            cuts, names = severity.SALINITY_CUTS[key], severity.SALINITY_SEVERITIES
        elif key in severity.ORGANIC_CUTS:
            cuts, names = [math.nextafter(c, -math.inf) for c in severity.ORGANIC_CUTS[key]], severity.ORGANIC_SEVERITIES
        else:
            cuts, names = severity.TWO_SIDED_CUTS[key], severity.TWO_SIDED
        low_edge, high_edge = severity.STRONG_EDGES.get(parameter, (-math.inf, math.inf))
        padded = [*cuts, *[math.inf] * (CUTS - len(cuts))]
        rows.append((parameter, column, i, lo, hi, low_edge, high_edge, parameter in severity.GRADED_BY_SEVERITY, names, *padded))
    columns = ["parameter", "column", "param_ord", "opt_low", "opt_high", "low_edge", "high_edge", "graded", "severities"]
    return _local(spark, _by_column([*columns, *[f"cut_{k + 1}" for k in range(CUTS)]], rows), {"param_ord": pa.int32()})


def issue_texts(spark: SparkSession) -> DataFrame:
    names = ["parameter", "side", "grade", "issue", "text_before", "text_after", "decimals", "root_cause"]
    return _local(spark, _by_column(names, severity.ISSUE_TEXTS), {"decimals": pa.int32()})


def corrective_actions(spark: SparkSession) -> DataFrame:
    names = ["parameter", "side", "action_ord", "action", "impact", "dosage_rule", "timeline", "depends_on", "reasoning"]
    return _local(spark, _by_column(names, actions.ACTIONS), {"action_ord": pa.int32()})


def suitability_labels(spark: SparkSession) -> DataFrame:
    return _local(
        spark, {"label_index": list(range(len(cp.SUITABILITY_LABELS))), "label": cp.SUITABILITY_LABELS},
        {"label_index": pa.int32()},
    )


def intent_modes(spark: SparkSession) -> DataFrame:
    rows = [(intent, mode, *lexicon.MODE_ATTRIBUTES[mode]) for intent, mode in lexicon.INTENT_MODES.items()]
    names = ["intent", "mode", "response_format", "requires_context", "requires_diagnostics", "memory_preference"]
    return _local(spark, _by_column(names, rows))
