"""Threshold alerts on readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.functions.numeric import one_decimal, to_number
from agrispark.operators.cleanse import to_long
from agrispark.rules import limits
from agrispark.schemas import MEASURES
from agrispark.sources import dims


def effective_limits(defaults: DataFrame, overrides: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Limits after user overrides (metric, min_text, max_text); an override counts only if both ends are finite
    numbers and min < max. One override row per metric and user.

    Extra columns of the overrides identify a user. Every user gets every default, merged with that user's overrides;
    ``users`` names users beyond those who override something. Without extra columns the overrides are everybody's.
    """
    parsed = overrides.withColumns({"_min": to_number(F.col("min_text")), "_max": to_number(F.col("max_text"))})
    valid = F.col("_min").isNotNull() & F.col("_max").isNotNull() & (F.col("_min") < F.col("_max"))
    extra = [c for c in overrides.columns if c not in ("metric", "min_text", "max_text")]
    base = defaults
    if extra:
        every = defaults.agg(F.collect_list(F.struct(*defaults.columns))).scalar()  # the rules' six rows
        known = overrides.select(*extra) if users is None else overrides.select(*extra).unionByName(users.select(*extra))
        base = known.distinct().select(*extra, F.inline(every))
    return base.join(parsed, [*extra, "metric"], "left").withColumns({
        "limit_min": F.when(valid, F.col("_min")).otherwise(F.col("limit_min")),
        "limit_max": F.when(valid, F.col("_max")).otherwise(F.col("limit_max")),
    }).select(*defaults.columns, *extra)


def threshold_alerts(readings: DataFrame, alert_limits: DataFrame | None = None, null_as_zero: bool = False) -> DataFrame:
    """One row per breached limit. Narrow: unpivot, then a broadcast join with the six limits.

    Limits per user have no size bound, so only the default table is broadcast by request.
    """
    table = F.broadcast(dims.alert_limits(readings.sparkSession)) if alert_limits is None else alert_limits
    extra = [c for c in table.columns if c not in _LIMIT_COLUMNS]
    value: Column = F.coalesce("value", F.lit(0.0)) if null_as_zero else F.col("value")
    side = F.when(value < F.col("limit_min"), "low").when(value > F.col("limit_max"), "high")
    breached = (
        to_long(readings, ["node_id", "event_id", "ts"], MEASURES)
        .join(table, "column")
        .withColumns({"value": value, "direction": side})
        .where(F.col("direction").isNotNull())
    )
    low = F.col("direction") == "low"
    threshold = F.when(low, F.col("limit_min")).otherwise(F.col("limit_max"))
    margin = F.greatest(F.abs(threshold) * limits.CRITICAL_MARGIN_SHARE, F.lit(limits.CRITICAL_MARGIN_FLOOR))
    critical = F.when(low, F.col("value") <= threshold - margin).otherwise(F.col("value") >= threshold + margin)
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("latest"))
    with_unit = lambda c: F.concat(one_decimal(c), F.lit(" "), F.col("unit"))
    return breached.select(
        *extra,
        F.concat_ws("-", "node_id", "metric", stamp).alias("alert_id"),
        "node_id", "event_id", "ts", "metric", "metric_ord",
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        "direction", "value", threshold.alias("threshold"),
        F.concat(F.col("label"), F.lit(" is "), F.col("direction"), F.lit(" on "), F.col("node_id")).alias("title"),
        F.concat(with_unit(F.col("value")), F.lit(" is "), F.when(low, "below").otherwise("above"),
                 F.lit(" your "), with_unit(threshold), F.lit(" alert threshold.")).alias("message"),
        F.when(low, F.col("low_advice")).otherwise(F.col("high_advice")).alias("recommendation"),
    )


_LIMIT_COLUMNS = {"metric", "label", "unit", "column", "limit_min", "limit_max", "low_advice", "high_advice", "metric_ord"}


def alert_order() -> list[Column]:
    """Critical first, then newest node first, then metric order: the tie order is explicit."""
    return [
        F.when(F.col("severity") == "critical", 0).otherwise(1).asc(),
        F.col("ts").desc(), F.col("event_id").desc(), F.col("node_id"), F.col("metric_ord"),
    ]


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("metric", "direction", "severity").agg(F.count(F.lit(1)).alias("alerts"))
