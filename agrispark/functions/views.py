"""Status and tone expressions of the live views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agrispark.functions.numeric import zero_if_missing
from agrispark.rules import limits


def is_online(flag: Column) -> Column:
    """Offline only when the flag says false or 0; a missing flag means online."""
    return ~F.coalesce(F.lower(flag.cast("string")).isin("false", "0"), F.lit(False))


def node_status(online: Column, nitrogen: Column, moisture: Column) -> Column:
    n, m = zero_if_missing(nitrogen), zero_if_missing(moisture)
    (n_lo, n_hi), (m_lo, m_hi) = limits.STATUS_NITROGEN, limits.STATUS_MOISTURE
    return (
        F.when(~online, "OFFLINE")
        .when((n < n_lo) | (m < m_lo), "POOR")
        .when(n.between(n_lo, n_hi) | m.between(m_lo, m_hi), "FAIR")
        .otherwise("GOOD")
    )


def metric_tone(v: Column, good_lo: Column, good_hi: Column, fair_lo: Column, fair_hi: Column) -> Column:
    return F.when(v.between(good_lo, good_hi), "good").when(v.between(fair_lo, fair_hi), "fair").otherwise("poor")


def fill_percent(v: Column, fair_lo: Column, fair_hi: Column) -> Column:
    return F.greatest(F.lit(8.0), F.least(F.lit(100.0), (v - fair_lo) / (fair_hi - fair_lo) * 100.0))


def map_layers(online: Column, nitrogen: Column, moisture: Column) -> list[Column]:
    """One class per map layer: moisture, nitrogen, coverage, health."""
    low_or_good = lambda c, edge: F.when(zero_if_missing(c) < edge, "low").otherwise("good")
    status = node_status(online, nitrogen, moisture)
    return [
        low_or_good(moisture, limits.MAP_LOW_MOISTURE).alias("moisture_layer"),
        low_or_good(nitrogen, limits.MAP_LOW_NITROGEN).alias("nitrogen_layer"),
        F.when(online, "connected").otherwise("disconnected").alias("coverage_layer"),
        F.lower(status).alias("health_layer"),
    ]
