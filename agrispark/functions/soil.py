"""Range rules and scores of a single measurement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agrispark.rules import crop_profile as cp


def status(v: Column, opt_lo: Column, opt_hi: Column, crit_lo: Column, crit_hi: Column) -> Column:
    return (
        F.when(v.isNull(), "MISSING")
        .when((v <= crit_lo) | (v >= crit_hi), "CRITICAL")
        .when((v < opt_lo) | (v > opt_hi), "WARNING")
        .otherwise("OK")
    )


def direction(v: Column, opt_lo: Column, opt_hi: Column, crit_lo: Column, crit_hi: Column) -> Column:
    """A critical low wins over a critical high, which wins over the optimal bounds."""
    return (
        F.when(v <= crit_lo, "LOW")
        .when(v >= crit_hi, "HIGH")
        .when(v < opt_lo, "LOW")
        .when(v > opt_hi, "HIGH")
        .otherwise("NONE")
    )


def deviation(v: Column, opt_lo: Column, opt_hi: Column) -> Column:
    """Distance to the nearest optimal bound, 0 inside or for an empty range."""
    return F.when(opt_hi <= opt_lo, F.lit(0.0)).otherwise(F.greatest(opt_lo - v, v - opt_hi, F.lit(0.0)))


def relative_deviation(v: Column, opt_lo: Column, opt_hi: Column) -> Column:
    width = opt_hi - opt_lo
    return F.when(width <= 0, F.lit(0.0)).otherwise(
        deviation(v, opt_lo, opt_hi) / F.nullif(width, F.lit(0.0)) * 100.0
    )


def health_score(v: Column, opt_lo: Column, opt_hi: Column, crit_lo: Column, crit_hi: Column) -> Column:
    """100 at the optimal midpoint, 70 at its bounds, 30 at the critical bounds, 0 one shoulder further."""
    half = (opt_hi - opt_lo) / 2.0
    off_centre = F.abs(v - (opt_lo + opt_hi) / 2.0)
    inside = F.when(half == 0, F.lit(100.0)).otherwise(
        F.greatest(F.lit(70.0), 100.0 - off_centre / F.nullif(half, F.lit(0.0)) * 30.0)
    )
    shoulder = F.when(v < opt_lo, F.abs(opt_lo - crit_lo)).otherwise(F.abs(opt_hi - crit_hi))
    outside = F.when(v < opt_lo, opt_lo - v).otherwise(v - opt_hi)
    steps = outside / F.nullif(shoulder, F.lit(0.0))
    beyond = F.when(steps <= 1.0, F.greatest(F.lit(30.0), 70.0 - steps * 40.0)).otherwise(
        F.greatest(F.lit(0.0), 60.0 - steps * 30.0)
    )
    return (
        F.when(v.isNull(), None)
        .when((v >= opt_lo) & (v <= opt_hi), inside)
        .when(shoulder == 0, F.lit(30.0))
        .otherwise(beyond)
    )


def suitability_score(v: Column, opt_lo: Column, opt_hi: Column, crit_lo: Column, crit_hi: Column) -> Column:
    """100 inside the optimal range, linear to 0 at the critical bound; an inverted shoulder scores 100."""
    below = F.when(v <= crit_lo, 0.0).when(opt_lo <= crit_lo, 100.0).otherwise(
        (v - crit_lo) / F.nullif(opt_lo - crit_lo, F.lit(0.0)) * 100.0
    )
    above = F.when(v >= crit_hi, 0.0).when(crit_hi <= opt_hi, 100.0).otherwise(
        (crit_hi - v) / F.nullif(crit_hi - opt_hi, F.lit(0.0)) * 100.0
    )
    return (
        F.when(v.isNull(), None)
        .when((v >= opt_lo) & (v <= opt_hi), F.lit(100.0))
        .when(v < opt_lo, below)
        .otherwise(above)
    )


def suitability_band(score: Column) -> Column:
    return F.when(score >= cp.GOOD_MIN, "Good").when(score >= cp.FAIR_MIN, "Fair").otherwise("Poor")


def label_index(label: Column) -> Column:
    """Poor 0, Fair 1, Good 2."""
    labels = F.array(*[F.lit(x) for x in cp.SUITABILITY_LABELS])
    return (F.array_position(labels, label) - 1).cast("int")
