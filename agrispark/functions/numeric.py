"""Numeric coercion and number formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal with optional sign and exponent; rejects "5d", "1_000", "NaN" and "inf".
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, so they count as missing everywhere."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def to_number(text: Column) -> Column:
    """Text to double; NULL for anything that is not a plain decimal number."""
    clean = F.trim(text)
    return finite(F.when(clean.rlike(NUMBER_TEXT), clean.try_cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimizer inlines a projected column into a lambda that mentions it once, and the lambda then evaluates it
    for every element; a lambda argument is evaluated before the body.
    """
    return F.transform(F.array(value), body)[0]


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def one_decimal(value: Column) -> Column:
    """At most one decimal, without a trailing ".0": the exact binary value decides, exact ties go away from zero, and
    nothing is ever a negative zero."""
    quarters = value * 4
    tie = (quarters == F.floor(quarters)) & (F.abs(quarters) % 2 == 1)
    away = value + F.when(value < 0, F.lit(-0.05)).otherwise(F.lit(0.05))
    text = F.regexp_replace(fixed(F.when(tie, away).otherwise(value), 1), r"\.0$", "")
    return F.when(text == "-0", "0").otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals; an exact tie goes to the even digit."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))


def rounded(value: Column, digits: int) -> Column:
    """Correctly rounded double: the exact binary value decides, exact ties go to the even digit.

    ``round`` and ``bround`` decide on the shortest decimal text instead, which differs for values such as 29.85.
    """
    return fixed(value, digits).cast("double")


def min_max_scale(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); a constant feature scales to 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def min_max_unscale(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low
