"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**27 + 1 splits a double into two halves whose products are exact.
_SPLITTER = 134217729.0


def py_round(value: Column, digits: int) -> Column:
    """Round the exact binary value half-even, as Python's ``round`` does.

    ``round``/``bround`` work on the shortest decimal text and so turn 2.675 into
    2.68; the double is below the tie and has to become 2.67. The scaled value is
    kept together with its exact rounding error, which decides apparent ties.
    """
    if not 0 <= digits <= 8:
        raise ValueError("digits must lie between 0 and 8")
    scale = 10.0**digits
    scaled = value * F.lit(scale)
    high = value * F.lit(_SPLITTER) - (value * F.lit(_SPLITTER) - value)
    error = (high * F.lit(scale) - scaled) + (value - high) * F.lit(scale)
    nearest = F.rint(scaled)
    gap = scaled - nearest
    return (
        F.when((gap == 0.5) & (error > 0), nearest + 1.0)
        .when((gap == -0.5) & (error < 0), nearest - 1.0)
        .otherwise(nearest)
        / F.lit(scale)
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def short_decimal(value: Column, digits: int) -> Column:
    """A rounded number as its shortest decimal text, always with a point."""
    text = F.format_string(f"%.{digits}f", py_round(value, digits))
    trimmed = F.regexp_replace(text, "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def margin_priority(confidence: Column) -> Column:
    """How undecided one prediction is: 1 at 0.5, 0 at both ends."""
    return F.lit(1.0) - F.abs(confidence - F.lit(0.5)) / F.lit(0.5)
