"""Angles and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_degrees(difference: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(difference + 180.0, F.lit(360.0)) - 180.0


def wrap_radians(difference: Column) -> Column:
    """An angle difference in [-pi, pi)."""
    return F.pmod(difference + F.pi(), 2 * F.pi()) - F.pi()


def metres(centimetres: Column) -> Column:
    return centimetres * 0.01


def centimetres(metres_: Column) -> Column:
    return metres_ * 100.0


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def number_or(text: Column, default: float) -> Column:
    """The finite number a text holds, else the default."""
    x = text.try_cast("double")
    return F.when(finite(x), x).otherwise(F.lit(default))
