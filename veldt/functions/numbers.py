"""Numeric functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x + 0.5) at a number of places: halves go up, also below zero."""
    return F.floor(x * 10**places + 0.5) / 10**places


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_score(values: list[Column], means: list[float], spreads: list[float], weights: list[float], bias: float) -> Column:
    """Chance from standardised values; a spread of zero leaves its value out."""
    total = F.lit(bias)
    for v, m, s, w in zip(values, means, spreads, weights):
        total = total + (v - m) / s * w if s else total
    return sigmoid(total)


def hue_angle(lightness: Column, b: Column) -> Column:
    """Angle in degrees of (lightness - 50, b)."""
    return F.degrees(F.atan2(lightness - 50, b))


def to_linear(srgb: Column) -> Column:
    """Linear value of an sRGB component from 0 to 1."""
    return F.when(srgb <= 0.04045, srgb / 12.92).otherwise(F.pow((srgb + 0.055) / 1.055, 2.4))


def to_srgb(linear: Column) -> Column:
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, 1 / 2.4) * 1.055 - 0.055)


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def backoff(attempt: Column, base: float, most: float, unit: Column, floor: Column | None = None) -> Column:
    """Seconds to wait: ``unit`` (0 to 1) of the doubled base, at most ``most``, but not under a floor that was asked for."""
    wait = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)) * unit
    return F.greatest(wait, F.coalesce(floor, F.lit(0.0))) if floor is not None else wait


def shoelace(points: str) -> Column:
    """Area of a polygon given as an array of structs (x, y)."""
    n = F.size(points)
    cross = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(F.col(points), i)["x"] * F.get(F.col(points), (i + 1) % n)["y"] - F.get(F.col(points), (i + 1) % n)["x"] * F.get(F.col(points), i)["y"],
    )
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(F.lit(0.0))


def percent_parts(counts: str) -> Column:
    """Percentages of an array of counts to one place; what rounding leaves goes to the first, so they add up to 100."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    parts = F.transform(counts, lambda c: F.floor(c * 1000 / total + 0.5) / 10)
    rest = F.lit(100.0) - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda p, i: F.when(i == 0, F.floor((p + rest) * 10 + 0.5) / 10).otherwise(p))


DEGREE = math.pi / 180
