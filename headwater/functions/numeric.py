"""Numeric column expressions: seasonality, guards, scaling, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwater.constants import FLAT_SD, Z_CLIP


def seasonal(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.dayofyear(date) * F.lit(2 * math.pi / 365.25)
    return F.sin(angle), F.cos(angle)


def finite_or_zero(value: Column) -> Column:
    # NaN compares greater than every number and NULL is not true.
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def clip(value: Column, bound: float = Z_CLIP) -> Column:
    """Bound a value; NULL stays NULL, which greatest and least would skip."""
    return F.when(value > bound, F.lit(bound)).when(value < -bound, F.lit(-bound)).otherwise(value)


def causal_z(value: Column, n: Column, mean: Column, sd: Column) -> Column:
    """Z-score against past statistics; 0 while there is no spread to divide by,
    the raw value if the past is constant, NULL if the value is missing."""
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.coalesce(n, F.lit(0)) < 2, F.lit(0.0))
        .when(sd < FLAT_SD, value)
        .otherwise(clip((value - mean) / sd))
    )


def population_sd(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from its sufficient statistics."""
    mean = F.try_divide(total, n)
    variance = F.try_divide(squares, n) - mean * mean
    # What is left of a constant series is rounding, not spread.
    return F.when(variance > F.lit(1e-13) * mean * mean, F.sqrt(F.greatest(variance, F.lit(0.0)))).when(
        variance.isNotNull(), F.lit(0.0))


def shrink(prediction: Column, factor) -> Column:
    """Pull a predicted change towards no change."""
    return prediction * (factor if isinstance(factor, Column) else F.lit(float(factor)))


def at_least_half(probability: Column) -> Column:
    return (probability >= 0.5).cast("int")


def published(value: Column | str, places: int = 4) -> Column:
    # Sums come in any order: their last bits must not tell to which side a tie goes.
    return F.round(F.round(value, 10), places)
