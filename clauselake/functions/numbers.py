"""Rounding and banding with defined ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^k + 0.5) / 10^k: ties go up for either sign, as in the browser; null stays null."""
    k = float(10**digits)
    return F.floor(c * k + F.lit(0.5)) / k


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def confidence(c: Column, default: float) -> Column:
    """Into [0, 1]; null and NaN become the default."""
    return clamp(F.when(c.isNull() | F.isnan(c), F.lit(default)).otherwise(c), 0.0, 1.0)


def weighted_mean(value: Column, weight: Column, default_weight: float) -> Column:
    """Aggregate over rows with a value; a missing weight counts as the default; null without rows or weight."""
    w = F.when(value.isNotNull(), F.coalesce(weight, F.lit(default_weight)))
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))
