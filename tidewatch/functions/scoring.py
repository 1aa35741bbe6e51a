"""Score formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of the robust z-score, and the smallest deviation it divides by.
MAD_SCALE = 1.4826
MAD_FLOOR = 1e-9


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return F.abs(value - median) / (F.lit(MAD_SCALE) * mad)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scale to the given bounds; not clipped outside them, zero when they coincide."""
    return F.when(high == low, F.lit(0.0)).otherwise((score - low) / (high - low))


def normalize_weights(weights: Sequence[float]) -> list[float]:
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights must sum to a positive value")
    return [weight / total for weight in weights]


def weighted_sum(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum in the given order, starting from zero."""
    total = F.lit(0.0)
    for score, weight in zip(scores, weights, strict=True):
        total = total + F.lit(float(weight)) * score
    return total
