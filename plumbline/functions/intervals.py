"""Interval columns in closed form."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper Wilson score limits, cut to [0, 1]; NaN when there are no rows."""
    z = z_value(confidence)
    total = F.when(n > 0, n.cast("double"))
    share = successes.cast("double") / total
    denominator = 1 + F.lit(z * z) / total
    centre = (share + F.lit(z * z / 2) / total) / denominator
    half = (
        F.lit(z)
        * F.sqrt(share * (1 - share) / total + F.lit(z * z / 4) / (total * total))
        / denominator
    )
    nan = F.lit(float("nan"))
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(nan)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(nan)
    return low, high
