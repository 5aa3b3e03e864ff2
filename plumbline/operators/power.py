"""Is a group large enough for the difference it is meant to show?"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import normal_probability

QUANTILE = NormalDist().inv_cdf


def n_for_two_shares(p1: Column, p2: Column, power: float = 0.80, alpha: float = 0.05) -> Column:
    """Rows per group needed to tell two independent proportions apart."""
    za, zb = F.lit(QUANTILE(1 - alpha / 2)), F.lit(QUANTILE(power))
    middle = (p1 + p2) / 2
    top = za * F.sqrt(2 * middle * (1 - middle)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.when(p1 != p2, F.ceil(top * top / F.pow(F.when(p1 != p2, p1 - p2), 2)))


def n_for_paired_flags(
    discordant: Column, odds: Column, power: float = 0.80, alpha: float = 0.05
) -> Column:
    """Rows needed by McNemar's test for a discordant share and an odds ratio."""
    za, zb = F.lit(QUANTILE(1 - alpha / 2)), F.lit(QUANTILE(power))
    top = za * (odds + 1) + zb * F.sqrt(F.pow(odds + 1, 2) - F.pow(odds - 1, 2) * discordant)
    bottom = F.pow(odds - 1, 2) * discordant
    return F.when(bottom > 0, F.ceil(top * top / F.when(bottom > 0, bottom)))


def power_score(n: Column, p1: Column, p2: Column, alpha: float = 0.05) -> Column:
    """The normal score whose probability is the power reached with n rows."""
    za = F.lit(QUANTILE(1 - alpha / 2))
    middle = (p1 + p2) / 2
    rows = F.when(n > 0, n).cast("double")
    null_error = F.sqrt(2 * middle * (1 - middle) / rows)
    error = F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / rows)
    return (F.abs(p1 - p2) - za * null_error) / F.when(error > 0, error)


def power_report(
    groups: DataFrame,
    n: str,
    p1: str,
    p2: str,
    power: float = 0.80,
    alpha: float = 0.05,
) -> DataFrame:
    """Adds required rows, effect, reached power and adequacy to a table of group sizes."""
    a, b = F.col(p1), F.col(p2)
    scored = (
        groups.withColumn("n_required", n_for_two_shares(a, b, power, alpha))
        .withColumn("effect", F.abs(a - b))
        .withColumn("_score", power_score(F.col(n), a, b, alpha))
    )
    reached = normal_probability(F.coalesce(F.col("_score"), F.lit(float("nan"))))
    return (
        scored.withColumn("_reached", reached)
        .withColumn("power", F.when(a == b, F.lit(alpha)).otherwise(F.col("_reached")))
        .withColumn("adequate", F.col(n) >= F.col("n_required"))
        .drop("_score", "_reached")
    )
