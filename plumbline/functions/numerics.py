"""Tail probabilities for small result tables, as vectorised helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NORMAL = NormalDist()


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in np.atleast_1d(x)])


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v and v is not None else None)


@F.pandas_udf(DoubleType())
def normal_probability(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)) if v == v else None)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if dof <= 0 or t != t:
        return float("nan")
    x = dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def correlation_tail(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation over n pairs by the t approximation."""

    def tail(r: float, size: float) -> float:
        if r is None or r != r or size < 3:
            return float("nan")
        if abs(r) >= 1.0:
            return 0.0
        return t_two_sided(r * math.sqrt((size - 2) / (1 - r * r)), size - 2)

    return pd.Series([tail(r, s) for r, s in zip(rho, n)], dtype="float64")
