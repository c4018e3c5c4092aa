"""Tail probabilities used by the drift and comparison tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KS_TERMS = 100
_KS_CERTAIN_BELOW = 0.2  # the limiting tail is 1 to 12 digits below this argument


def kolmogorov_tail(statistic: Column, n_first: Column, n_second: Column) -> Column:
    """Limiting two-sided Kolmogorov tail, as a finite alternating sum."""
    a, b = n_first.cast("double"), n_second.cast("double")
    arg = statistic * F.sqrt(a * b / (a + b))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * arg * arg),
    )
    total = 2.0 * F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(arg < _KS_CERTAIN_BELOW, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def student_upper(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * _beta_share(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


@F.pandas_udf(T.DoubleType())
def student_upper_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Applied to one-row statistics frames."""
    pairs = zip(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(np.array([student_upper(a, b) for a, b in pairs], dtype=float))
