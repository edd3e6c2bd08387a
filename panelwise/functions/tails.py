"""Upper tail probabilities for result frames (one row per test or coefficient)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_upper(x: float | None, df: float | None) -> float | None:
    """P(X > x) for a chi-square variable: series below the mean, continued fraction above."""
    if x is None or df is None or math.isnan(x) or math.isnan(df) or df <= 0:
        return None
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= z / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def normal_two_sided(z: float | None) -> float | None:
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: Column, df: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_upper(a, b) for a, b in zip(x, df)], dtype="float64")

    return tail(x.cast("double"), df.cast("double"))
