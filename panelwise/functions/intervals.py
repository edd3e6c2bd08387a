"""Interval estimates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.nulls import _col, ratio

# The exact two-sided 95% normal quantile (score interval) and the
# rounded one (all hand-written intervals).
Z_EXACT = 1.959963984540054
Z_ROUND = 1.96


def wilson(x: Column | str, n: Column | str, z: float = Z_EXACT) -> tuple[Column, Column]:
    """Score interval for a proportion; NULL when ``n`` is 0."""
    x, n = _col(x).cast("double"), _col(n).cast("double")
    p = ratio(x, n)
    z2 = z * z
    denom = 1 + ratio(F.lit(z2), n)
    centre = (p + ratio(F.lit(z2), 2 * n)) / denom
    half = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z2), 4 * n * n)) / denom
    return centre - half, centre + half


def wald(p: Column | str, n: Column | str, z: float = Z_ROUND) -> tuple[Column, Column, Column]:
    """Standard error and plain normal interval, not clipped to [0, 1]."""
    p = _col(p)
    se = F.sqrt(ratio(p * (1 - p), _col(n)))
    return se, p - z * se, p + z * se


def mean_interval(mean, sd, n, z: float = Z_ROUND) -> tuple[Column, Column]:
    half = z * _col(sd) / F.sqrt(_col(n).cast("double"))
    return _col(mean) - half, _col(mean) + half


def coef_interval(est, se, exponentiate: bool = False, z: float = Z_ROUND) -> tuple[Column, ...]:
    """Estimate and interval of a coefficient, optionally on the ratio scale."""
    est, se = _col(est), _col(se)
    parts = (est, est - z * se, est + z * se)
    return tuple(F.exp(c) for c in parts) if exponentiate else parts


def bind_wilson(df: DataFrame, x: str, n: str) -> DataFrame:
    """Attach lower and upper score bounds to a summary, row by row."""
    lower, upper = wilson(x, n)
    return df.withColumns({"lower": lower, "upper": upper})
