"""Tail probabilities and normal quantiles on per-feature result rows (one row per test)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_cf(a, b, x) / a
    return 1 - math.exp(log_front) * _beta_cf(b, a, 1 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - s, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _apply(fn, *series: pd.Series) -> pd.Series:
    ok = pd.concat(series, axis=1).notna().all(axis=1)
    return pd.Series([fn(*v) if good else None for good, *v in zip(ok, *series)], index=series[0].index, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _apply(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(lambda v, d: beta_inc(d / 2, 0.5, d / (d + v * v)), t, dof)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(lambda v, d: gamma_upper(d / 2, v / 2), x, dof)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return _apply(inv, p)
