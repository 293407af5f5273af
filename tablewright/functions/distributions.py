"""Tail probabilities for small result tables, as vectorised functions of columns.

Spark has no distribution functions, so the few statistics rows go through Arrow.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * scale


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(b, a, 1 - x) * front / b
    return _beta_fraction(a, b, x) * front / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + num / c
            c = tiny if abs(c) < tiny else c
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def kolmogorov_two_sided(d: float, n: float) -> float:
    """Limit law of the Kolmogorov statistic, at a place corrected for the sample's size."""
    if d <= 0:
        return 1.0
    z = math.sqrt(n) * d
    x = z + 1 / (6 * math.sqrt(n)) + (z - 1) / (4 * n)
    if x < 1:
        # the same law as a series that converges fast near zero
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * total))
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 20))
    return min(1.0, max(0.0, 2 * total))


def _apply(fn, *series: pd.Series) -> pd.Series:
    out = []
    for args in zip(*series):
        bad = any(a is None or pd.isna(a) for a in args)
        out.append(None if bad else fn(*[float(a) for a in args]))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _apply(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return _apply(kolmogorov_two_sided, d, n)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _apply(lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0)), z)
