"""Tail probabilities as column expressions.

Tails are computed as tails, never as one minus the body, so that very small values
keep their relative accuracy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SERIES_TERMS = 80
_FRACTION_DEPTH = 60
_SWITCH = 2.5


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (relative error about 1e-13)."""
    x2 = x * x
    # erf by its all-positive series x * sum (2 x^2)^n / (2n+1)!!
    series = F.aggregate(
        F.sequence(F.lit(_SERIES_TERMS), F.lit(1), F.lit(-1)),
        F.lit(1.0),
        lambda acc, n: F.lit(1.0) + acc * (2.0 * x2) / (2.0 * n + 1.0),
    )
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x2) * x * series
    # continued fraction for the tail, evaluated from the inside out
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_DEPTH), F.lit(1), F.lit(-1)),
        x,
        lambda acc, n: x + (n / 2.0) / acc,
    )
    large = F.exp(-x2) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(x < _SWITCH, small).otherwise(large)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series ten places up."""
    up = x + 10.0
    shift = F.log(x) + sum((F.log(x + float(i)) for i in range(1, 10)), F.lit(0.0))
    inverse = 1.0 / (up * up)
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - inverse / 1680.0) * inverse) * inverse) / up
    return (up - 0.5) * F.log(up) - up + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square, for any number of degrees of freedom.

    The incomplete gamma function with its leading factor taken as a logarithm: a series
    for the lower part where x is below df, a continued fraction for the tail above. The
    depth of both grows with the root of df.
    """
    h, a = x / 2.0, df / 2.0
    front = F.exp(a * F.log(h) - h - log_gamma(a))
    # the depth is bound once, as a one-element array
    depth = F.array((F.lit(60) + F.ceil(12 * F.sqrt(a))).cast("int"))
    lower = F.transform(
        depth,
        lambda n: F.aggregate(
            F.sequence(n, F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, i: F.lit(1.0) + acc * h / (a + i)
        ),
    )[0]
    upper = F.transform(
        depth,
        lambda n: F.aggregate(
            F.sequence(n, F.lit(1), F.lit(-1)),
            h + 2.0 * n + 1.0 - a,
            lambda acc, i: h + 2.0 * i - 1.0 - a - i * (i - a) / acc,
        ),
    )[0]
    tail = F.when(h < a + 1.0, 1.0 - front / a * lower).otherwise(front / upper)
    return F.when(x <= 0, F.lit(1.0)).when(df > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function of many x at once, from 0 to 1."""
    x = np.asarray(x, np.float64)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_front + a * np.log(inside) + b * np.log1p(-inside))
    swap = inside >= (a + 1.0) / (a + b + 2.0)
    first, second, at = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - inside, inside)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c = np.ones_like(at)
    d = 1.0 / keep(1.0 - (first + second) * at / (first + 1.0))
    h = d.copy()
    for m in range(1, 100 + int(4 * math.sqrt(max(a, b)))):
        for num in (
            m * (second - m) * at / ((first + 2 * m - 1) * (first + 2 * m)),
            -(first + m) * (first + second + m) * at / ((first + 2 * m) * (first + 2 * m + 1)),
        ):
            d = 1.0 / keep(1.0 + num * d)
            c = keep(1.0 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    value = front * h / first
    value = np.where(swap, 1.0 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(value, 0.0, 1.0)))


def _t_two_sided(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b = df / 2.0, 0.5
    x = df / (df + t * t)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x)
    y = t * t / (df + t * t)
    if y <= 0.0:
        return 1.0
    front = math.exp(log_front + b * math.log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student tail; runs once per test row, not per data row."""
    return pd.Series([_t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))])
