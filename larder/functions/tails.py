"""Tail probabilities for small result tables, as pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), _TINY)
    value = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + top * d or _TINY)
            c = 1.0 + top / c or _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value / a


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2.0
        d = 1.0 / (top * d + b or _TINY)
        c = b + top / c or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p > 0.5) of Student's t by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


_Z, _ZW = np.polynomial.legendre.leggauss(96)
_NORMAL = NormalDist()


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.cdf(v) for v in x.ravel()]).reshape(x.shape)


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(range of k normals / independent s > q), by Gauss-Legendre quadrature."""
    if q <= 0:
        return 1.0
    spread = min(8.0, 8.0 / math.sqrt(2.0 * df) + 0.02)
    s = np.maximum(1.0 + spread * _Z, 1e-9)
    log_density = (
        (df / 2) * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s**2 / 2
    )
    weights = spread * _ZW * np.exp(log_density) * (1.0 + spread * _Z > 0)
    z = 8.0 * _Z
    density = 8.0 * _ZW * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = _phi(z)[None, :] - _phi(z[None, :] - q * s[:, None])
    within = k * (density[None, :] * inner ** (k - 1)).sum(axis=1)
    return float(min(1.0, max(0.0, 1.0 - (weights * within).sum())))


def _each(function):
    """A double-valued pandas UDF applying ``function`` to each result row; NULL in, NULL out."""

    def apply(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in rows], dtype="float64")

    return apply


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_quantile)(p, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_tail)(f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda v, d: gamma_sf(v / 2, d / 2))(x, df)


@F.pandas_udf(DoubleType())
def range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: studentized_range_tail(a, int(b), c))(q, k, df)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)
