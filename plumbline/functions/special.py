"""Special functions without scipy: scalars for the driver, and Arrow-batched columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS, _TINY = 1e-16, 1e-300


def logsumexp(xs) -> float:
    x = np.asarray(list(xs), float)
    if not len(x):
        return -math.inf
    top = x.max()
    return float(top) if not math.isfinite(top) else float(top + math.log(np.exp(x - top).sum()))


def erf(x: float) -> float:
    return math.erf(x)


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_pvalue_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Quantile of N(0, 1): bracketing by bisection, then Newton on the CDF."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    low, high = -40.0, 40.0
    for _ in range(60):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if norm_cdf(mid) < p else (low, mid)
    z = 0.5 * (low + high)
    for _ in range(3):
        d = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        if d:
            z -= (norm_cdf(z) - p) / d
    return z


def ln_gamma(z: float) -> float:
    return math.lgamma(z)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def gamma_p(s: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below s + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - s, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 1000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or _TINY)
        c = b + a / c or _TINY
        h *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return 1 - front * h


def chi2_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def chi2_pvalue(x: float, df: float) -> float:
    return 1 - chi2_cdf(x, df)


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc_reg(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or _TINY)
            c = 1 + up / c or _TINY
            h *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * h


def student_t_pvalue(t: float, df: float) -> float:
    return betainc_reg(df / 2, 0.5, df / (df + t * t))


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * student_t_pvalue(t, df)
    return 1 - tail if t > 0 else tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else betainc_reg(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def f_pvalue(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else betainc_reg(d2 / 2, d1 / 2, d2 / (d1 * x + d2))


def column(f, *args):
    """A scalar function of this module as a column; rows travel in Arrow batches."""

    @F.pandas_udf(DoubleType())
    def apply(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols)], dtype="float64")

    return apply(*args)
