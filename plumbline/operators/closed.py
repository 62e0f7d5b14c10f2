"""Closed-form prices and thresholds as column expressions."""

from __future__ import annotations

from math import exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Below this the distribution is summed as a series, beyond it its tail is a continued fraction.
NEAR, SERIES, FRACTION = 3.0, 60, 120


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution of a whole array at once; nan stays nan."""
    x = np.clip(z, -NEAR, NEAR)
    u, s = x * x, np.ones_like(x)
    for k in range(SERIES, 0, -1):
        s = 1 + u / (2 * k + 1) * s
    near = 0.5 + x * s * np.exp(-u / 2) / sqrt(2 * pi)
    far = np.clip(np.abs(z), NEAR, 40.0)
    c = far.copy()
    for k in range(FRACTION, 0, -1):
        c = far + k / c
    tail = np.exp(-far * far / 2) / sqrt(2 * pi) / c
    return np.where(np.abs(z) <= NEAR, near, np.where(z > 0, 1 - tail, tail)) + 0 * z.clip(-1, 1)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_array(z.to_numpy(float)), z.index)


def _d(forward: Column, strike: Column, vol: Column, t: Column) -> tuple[Column, Column]:
    width = vol * F.sqrt(t)
    one = (F.log(forward / strike) + vol * vol * t / 2) / width
    return one, one - width


def call(spot: Column, strike: Column, rate: Column, dividend: Column, vol: Column, t: Column) -> Column:
    """European call on an asset that pays a dividend yield; vol and t above 0."""
    one, two = _d(spot * F.exp((rate - dividend) * t), strike, vol, t)
    return spot * F.exp(-dividend * t) * normal_cdf(one) - strike * F.exp(-rate * t) * normal_cdf(two)


def put(spot: Column, strike: Column, rate: Column, dividend: Column, vol: Column, t: Column) -> Column:
    one, two = _d(spot * F.exp((rate - dividend) * t), strike, vol, t)
    return strike * F.exp(-rate * t) * normal_cdf(-two) - spot * F.exp(-dividend * t) * normal_cdf(-one)


def parity_gap(spot: Column, strike: Column, rate: Column, dividend: Column, vol: Column, t: Column) -> Column:
    """Call less put less the forward's present value: 0 but for rounding."""
    args = (spot, strike, rate, dividend, vol, t)
    return call(*args) - put(*args) - (spot * F.exp(-dividend * t) - strike * F.exp(-rate * t))


def digital_call(spot: Column, strike: Column, rate: Column, vol: Column, t: Column, cash: float = 1.0) -> Column:
    return cash * F.exp(-rate * t) * normal_cdf(_d(spot * F.exp(rate * t), strike, vol, t)[1])


def exchange(a: Column, b: Column, vol_a: Column, vol_b: Column, rho: float, t: Column) -> Column:
    """The right to give b for a."""
    zero = F.lit(0.0)
    return call(a, b, zero, zero, F.sqrt(vol_a * vol_a + vol_b * vol_b - 2 * rho * vol_a * vol_b), t)


def geometric_asian_call(spot: Column, strike: Column, rate: Column, vol: Column, t: Column) -> Column:
    """A call on the continuous geometric mean."""
    carry = 0.5 * (rate - vol * vol / 6)
    return call(spot, strike, rate, rate - carry, vol / sqrt(3.0), t)


def caplet(forward: Column, strike: Column, vol: Column, t: Column, accrual: float = 1.0, discount: float = 1.0) -> Column:
    one, two = _d(forward, strike, vol, t)
    return discount * accrual * (forward * normal_cdf(one) - strike * normal_cdf(two))


def swaption(forward: Column, strike: Column, vol: Column, t: Column, annuity: float, payer: bool = True) -> Column:
    return annuity * (caplet(forward, strike, vol, t) if payer else caplet(strike, forward, vol, t))


def vasicek_bond(r: Column, tau: Column, speed: float, level: float, sigma: float) -> Column:
    b = (1 - F.exp(-speed * tau)) / speed
    return F.exp((level - sigma**2 / (2 * speed**2)) * (b - tau) - sigma**2 / (4 * speed) * b * b - b * r)


def cir_bond(r: Column, tau: Column, speed: float, level: float, sigma: float) -> Column:
    h = sqrt(speed**2 + 2 * sigma**2)
    grown = F.exp(h * tau) - 1
    below = (h + speed) * grown + 2 * h
    return F.exp(2 * speed * level / sigma**2 * F.log(2 * h * F.exp((h + speed) / 2 * tau) / below) - 2 * grown / below * r)


def _roots(rate: Column, dividend: Column, vol: Column) -> tuple[Column, Column]:
    """Roots of half vol^2 b (b - 1) + (rate - dividend) b = rate, smaller first."""
    half = 0.5 - (rate - dividend) / (vol * vol)
    width = F.sqrt(half * half + 2 * rate / (vol * vol))
    return half - width, half + width


def perpetual_call(spot: Column, cost: Column, rate: Column, dividend: Column, vol: Column) -> tuple[Column, Column, Column]:
    """(beta, threshold, value) of the right to pay cost for the asset at any time; dividend above 0."""
    beta = _roots(rate, dividend, vol)[1]
    at = beta / (beta - 1) * cost
    return beta, at, F.when(spot >= at, spot - cost).otherwise((at - cost) * F.pow(spot / at, beta))


def perpetual_put(spot: Column, scrap: Column, rate: Column, dividend: Column, vol: Column) -> tuple[Column, Column, Column]:
    """(beta, threshold, value) of the right to give the asset up for scrap at any time."""
    beta = _roots(rate, dividend, vol)[0]
    at = beta / (beta - 1) * scrap
    return beta, at, F.when(spot <= at, scrap - spot).otherwise((scrap - at) * F.pow(spot / at, beta))


def merton_call(spot: Column, strike: Column, rate: float, vol: Column, t: Column, intensity: float, jump_mean: float, jump_sd: float, terms: int = 30) -> Column:
    """Calls given each number of lognormal jumps, weighted by a Poisson law; `terms` numbers of jumps."""
    growth = jump_mean + jump_sd**2 / 2
    tilted, total = intensity * exp(growth), F.lit(0.0)
    weight = F.exp(-tilted * t)
    for n in range(terms):
        drift = rate - intensity * (exp(growth) - 1) + n * growth / t
        total = total + weight * call(spot, strike, drift, F.lit(0.0), F.sqrt(vol * vol + n * jump_sd**2 / t), t)
        weight = weight * (tilted * t) / (n + 1)
    return total


def merton_share(drift: Column, rate: Column, risk_aversion: float, vol: Column) -> Column:
    """Share of wealth held by constant relative risk aversion; aversion 1 is the log-optimal share."""
    return (drift - rate) / (risk_aversion * vol * vol)


def log_growth(share: Column, drift: Column, rate: Column, vol: Column) -> Column:
    """Expected growth of log wealth under a constant share."""
    return rate + share * (drift - rate) - share * share * vol * vol / 2


def market_price_of_risk(drift: Column, rate: Column, vol: Column) -> Column:
    return (drift - rate) / vol


def tilted_jumps(intensity: float, mean: float, sd: float, theta: float) -> tuple[float, float]:
    """(intensity, mean) of normal jumps after an exponential tilt."""
    return exp(log(intensity) + theta * mean + theta**2 * sd**2 / 2), mean + theta * sd**2
