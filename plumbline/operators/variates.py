"""Random laws as column expressions of a keyed uniform.

A uniform is a hash of (seed, stream, key), so a draw depends on its row's key alone: it is the same on every cluster, in
every partitioning and after every retry, and needs no generator state. Streams of one row are independent of each other.
Laws with a closed form are inverted or transformed; shapes of gamma, beta, chi-square and Dirichlet draws are whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp, lgamma, log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the hash that make a uniform.
BITS = 52


def uniform(key: Column, seed: int, stream: int = 0) -> Column:
    """In the open interval (0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def between(u: Column, low: float, high: float) -> Column:
    return low + (high - low) * u


def exponential(u: Column, rate: float = 1.0) -> Column:
    return -F.log(u) / rate


def normal(u: Column, v: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box and Muller's transform of two uniforms."""
    return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)


def student_t(u: Column, v: Column, df: float) -> Column:
    """Bailey's trigonometric form."""
    return F.sqrt(df * (F.pow(u, F.lit(-2.0 / df)) - 1)) * F.cos(2 * pi * v)


def erlang(us: Sequence[Column], scale: float = 1.0) -> Column:
    """Gamma with a whole shape: the number of uniforms."""
    return -scale * reduce(lambda a, b: a + b, (F.log(u) for u in us))


def chi2(us: Sequence[Column]) -> Column:
    """Chi-square of twice as many degrees of freedom as uniforms."""
    return erlang(us, 2.0)


def noncentral_chi2(us: Sequence[Column], u: Column, v: Column, ncp: float) -> Column:
    """2 len(us) + 1 degrees of freedom: a shifted normal squared and a central part."""
    z = normal(u, v) + ncp**0.5
    return z * z + chi2(us)


def beta(us: Sequence[Column], vs: Sequence[Column]) -> Column:
    a, b = erlang(us), erlang(vs)
    return a / (a + b)


def dirichlet(parts: Sequence[Sequence[Column]]) -> Column:
    draws = [erlang(p) for p in parts]
    return F.array(*(d / reduce(lambda a, b: a + b, draws) for d in draws))


def inverse_gaussian(u: Column, v: Column, w: Column, mu: float, lam: float) -> Column:
    """The smaller root of the normal's square, or its mirror image."""
    z = normal(u, v)
    y = mu * z * z
    x = mu + mu / (2 * lam) * (y - F.sqrt(4 * lam * y + y * y))
    return F.when(w <= mu / (mu + x), x).otherwise(mu * mu / x)


def stable(u: Column, v: Column, alpha: float, skew: float) -> Column:
    """Chambers, Mallows and Stuck; alpha other than 1."""
    from math import atan, tan

    theta, e = pi * (u - 0.5), -F.log(v)
    shift = skew * tan(pi * alpha / 2)
    b = atan(shift) / alpha
    size = (1 + shift * shift) ** (1 / (2 * alpha))
    return size * F.sin(alpha * (theta + b)) / F.pow(F.cos(theta), F.lit(1 / alpha)) * F.pow(F.cos(theta - alpha * (theta + b)) / e, F.lit((1 - alpha) / alpha))


def _count(u: Column, cumulative: Sequence[float]) -> Column:
    """How many of the cumulative probabilities are below u."""
    return F.size(F.filter(F.array(*map(F.lit, cumulative)), lambda c: c < u))


def _cumulative(weights: Sequence[float]) -> list[float]:
    out, s = [], 0.0
    for w in weights:
        s += w
        out.append(s)
    return out


def bernoulli(u: Column, p: float) -> Column:
    return (u < p).cast("int")


def categorical(u: Column, weights: Sequence[float]) -> Column:
    """0 to len - 1 by inversion."""
    total = sum(weights)
    return _count(u, [c / total for c in _cumulative(weights)][:-1])


def binomial(u: Column, n: int, p: float) -> Column:
    """Inversion, for the n of a table of n probabilities; 0 < p < 1."""
    return _count(u, _cumulative([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(n)]))


def poisson(u: Column, rate: float) -> Column:
    """Inversion over a table that leaves less than 2^-53 out."""
    top = int(rate + 12 * rate**0.5 + 40)
    return _count(u, _cumulative([exp(-rate + k * log(rate) - lgamma(k + 1)) for k in range(top)]))


def multinomial(us: Sequence[Column], weights: Sequence[float]) -> Column:
    """Counts of the categories among as many draws as uniforms."""
    draws = F.array(*(categorical(u, weights) for u in us))
    times = lambda k: F.size(F.filter(draws, lambda x: x == k))
    return F.array(*(times(k) for k in range(len(weights))))
