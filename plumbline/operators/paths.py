"""Functionals of sampled paths: each key is a path in a stated order, and all is windows and aggregations by key.

Nulls and non-finite values are left out before anything is differenced. A path of one point has no increments: sums over
them are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, ratio


def _steps(df: DataFrame, key: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """df with the increment _d_<v> and the value before _l_<v> of each value."""
    w = Window.partitionBy(*key).orderBy(*order)
    for v in values:
        df = df.where(finite(F.col(v).cast("double")))
    for v in values:
        df = df.withColumn(f"_l_{v}", F.lag(v).over(w)).withColumn(f"_d_{v}", F.col(v) - F.col(f"_l_{v}"))
    return df


def variation(df: DataFrame, key: Sequence[str], order: Sequence[str], x: str, y: str) -> DataFrame:
    """(key, quadratic_variation of x, covariation of x and y, ito_integral of x dy with x taken before the step)."""
    d = _steps(df, key, order, x, y)
    dx, dy = F.col(f"_d_{x}"), F.col(f"_d_{y}")
    return d.groupBy(*key).agg(F.sum(dx * dx).alias("quadratic_variation"), F.sum(dx * dy).alias("covariation"), F.sum(F.col(f"_l_{x}") * dy).alias("ito_integral"))


def running_extremes(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """df with running_maximum and running_minimum, this row included."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_maximum", F.max(v).over(w)).withColumn("running_minimum", F.min(v).over(w))


def first_passage(df: DataFrame, key: Sequence[str], t: str, v: str, barrier: float, up: bool = True) -> DataFrame:
    """(key, first_passage): the first time at which v is at or beyond the barrier, null if never."""
    hit = F.col(v) >= barrier if up else F.col(v) <= barrier
    return df.groupBy(*key).agg(F.min(F.when(hit, F.col(t))).alias("first_passage"))


def bridge_hit(a: Column, b: Column, barrier: float, variance: Column) -> Column:
    """Probability that a Brownian bridge from a to b, both below the barrier, touches it."""
    return F.when((a >= barrier) | (b >= barrier), 1.0).otherwise(F.exp(-2 * (barrier - a) * (barrier - b) / variance))


def barrier_survival(df: DataFrame, key: Sequence[str], order: Sequence[str], t: str, v: str, barrier: float, sigma: float) -> DataFrame:
    """(key, survival): probability that the path stayed under the barrier between its points as well; 0 if a point is not."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = _steps(df, key, order, v).withColumn("_dt", F.col(t) - F.lag(t).over(w))
    p = bridge_hit(F.col(f"_l_{v}"), F.col(v), barrier, sigma * sigma * F.col("_dt"))
    s = d.groupBy(*key).agg(F.max(v).alias("_top"), F.sum(F.when(F.col("_dt") > 0, F.log1p(-F.when(p < 1, p)))).alias("_log"))
    return s.select(*key, F.when(F.col("_top") >= barrier, 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0)))).alias("survival"))


def jump_statistics(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, window: int) -> DataFrame:
    """df with statistic and jump of each increment against the bipower volatility of the window before it.

    0 before the window is full; the threshold is the Gumbel one for the number of the key's increments.
    """
    by = Window.partitionBy(*key)
    w = by.orderBy(*order)
    d = _steps(df, key, order, v).withColumn("_p", F.abs(F.col(f"_d_{v}")) * F.abs(F.lag(f"_d_{v}").over(w)))
    d = d.withColumn("_b", F.sum("_p").over(w.rowsBetween(-(window - 1), -1))).withColumn("_i", F.row_number().over(w) - 2).withColumn("_n", F.count(f"_d_{v}").over(by))
    scale = F.sqrt(pi / 2 * F.col("_b") / (window - 1))
    d = d.withColumn("statistic", F.when((F.col("_i") >= window) & (scale > 0), F.col(f"_d_{v}") / scale).otherwise(0.0))
    ln = F.log(F.col("_n").cast("double"))
    bound = F.sqrt(2 * ln) - (F.log(F.lit(pi)) + F.log(ln)) / (2 * F.sqrt(2 * ln))
    return d.withColumn("jump", F.coalesce(F.abs("statistic") > bound, F.lit(False))).drop("_p", "_b", "_i", "_n", f"_d_{v}", f"_l_{v}")


def jump_ratio(realised: DataFrame, n: str) -> DataFrame:
    """realised (with rv, bipower, quadpower and a count of increments) with the ratio statistic of realised and bipower variation.

    Null below four increments, infinite or NaN without variation.
    """
    bound = F.sqrt(ratio((pi * pi / 4 + pi - 5) * F.col("quadpower"), F.col(n) * F.col("rv") * F.col("rv")))
    return realised.withColumn("statistic", ratio(ratio(F.col("bipower"), F.col("rv")) - 1, bound))


def hurst(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """(key, hurst) from the quadratic variations at one and at two steps (pairs that do not overlap); null below 8 increments."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = _steps(df, key, order, v).where(F.col(f"_d_{v}").isNotNull())
    d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn("_two", F.when(F.col("_i") % 2 == 1, F.col(f"_d_{v}") + F.lag(f"_d_{v}").over(w)))
    s = d.groupBy(*key).agg(F.count("*").alias("_n"), F.sum(F.pow(f"_d_{v}", F.lit(2.0))).alias("_a"), F.sum(F.col("_two") * F.col("_two")).alias("_b"))
    return s.select(*key, F.when((F.col("_n") >= 8) & (F.col("_a") > 0) & (F.col("_b") > 0), 0.5 * F.log2(F.col("_b") / F.col("_a")) + 0.5).alias("hurst"))


def change_point(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """(key, index, contrast, left, right): the split of the increments into two variances that fits best, the first of equals.

    Only keys with 8 increments or more; two increments at least on the left and three on the right.
    """
    w = Window.partitionBy(*key)
    d = _steps(df, key, order, v).where(F.col(f"_d_{v}").isNotNull()).withColumn("_q", F.pow(f"_d_{v}", F.lit(2.0)))
    d = d.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_a", F.sum("_q").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.sum("_q").over(w) - F.col("_a"))
    k, n, a, b = (F.col(c) for c in ("_k", "_n", "_a", "_b"))
    c = k * F.log(a / k) + (n - k) * F.log(b / (n - k))
    at = F.when((k >= 2) & (k < n - 2) & (a > 0) & (b > 0), F.struct(c.alias("contrast"), k.cast("long").alias("index"), a.alias("left"), b.alias("right")))
    return d.where(n >= 8).groupBy(*key).agg(F.min(at).alias("_m")).select(*key, "_m.index", "_m.contrast", "_m.left", "_m.right")


def mean_reverting(df: DataFrame, key: Sequence[str], order: Sequence[str], t: str, v: str, speed: float, level: float, sigma: float) -> DataFrame:
    """df with the standardised Euler residual of dx = speed (level - x) dt + sigma dW; null at the first point and where time stands."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = _steps(df, key, order, v).withColumn("_dt", F.col(t) - F.lag(t).over(w))
    gap = F.col(f"_d_{v}") - speed * (level - F.col(f"_l_{v}")) * F.col("_dt")
    return d.withColumn("residual", F.when(F.col("_dt") > 0, gap / (sigma * F.sqrt("_dt")))).drop(f"_d_{v}", f"_l_{v}")


def mean_reverting_contrasts(df: DataFrame, key: Sequence[str], order: Sequence[str], t: str, v: str, speed: float, level: float, sigma: float) -> DataFrame:
    """(key, quasi_loglik, least_squares): the Gaussian quasi-likelihood of the Euler scheme and its drift's contrast."""
    d = mean_reverting(df, key, order, t, v, speed, level, sigma).where("residual is not null")
    r2 = F.col("residual") * F.col("residual")
    return d.groupBy(*key).agg(F.sum(-0.5 * (F.log(2 * pi * sigma * sigma * F.col("_dt")) + r2)).alias("quasi_loglik"), (sigma * sigma * F.sum(r2)).alias("least_squares"))


def fir(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, weights: Sequence[float], out: str) -> DataFrame:
    """df with the causal filter sum of weights[j] x[t - j]; what is before the first point counts as 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    total = F.lit(0.0)
    for j, c in enumerate(weights):
        total = total + c * (F.lag(v, j, 0.0).over(w) if j else F.col(v))
    return df.withColumn(out, total)


def band_pass(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, low: float, high: float, k: int, out: str) -> DataFrame:
    """Rows with k neighbours on both sides, with their component of periods low to high: symmetric weights that add up to 0."""
    from math import sin

    a, b = 2 * pi / high, 2 * pi / low
    weights = [(b - a) / pi] + [(sin(j * b) - sin(j * a)) / (pi * j) for j in range(1, k + 1)]
    shift = (weights[0] + 2 * sum(weights[1:])) / (2 * k + 1)
    w = Window.partitionBy(*key).orderBy(*order)
    total = (weights[0] - shift) * F.col(v)
    for j in range(1, k + 1):
        total = total + (weights[j] - shift) * (F.lag(v, j).over(w) + F.lead(v, j).over(w))
    return df.withColumn(out, total).where(F.col(out).isNotNull())
