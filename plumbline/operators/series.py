"""Ordered series: online statistics, realised measures, ticks, as-of and interval joins.

All functions take a key (or none) and an explicit order. Recursions that have a closed form over
a window or a fold stay in the engine; the others run once for each key in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import cos, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, ln, ratio
from .running import spread


def moments(df: DataFrame, key: Sequence[str], v: str) -> DataFrame:
    """(key, n, mean, variance, std, skew, kurtosis, low, high): variance null below two values."""
    x = F.when(finite(F.col(v)), F.col(v))
    return df.groupBy(*key).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"),
                                F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("low"), F.max(x).alias("high"))


def weighted_mean(df: DataFrame, key: Sequence[str], v: str, w: str) -> DataFrame:
    return df.groupBy(*key).agg((F.sum(F.col(v) * F.col(w)) / F.nullif(F.sum(w), F.lit(0.0))).alias("mean"), (F.pow(F.sum(w), 2) / F.sum(F.col(w) * F.col(w))).alias("n_eff"))


def covariance(df: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*key).agg(F.covar_samp(a, b).alias("covariance"), F.corr(a, b).alias("correlation"))


def autocorrelation(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, lag: int = 1) -> DataFrame:
    """Correlation of v with its lag, each side about its own mean; null below three values or without variation."""
    d = df.withColumn("_l", F.lag(v, lag).over(Window.partitionBy(*key).orderBy(*order)))
    n = F.count(F.when(F.col("_l").isNotNull(), 1))
    return d.groupBy(*key).agg(F.when((F.count("*") >= 3) & (n >= 2), F.corr(F.when(F.col("_l").isNotNull(), F.col(v)), F.col("_l"))).alias("autocorrelation"))


def exponentially_weighted(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, alpha: float) -> DataFrame:
    """(key, ew_mean, ew_variance, n_eff) after the last value: m <- alpha x + (1 - alpha) m, from the first value on.

    The closed weights alpha (1 - alpha)^(n - i) make it one ranked sum, and the recursive variance is the values' variance
    under them; it is taken about the key's mean, so that large levels do not cancel.
    """
    w = Window.partitionBy(*key)
    d = df.where(finite(F.col(v))).withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    weight = F.when(F.col("_i") == 1, F.pow(F.lit(1 - alpha), F.col("_n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i")))
    d = d.withColumn("_w", weight).withColumn("_c", F.avg(v).over(w)).withColumn("_z", F.col(v) - F.col("_c"))
    z = F.sum(F.col("_w") * F.col("_z"))
    return d.groupBy(*key).agg((F.first("_c") + z).alias("ew_mean"), (F.sum(F.col("_w") * F.col("_z") * F.col("_z")) - z * z).alias("ew_variance"), (1 / F.sum(F.col("_w") * F.col("_w"))).alias("n_eff"))


def returns(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, out: str = "r", log: bool = True) -> DataFrame:
    x = ln(F.col(v)) if log else F.col(v)
    return df.withColumn("_x", x).withColumn(out, F.col("_x") - F.lag("_x").over(Window.partitionBy(*key).orderBy(*order))).drop("_x")


def realised(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """(key, rv, bipower, quarticity, quadpower) of the increments of log v, infinite or NaN where v is 0.

    bipower = pi/2 sum |r_i||r_i-1|; quarticity = n/3 sum r^4; quadpower = n / mu1^4 times the sum of
    products of four neighbours.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    d = returns(df, key, order, v).where(F.col("r").isNotNull())
    a = lambda k: F.abs(F.lag("r", k).over(w))
    d = d.select(*key, "r", (F.abs("r") * a(1)).alias("_b"), (F.abs("r") * a(1) * a(2) * a(3)).alias("_q"))
    mu1 = sqrt(2 / pi)
    return d.groupBy(*key).agg(F.sum(F.col("r") * F.col("r")).alias("rv"), (pi / 2 * F.sum("_b")).alias("bipower"), (F.count("*") / 3 * F.sum(F.pow("r", F.lit(4)))).alias("quarticity"), (F.count("*") / mu1**4 * F.sum("_q")).alias("quadpower"))


def roll_spread(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """2 sqrt(-cov) of successive changes, 0 where their covariance is not negative."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_d", F.col(v) - F.lag(v).over(w)).withColumn("_e", F.lag("_d").over(w)).where(F.col("_e").isNotNull())
    return d.groupBy(*key).agg(F.covar_samp("_d", "_e").alias("_c")).select(*key, F.when(F.col("_c") < 0, 2 * F.sqrt(-F.col("_c"))).otherwise(0.0).alias("spread"))


def kyle_lambda(df: DataFrame, key: Sequence[str], order: Sequence[str], price: str, flow: str) -> DataFrame:
    """Slope of price changes on signed flow."""
    d = df.withColumn("_d", F.col(price) - F.lag(price).over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_d").isNotNull())
    return d.groupBy(*key).agg(F.regr_slope("_d", flow).alias("lambda"))


def durations(df: DataFrame, key: Sequence[str], t: str) -> DataFrame:
    d = df.withColumn("_d", F.col(t) - F.lag(t).over(Window.partitionBy(*key).orderBy(t))).where(F.col("_d").isNotNull())
    return d.groupBy(*key).agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.max("_d").alias("longest"))


def asof(left: DataFrame, right: DataFrame, t: str, v: str, out: str, key: Sequence[str] = ()) -> DataFrame:
    """Previous-tick join: each left row gets the last right value at or before its time (null before the first).

    A union and one window by key instead of a range join: each row is shuffled once. Without a key rows are dealt to ranges
    of time, and the last value of each range is carried to those after it.
    """
    one = left.select(*key, t, F.lit(1).alias("_s"), F.lit(None).cast("double").alias("_v"), F.struct(*left.columns).alias("_row"))
    two = right.select(*key, t, F.lit(0).alias("_s"), F.col(v).cast("double").alias("_v"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"))
    if not key:
        both = spread(one.union(two), [t, "_s"])
        inside = Window.partitionBy("_p").orderBy(t, "_s").rowsBetween(Window.unboundedPreceding, 0)
        ends = both.groupBy("_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(t, "_s"))).alias("_e"))
        ends = ends.select(F.col("_p").alias("_q"), F.last("_e", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_e"))
        here = both.withColumn("_l", F.last("_v", ignorenulls=True).over(inside)).where("_s = 1")
        return here.join(F.broadcast(ends), F.col("_p") == F.col("_q")).select("_row.*", F.coalesce("_l", "_e").alias(out))
    w = Window.partitionBy(*key).orderBy(t, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return one.union(two).withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_s = 1").select("_row.*", out)


def interval_join(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Pairs of rows of a (a0, a1, ..) and b (b0, b1, ..) whose open intervals overlap.

    Intervals are dealt to buckets of a time width and joined by bucket; a pair counts in the bucket that holds the
    later of the two starts, so once.
    """
    spread = lambda d, s, e: d.withColumn("_k", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    j = spread(a, "a0", "a1").join(spread(b, "b0", "b1"), "_k")
    return j.where("a0 < b1 AND b0 < a1").where(F.floor(F.greatest("a0", "b0") / width) == F.col("_k")).drop("_k")


def intervals(ticks: DataFrame, series: str, t: str, v: str, prefix: str) -> DataFrame:
    """Increments of one series as (p0, p1, dp)."""
    w = Window.partitionBy(series).orderBy(t)
    d = ticks.withColumn("_t", F.lag(t).over(w)).withColumn("_v", F.lag(v).over(w)).where("_t is not null")
    return d.select(F.col("_t").alias(f"{prefix}0"), F.col(t).alias(f"{prefix}1"), (F.col(v) - F.col("_v")).alias(f"d{prefix}"))


def hayashi_yoshida(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Covariance of two series on clocks of their own: products of increments whose intervals overlap."""
    return interval_join(a, b, width).agg(F.sum(F.col("da") * F.col("db")).alias("covariance"))


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """(key, longest_rise, crossings): the longest run of rises and the number of crossings of the key's mean.

    The mean is summed in the order of the series: where it equals a value but for its last bit, that order decides on which side the value lies.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_m", F.avg(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_up", (F.col(v) > F.lag(v).over(w)).cast("int"))
    d = d.withColumn("_s", F.signum(F.col(v) - F.col("_m"))).withColumn("_c", (F.col("_s") != F.lag("_s").over(w)).cast("int"))
    d = d.withColumn("_g", F.sum(F.when(F.col("_up") == 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = d.groupBy(*key, "_g").agg(F.sum(F.coalesce("_up", F.lit(0))).alias("_l"), F.sum(F.coalesce("_c", F.lit(0))).alias("_x"))
    return length.groupBy(*key).agg(F.max("_l").cast("long").alias("longest_rise"), F.sum("_x").cast("long").alias("crossings"))


def per_key(df: DataFrame, key: str, order: Sequence[str], schema: str, kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run an order-dependent kernel once for each key; its input is sorted, its output has the key in front."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = kernel(part.sort_values(list(order)))
        out.insert(0, key, part[key].iloc[0])
        return out

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def autocorrelations(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, lags: int) -> DataFrame:
    """(key, lag, acf): lagged products about the key's mean over its sum of squares."""
    w = Window.partitionBy(*key)
    d = df.withColumn("_z", F.col(v) - F.avg(v).over(w))
    d = d.select(*key, F.col("_z").alias("_0"), *(F.lag("_z", k).over(w.orderBy(*order)).alias(f"_{k}") for k in range(1, lags + 1)))
    sums = d.groupBy(*key).agg(F.sum(F.col("_0") * F.col("_0")).alias("_s"), *(F.sum(F.col("_0") * F.col(f"_{k}")).alias(f"_p{k}") for k in range(1, lags + 1)))
    return sums.select(*key, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"_p{k}") / F.nullif(F.col("_s"), F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)))).alias("_k")).select(*key, "_k.lag", "_k.acf")


def histogram(df: DataFrame, v: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of equal widths; the last bin holds its upper end, what is outside is left out."""
    b = F.least(F.floor((F.col(v) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where((F.col(v) >= low) & (F.col(v) <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def mid_price(bid: DataFrame, ask: DataFrame, t: str, v: str) -> DataFrame:
    """(t, mid): the mean of the last bid and the last ask at each time of either; null before both are known."""
    clock = bid.select(t).union(ask.select(t)).distinct()
    both = asof(asof(clock, bid, t, v, "_bid"), ask, t, v, "_ask")
    return both.select(t, ((F.col("_bid") + F.col("_ask")) / 2).alias("mid"))


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """The quotes weighted by the size on the other side."""
    share = bid_size / F.greatest(bid_size + ask_size, F.lit(1e-12))
    return share * ask + (1 - share) * bid


def order_flow(df: DataFrame, key: Sequence[str], order: Sequence[str], bid: str, ask: str, bid_size: str, ask_size: str, out: str = "ofi") -> DataFrame:
    """df with the order-flow imbalance of each quote against the one before; null at the first of a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    b, a, qb, qa = (F.col(c) for c in (bid, ask, bid_size, ask_size))
    b0, a0, qb0, qa0 = (F.lag(c).over(w) for c in (bid, ask, bid_size, ask_size))
    buy = F.when(b > b0, qb).when(b == b0, qb - qb0).otherwise(-qb0)
    sell = F.when(a < a0, -qa).when(a == a0, qa0 - qa).otherwise(qa0)
    return df.withColumn(out, F.when(b0.isNotNull(), buy + sell))


def jump_test(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """(key, qv, bv, jump, statistic): realised variance against bipower variation, of the increments of log v."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = returns(df, key, order, v, "_r").withColumn("_b", F.abs("_r") * F.abs(F.lag("_r").over(w)))
    s = d.groupBy(*key).agg(F.sum(F.col("_r") * F.col("_r")).alias("qv"), (F.sum("_b") * (pi / 2)).alias("bv"), F.count("_r").alias("_n"), F.sum(F.pow("_r", F.lit(4.0))).alias("_q"))
    scale = F.sqrt((pi * pi / 4 + pi - 5) * F.col("_n") / 3 * F.col("_q")) / F.sqrt("_n")
    return s.select(*key, "qv", "bv", F.greatest(F.col("qv") - F.col("bv"), F.lit(0.0)).alias("jump"), ratio(F.col("qv") - F.col("bv"), scale).alias("statistic"))


def realised_kernel(df: DataFrame, key: Sequence[str], order: Sequence[str], v: str, bandwidth: int) -> DataFrame:
    """(key, realised_kernel): autocovariances of the increments of log v under Tukey-Hanning weights, 0 at least."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = returns(df, key, order, v, "_r")
    d = d.withColumns({f"_g{h}": F.col("_r") * F.lag("_r", h).over(w) if h else F.col("_r") * F.col("_r") for h in range(bandwidth + 1)})
    total = F.sum("_g0")
    for h in range(1, bandwidth + 1):
        total = total + 2 * F.lit(0.5 * (1 + cos(pi * (h - 1) / bandwidth))) * F.coalesce(F.sum(f"_g{h}"), F.lit(0.0))
    return d.groupBy(*key).agg(F.greatest(total, F.lit(0.0)).alias("realised_kernel"))


def realised_covariance(df: DataFrame, key: Sequence[str], order: Sequence[str], a: str, b: str) -> DataFrame:
    """(key, variance_a, variance_b, covariance): sums of products of the increments."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_a", F.col(a) - F.lag(a).over(w)).withColumn("_b", F.col(b) - F.lag(b).over(w))
    return d.groupBy(*key).agg(F.sum(F.col("_a") * F.col("_a")).alias("variance_a"), F.sum(F.col("_b") * F.col("_b")).alias("variance_b"), F.sum(F.col("_a") * F.col("_b")).alias("covariance"))
