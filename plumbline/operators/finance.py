"""Closed-form prices as columns, and Monte Carlo over generated paths."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .closed import normal_cdf
from .running import running, spread


def black_scholes(spot: Column, strike: Column, rate: Column, vol: Column, t: Column, call: bool = True) -> Column:
    d1 = (F.log(spot / strike) + (rate + vol * vol / 2) * t) / (vol * F.sqrt(t))
    d2 = d1 - vol * F.sqrt(t)
    s = 1 if call else -1
    return s * (spot * normal_cdf(s * d1) - strike * F.exp(-rate * t) * normal_cdf(s * d2))


def binomial_price(spot: float, strike: float, rate: float, vol: float, t: float, steps: int, call: bool = True, american: bool = False) -> float:
    """Cox-Ross-Rubinstein."""
    dt = t / steps
    u = exp(vol * sqrt(dt))
    p, d = (exp(rate * dt) - 1 / u) / (u - 1 / u), exp(-rate * dt)
    s = spot * u ** np.arange(-steps, steps + 1, 2.0)
    pay = lambda x: np.maximum(x - strike if call else strike - x, 0)
    v = pay(s)
    for i in range(steps, 0, -1):
        v = d * (p * v[1:] + (1 - p) * v[:-1])
        if american:
            v = np.maximum(v, pay(spot * u ** np.arange(-(i - 1), i, 2.0)))
    return float(v[0])


def gbm_paths(spark: SparkSession, n: int, steps: int, s0: float, mu: float, sigma: float, t: float, seed: int = 0) -> DataFrame:
    """(path_id, last, low, high, mean) of exact geometric Brownian paths; each path has a stream of its own (seed, path_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dt = t / steps
        for batch in batches:
            ids = np.asarray(batch.column(0))
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(steps) for i in ids]) if len(ids) else np.zeros((0, steps))
            x = s0 * np.exp(np.cumsum((mu - sigma**2 / 2) * dt + sigma * sqrt(dt) * z, axis=1))
            yield pa.RecordBatch.from_pydict({"path_id": pa.array(ids), "last": pa.array(x[:, -1]), "low": pa.array(x.min(1)), "high": pa.array(x.max(1)), "mean": pa.array(x.mean(1))})

    return spark.range(n).mapInArrow(run, "path_id long, last double, low double, high double, mean double")


def wasserstein_1d(df: DataFrame, v: str, side: str) -> DataFrame:
    """Distance of order 1 between the values with side 0 and those with side 1: the area between their CDFs."""
    by = df.groupBy(F.col(v).alias("x")).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("b"))
    n = by.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = running(by, ["x"], {"a": "ca", "b": "cb"}).join(F.broadcast(n)).select("x", F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")).alias("gap"))
    # the gap after x lasts until the next value: summed by parts, a row for each range partition is enough to join them
    inside = Window.partitionBy("_p").orderBy("x")
    c = spread(c, ["x"]).withColumn("next", F.lead("x").over(inside))
    ends = c.groupBy("_p").agg(F.sum(F.col("gap") * (F.col("next") - F.col("x"))).alias("area"), F.min("x").alias("first"), F.max("x").alias("last"), F.max_by("gap", "x").alias("end"))
    after = F.lead("first").over(Window.orderBy("_p")) - F.col("last")
    return ends.select((F.coalesce("area", F.lit(0.0)) + F.coalesce(after * F.col("end"), F.lit(0.0))).alias("part")).agg(F.sum("part").alias("wasserstein"))
