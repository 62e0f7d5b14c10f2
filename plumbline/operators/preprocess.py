"""Scalers, encoders, imputers and transformers: fit is one aggregation, transform is row-local.

A fitted transform holds a few numbers for each column, put into the plan as literals; dictionaries of
categories are DataFrames and are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement, pairwise
from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, only_finite
from .running import quantiles


@dataclass
class Affine:
    """x -> (x - centre) / scale for each column."""

    centre: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c]) for c in self.centre})

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: F.col(c) * F.lit(self.scale[c]) + F.lit(self.centre[c]) for c in self.centre})


def _facts(df: DataFrame, cols: Sequence[str], **aggs) -> dict[str, dict[str, float]]:
    row = df.agg(*(f(only_finite(F.col(c).cast("double"))).alias(f"{c}|{k}") for c in cols for k, f in aggs.items())).first()
    return {c: {k: row[f"{c}|{k}"] for k in aggs} for c in cols}


def standard_scaler(df: DataFrame, cols: Sequence[str], with_mean: bool = True, with_std: bool = True) -> Affine:
    """Sample standard deviation (n - 1); a zero or missing one scales by 1."""
    s = _facts(df, cols, mean=F.avg, std=F.stddev_samp)
    return Affine({c: (s[c]["mean"] or 0.0) if with_mean else 0.0 for c in cols}, {c: (s[c]["std"] or 1.0) if with_std else 1.0 for c in cols})


def min_max_scaler(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> Affine:
    """Onto [low, high]; a constant column goes to low."""
    s = _facts(df, cols, lo=F.min, hi=F.max)
    out = Affine({}, {})
    for c in cols:
        lo, hi = s[c]["lo"] or 0.0, s[c]["hi"] or 0.0
        span = hi - lo
        out.scale[c] = span / (high - low) if span > 2.3e-16 else float("inf")
        out.centre[c] = lo - low * out.scale[c] if span > 2.3e-16 else lo
    return out


def max_abs_scaler(df: DataFrame, cols: Sequence[str]) -> Affine:
    s = _facts(df, cols, top=lambda c: F.max(F.abs(c)))
    return Affine(dict.fromkeys(cols, 0.0), {c: s[c]["top"] or 1.0 for c in cols})


def robust_scaler(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Median and interquartile range, linear quantiles; a zero range scales by 1."""
    q = {c: quantiles(df, only_finite(F.col(c).cast("double")), [0.25, 0.5, 0.75]) for c in cols}
    return Affine({c: q[c][1] for c in cols}, {c: (q[c][2] - q[c][0] if q[c][1] is not None else 0.0) or 1.0 for c in cols})


def normalize(df: DataFrame, cols: Sequence[str], norm: str = "l2", suffix: str = "") -> DataFrame:
    """Rows divided by their l1, l2 or max norm; a zero row stays."""
    parts = [F.abs(F.col(c).cast("double")) for c in cols]
    if norm == "l1":
        size = sum(parts[1:], parts[0])
    elif norm == "l2":
        size = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    else:
        size = F.greatest(*parts) if len(parts) > 1 else parts[0]
    df = df.withColumn("_norm", F.when(size > 0, size).otherwise(F.lit(1.0)))
    return df.withColumns({c + suffix: F.col(c) / F.col("_norm") for c in cols}).drop("_norm")


def binarize(c: Column, threshold: float = 0.0) -> Column:
    return F.when(c > threshold, 1.0).otherwise(0.0)


def elementwise(c: Column, kind: str) -> Column:
    """identity, log1p, sqrt or abs; null outside the domain."""
    return {"identity": c, "log1p": F.when(c > -1, F.log1p(c)), "sqrt": F.when(c >= 0, F.sqrt(c)), "abs": F.abs(c)}[kind]


def levels(df: DataFrame, col: str) -> DataFrame:
    """(level, code) of the sorted distinct values; one task ranks the distinct levels, never the rows."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct().withColumn("code", F.row_number().over(Window.orderBy("level")) - 1)


def ordinal_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank of the value among its sorted distinct levels; nulls and unseen values get null."""
    codes = levels(df, col)
    return df.join(codes.select(F.col("level").alias(col), F.col("code").cast("double").alias(out)), col, "left")


def one_hot(df: DataFrame, col: str, drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    known = [r["level"] for r in levels(df, col).orderBy("code").collect()]  # as many as there will be columns
    return df.withColumns({f"{prefix or col}_{v}": F.when(F.col(col) == F.lit(v), 1.0).otherwise(0.0) for v in known[int(drop_first):]})


def label_binarize(df: DataFrame, col: str) -> DataFrame:
    return one_hot(df, col, prefix="is")


def target_encode(df: DataFrame, col: str, y: str, out: str, smooth: float = 1.0) -> DataFrame:
    """(sum of y + smooth * mean) / (n + smooth) of the category; unseen ones get the mean."""
    sums = df.where(finite(F.col(y))).groupBy(col).agg(F.sum(y).alias("_s"), F.count("*").alias("_n"))
    whole = sums.agg((F.sum("_s") / F.sum("_n")).alias("m")).first()["m"]
    code = sums.select(col, ((F.col("_s") + F.lit(smooth * whole)) / (F.col("_n") + F.lit(smooth))).alias(out))
    return df.join(code, col, "left").withColumn(out, F.coalesce(out, F.lit(whole)))


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Non-finite cells become the column's mean, median or most frequent value (ties: the smallest)."""
    if strategy == "most_frequent":
        fill = {}
        for c in cols:
            top = df.where(finite(F.col(c))).groupBy(c).count().orderBy(F.desc("count"), c).first()
            fill[c] = top[0] if top else None
    else:
        s = _facts(df, cols, v=F.avg) if strategy == "mean" else {c: {"v": quantiles(df, only_finite(F.col(c).cast("double")), [0.5])[0]} for c in cols}
        fill = {c: s[c]["v"] for c in cols}
    return df.withColumns({c: F.coalesce(only_finite(F.col(c)), F.lit(fill[c])) for c in cols})


def missing_indicator(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.when(finite(F.col(c)), 0.0).otherwise(1.0) for c in cols})


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """Monomials up to a degree, named by their factors."""
    out = {"bias": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for some in combinations_with_replacement(cols, d):
            if interaction_only and len(set(some)) < d:
                continue
            product = F.col(some[0]).cast("double")
            for c in some[1:]:
                product = product * F.col(c)
            out["*".join(some)] = product
    return df.select("*", *(v.alias(k) for k, v in out.items() if k not in df.columns))


def k_bins(df: DataFrame, col: str, n: int, out: str, strategy: str = "uniform") -> DataFrame:
    """Bin 0 to n - 1 between uniform or quantile edges."""
    if strategy == "uniform":
        s = _facts(df, [col], lo=F.min, hi=F.max)[col]
        edges = [s["lo"] + (s["hi"] - s["lo"]) * i / n for i in range(1, n)]
    else:
        edges = quantiles(df, only_finite(F.col(col).cast("double")), [i / n for i in range(1, n)])
    place = F.lit(0)
    for e in edges:
        place = place + F.when(F.col(col) >= F.lit(e), 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(col).isNotNull(), place))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def power_transform(df: DataFrame, col: str, out: str) -> tuple[DataFrame, float]:
    """Yeo-Johnson with the exponent that is likeliest on the grid -2, -1.8 .. 2; all candidates in one aggregation."""
    grid = [round(-2 + 0.2 * i, 10) for i in range(21)]
    x = only_finite(F.col(col).cast("double"))
    row = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), *(F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid))).first()
    score = {g: -0.5 * row["n"] * log(2 * pi * row[f"v{i}"]) + (g - 1) * row["j"] for i, g in enumerate(grid) if (row[f"v{i}"] or 0) > 0}
    best = max(score, key=lambda g: (score[g], -abs(g - 1))) if score else 1.0
    return df.withColumn(out, yeo_johnson(F.col(col).cast("double"), best)), best


def quantile_transform(df: DataFrame, col: str, out: str, knots: int = 1000) -> DataFrame:
    """Piecewise linear empirical CDF over min(knots, rows) quantiles, clipped to [1e-6, 1 - 1e-6]; null where the value is."""
    x = only_finite(F.col(col).cast("double"))
    k = min(knots, df.agg(F.count(x)).first()[0])
    if k < 2:
        return df.withColumn(out, F.when(x.isNotNull(), F.lit(0.5)))
    q = quantiles(df, x, [i / (k - 1) for i in range(k)])
    known = F.array(*map(F.lit, q))
    # binary search: the last knot at or below the value
    steps = [1 << i for i in range(k.bit_length() - 1, -1, -1)]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s < k) & (F.get(known, at + s) <= x), at + s).otherwise(at))
    a, b = F.get(known, place), F.get(known, F.least(place + 1, F.lit(k - 1)))
    value = (place + F.when(b > a, (x - a) / (b - a)).otherwise(0.0)) / F.lit(k - 1.0)
    return df.withColumn(out, F.when(x.isNotNull(), F.least(F.greatest(value, F.lit(1e-6)), F.lit(1 - 1e-6))))
