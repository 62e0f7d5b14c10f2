"""Discrete naive Bayes: one aggregation by class, then a score for each class in row-local columns."""

from __future__ import annotations

from collections.abc import Sequence
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(df: DataFrame, scores: list[tuple[object, Column]], out: str, least: bool = False) -> DataFrame:
    """The class of the highest (or least) score, ties to the first."""
    best = None
    for label, s in scores:
        entry = F.struct(s.alias("s"), F.lit(label).alias("l"))
        better = entry["s"] < best["s"] if best is not None and least else entry["s"] > best["s"] if best is not None else None
        best = entry if best is None else F.when(better, entry).otherwise(best)
    return df.withColumn(out, best["l"])


def _classes(df: DataFrame, cols: Sequence[str], label: str, what) -> list:
    """A row for each class: few, as classes are."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"), *(F.sum(what(c)).alias(f"s_{c}") for c in cols)).orderBy("_l").collect()


def _weighted(cols: Sequence[str], weights: Sequence[float], start: float = 0.0) -> Column:
    out = F.lit(start)
    for c, w in zip(cols, weights):
        out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w)
    return out


def multinomial(df: DataFrame, cols: Sequence[str], label: str, alpha: float = 1.0, out: str = "predicted") -> DataFrame:
    """Counts by class with additive smoothing; null cells count as 0."""
    rows = _classes(df, cols, label, lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    total = sum(r["_n"] for r in rows)
    scores = []
    for r in rows:
        whole = sum(r[f"s_{c}"] for c in cols) + alpha * len(cols)
        scores.append((r["_l"], _weighted(cols, [log((r[f"s_{c}"] + alpha) / whole) for c in cols], log(r["_n"] / total))))
    return _best(df, scores, out)


def complement(df: DataFrame, cols: Sequence[str], label: str, alpha: float = 1.0, out: str = "predicted") -> DataFrame:
    """Log shares of all other classes' counts, each class's vector at unit length; the least score wins and no prior counts."""
    rows = _classes(df, cols, label, lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    all_ = {c: sum(r[f"s_{c}"] for r in rows) for c in cols}
    scores = []
    for r in rows:
        rest = {c: all_[c] - r[f"s_{c}"] + alpha for c in cols}
        whole = sum(rest.values())
        w = [log(rest[c] / whole) for c in cols]
        norm = sqrt(sum(x * x for x in w)) or 1.0
        scores.append((r["_l"], _weighted(cols, [x / norm for x in w])))
    return _best(df, scores, out, least=True)


def bernoulli(df: DataFrame, cols: Sequence[str], label: str, alpha: float = 1.0, threshold: float = 0.0, out: str = "predicted") -> DataFrame:
    """Shares of cells above the threshold by class."""
    above = lambda c: F.when(F.col(c) > threshold, 1.0).otherwise(0.0)
    rows = _classes(df, cols, label, above)
    total = sum(r["_n"] for r in rows)
    scores = []
    for r in rows:
        s = F.lit(log(r["_n"] / total))
        for c in cols:
            share = min(max((r[f"s_{c}"] + alpha) / (r["_n"] + 2 * alpha), 1e-15), 1 - 1e-15)
            s = s + F.when(F.col(c) > threshold, F.lit(log(share))).otherwise(F.lit(log(1 - share)))
        scores.append((r["_l"], s))
    return _best(df, scores, out)
