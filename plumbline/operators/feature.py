"""Feature scores, selection and lagged features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import only_finite
from ..functions.special import column, f_pvalue


def _long(row, cols: Sequence[str], keys: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame([(c, *(row[f"{c}|{k}"] for k in keys)) for c in cols], "feature string, " + ", ".join(f"{k} double" for k in keys))


def stack(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """Long form (keep.., feature, x)."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols))).alias("_f")).select(*keep, "_f.feature", "_f.x")


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*(F.coalesce(F.var_samp(only_finite(F.col(c).cast("double"))), F.lit(0.0)).alias(f"{c}|variance") for c in cols)).first()
    return _long(row, cols, ["variance"], df.sparkSession)


def variance_threshold(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> list[str]:
    return [r["feature"] for r in variances(df, cols).collect() if r["variance"] > threshold]


def f_classif(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """One-way analysis of variance of each column over the classes: (feature, score, pvalue)."""
    by = stack(df.where(F.col(y).isNotNull()), cols, y).groupBy("feature", y).agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("within"))
    whole = by.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("within").alias("within"),
                                      (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    whole = whole.withColumn("score", (F.col("between") / d1) / (F.col("within") / d2))
    return whole.select("feature", "score", column(f_pvalue, F.col("score"), d1, d2).alias("pvalue"))


def f_regression(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2) of each column: (feature, score, pvalue)."""
    long = stack(df, cols, y).groupBy("feature").agg(F.corr("x", y).alias("r"), F.count("*").alias("n"))
    long = long.withColumn("score", F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2))
    return long.select("feature", "score", column(f_pvalue, F.col("score"), F.lit(1.0), (F.col("n") - 2).cast("double")).alias("pvalue"))


def select_k_best(df: DataFrame, cols: Sequence[str], y: str, k: int) -> list[str]:
    """The k columns of largest squared correlation (ties: column order), at least one."""
    score = {r["feature"]: r["score"] or 0.0 for r in f_regression(df, cols, y).collect()}
    return sorted(sorted(cols, key=lambda c: (-score[c], cols.index(c)))[: max(1, k)], key=cols.index)


def select_by_p(df: DataFrame, cols: Sequence[str], y: str, alpha: float = 0.05, how: str = "fpr") -> list[str]:
    """Columns with p under alpha: as they are (fpr), Bonferroni (fwe) or Benjamini-Hochberg (fdr)."""
    p = {r["feature"]: r["pvalue"] for r in f_regression(df, cols, y).collect()}
    ranked = sorted(cols, key=lambda c: p[c])
    if how == "fdr":
        last = max((i for i, c in enumerate(ranked, 1) if p[c] <= alpha * i / len(cols)), default=0)
        return sorted(ranked[:last], key=cols.index)
    return [c for c in cols if p[c] < (alpha / len(cols) if how == "fwe" else alpha)]


def chi2(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Sum of (observed - expected)^2 / expected of column sums by class; null for a column with negatives."""
    long = stack(df, cols, y)
    by = long.groupBy("feature", y).agg(F.sum("x").alias("o"), F.count("*").alias("n"), F.min("x").alias("low"))
    w = Window.partitionBy("feature")
    by = by.withColumn("e", F.sum("o").over(w) * F.col("n") / F.sum("n").over(w))
    return by.groupBy("feature").agg(F.when(F.min("low") >= 0, F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))).alias("score"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in nats of two discrete columns."""
    j = df.groupBy(x, y).agg(F.count("*").alias("n"))
    j = j.withColumn("nx", F.sum("n").over(Window.partitionBy(x))).withColumn("ny", F.sum("n").over(Window.partitionBy(y)))
    total = j.agg(F.sum("n").alias("t"))
    return j.join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def lag_features(df: DataFrame, y: str, lags: Sequence[int], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({f"{y}_lag{k}": F.lag(y, k).over(w) for k in lags})


def rolling_mean(df: DataFrame, y: str, window: int, key: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Trailing mean, null until the window is full; non-finite values are skipped."""
    w = Window.partitionBy(*key).orderBy(*order)
    inside = w.rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(inside) >= window, F.avg(only_finite(F.col(y))).over(inside)))
