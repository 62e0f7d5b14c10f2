"""Seeded splits, moving windows and cross-validation of linear models.

Shuffles order rows by a hash of (seed, key), so that they are the same in every partitioning; ranks are taken in range
partitions. Cross-validated fits need one scan: a fold's products are subtracted from the total.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import Gram, gram, ridge
from .metrics import _labels
from .running import running
from .splits import ranked


def shuffled(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))


def train_test_split(df: DataFrame, key: Sequence[str], share: float, seed: int = 0, out: str = "test") -> DataFrame:
    """df with a flag: round(share n) rows, one at least and not all, are tests. key must be unique; one row trains."""
    n = df.count()
    size = min(max(int(share * n + 0.5), 1), n - 1)
    return ranked(df.withColumn("_h", shuffled(key, seed)), ["_h", *key], "_i").withColumn(out, F.col("_i") < size).drop("_h", "_i")


def shuffle_splits(df: DataFrame, key: Sequence[str], share: float, splits: int, seed: int = 0) -> DataFrame:
    """df once for each split, with (split, test); split s is the shuffle of seed + s."""
    parts = [train_test_split(df, key, share, seed + s).withColumn("split", F.lit(s)) for s in range(splits)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stratified_shuffle(df: DataFrame, label: str, key: Sequence[str], share: float, seed: int = 0, out: str = "test") -> DataFrame:
    """Like train_test_split inside each class; classes of one row train."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    one = running(df.withColumn("_h", shuffled(key, seed)).withColumn("_one", F.lit(1)), ["_h", *key], {"_one": "_i"}, [label])
    size = F.least(F.greatest(F.floor(share * F.col("_n") + 0.5), F.lit(1)), F.col("_n") - 1)
    return one.join(F.broadcast(n), F.col(label).eqNullSafe(F.col("_l"))).withColumn(out, F.col("_i") <= size).drop("_h", "_one", "_i", "_n", "_l")


def group_shuffle(df: DataFrame, group: str, share: float, seed: int = 0, out: str = "test") -> DataFrame:
    """A shuffled share of the groups (0.05 to 0.5 of them) are tests; no group is torn."""
    groups = train_test_split(df.select(group).distinct(), [group], min(max(share, 0.05), 0.5), seed, out)
    return df.join(groups, group)


def temporal_split(df: DataFrame, order: Sequence[str], share: float, out: str = "test") -> DataFrame:
    """The last round(share n) rows by order are tests."""
    n = df.count()
    size = min(max(int(share * n + 0.5), 1), max(n - 1, 1))
    return ranked(df, list(order), "_i").withColumn(out, F.col("_i") >= n - size).drop("_i")


def sliding_windows(df: DataFrame, order: Sequence[str], window: int, horizon: int, step: int = 1) -> DataFrame:
    """df with (split, test): split s trains on `window` rows from s * step on and is tested by the `horizon` rows after them.

    A row comes once for each split that it is in, (window + horizon) / step times at most; no split is cut short.
    """
    splits = (df.count() - window - horizon) // step + 1
    if splits < 1:
        return df.withColumn("split", F.lit(0).cast("long")).withColumn("test", F.lit(False)).limit(0)
    i = F.col("_i")
    first = F.greatest(F.lit(0), F.ceil((i - window - horizon + 1) / step)).cast("long")
    last = F.least(F.lit(splits - 1), F.floor(i / step)).cast("long")
    out = ranked(df, list(order), "_i").where(first <= last).withColumn("split", F.explode(F.sequence(first, last)))
    return out.withColumn("test", i >= F.col("split") * step + window).drop("_i")


def expanding_windows(df: DataFrame, order: Sequence[str], initial: int, horizon: int, step: int) -> DataFrame:
    """The test rows with (split, train_size): split s trains on all rows before initial + s * step. Training rows are not repeated."""
    splits = (df.count() - initial - horizon) // step + 1
    i = F.col("_i")
    first = F.greatest(F.lit(0), F.ceil((i - initial - horizon + 1) / step)).cast("long")
    last = F.least(F.lit(splits - 1), F.floor((i - initial) / step)).cast("long")
    out = ranked(df, list(order), "_i").where((i >= initial) & (first <= last)).withColumn("split", F.explode(F.sequence(first, last)))
    return out.withColumn("train_size", F.col("split") * step + initial).drop("_i")


def _whole(folds: dict) -> Gram:
    gs = list(folds.values())
    w = sum(g.weight for g in gs)
    raw, mean = sum(g.raw() for g in gs), sum(g.weight * g.mean for g in gs) / w
    return Gram(gs[0].names, sum(g.n for g in gs), w, mean, raw - w * np.outer(mean, mean), 0)


def cross_validated(df: DataFrame, xs: Sequence[str], y: str, fold: str, lam: float = 0.0) -> dict:
    """{fold: (fit on the other folds, r2 on this one)}; r2 is nan where the fold's target does not vary."""
    folds, p = gram(df, [*xs, y], by=fold), len(xs)
    whole, out = _whole(folds), {}
    for k, g in sorted(folds.items()):
        f = ridge(df, xs, y, lam, whole - g).value
        d = g.mean[p] - f.intercept - f.coef @ g.mean[:p]
        sse = g.cross[p, p] - 2 * f.coef @ g.cross[:p, p] + f.coef @ g.cross[:p, :p] @ f.coef + g.weight * d * d
        out[k] = (f, float(1 - sse / g.cross[p, p]) if g.cross[p, p] > 0 else float("nan"))
    return out


def cross_val_predict(df: DataFrame, xs: Sequence[str], y: str, fold: str, lam: float = 0.0, out: str = "predicted") -> DataFrame:
    """df with each row's prediction by the fit that has not seen its fold."""
    at: Column = F.lit(None).cast("double")
    for k, (f, _) in cross_validated(df, xs, y, fold, lam).items():
        at = F.when(F.col(fold) == k, f.predict()).otherwise(at)
    return df.withColumn(out, at)


def likelihood_ratios(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: positive and negative likelihood ratios of two classes, the larger label being positive; infinite on an empty base."""
    c = _labels(df, y, p)
    top = c.agg(F.max(F.greatest("y", "p")).alias("one"))
    is_y, is_p = F.col("y") == F.col("one"), F.col("p") == F.col("one")
    s = c.join(F.broadcast(top)).agg(F.avg(F.when(is_y, is_p.cast("double"))).alias("tpr"), F.avg(F.when(~is_y, is_p.cast("double"))).alias("fpr"))
    over = lambda a, b: F.when(b > 1e-18, a / b).otherwise(float("inf"))
    return s.select(over(F.col("tpr"), F.col("fpr")).alias("positive"), over(1 - F.col("tpr"), 1 - F.col("fpr")).alias("negative"))


def multilabel_confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tn, fp, fn, tp) of arrays of flags; over 0.5 is true."""
    d = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("label", "x"))
    t, p = F.col("x.t") > 0.5, F.col("x.p") > 0.5
    n = lambda c: F.count_if(c)
    return d.groupBy(F.col("label").cast("long").alias("label")).agg(n(~t & ~p).alias("tn"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(t & p).alias("tp"))


def roc_auc_by_class(df: DataFrame, label: str, scores: str) -> DataFrame:
    """(label, roc_auc) of each class's own score against all others, by mid-ranks of counts by score; their mean is the macro score."""
    d = df.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), F.posexplode(scores).alias("label", "s"))
    by = d.groupBy(F.col("label").cast("long").alias("label"), F.col("s").cast("double").alias("s")).agg(F.count_if(F.col("y") == F.col("label")).alias("pos"), F.count("*").alias("n"))
    by = running(by, ["s"], {"n": "seen"}, ["label"]).withColumn("rank", F.col("seen") - (F.col("n") - 1) / 2)
    s = by.groupBy("label").agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    neg = F.col("n") - F.col("p")
    return s.where((F.col("p") > 0) & (neg > 0)).select("label", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("roc_auc"))


def expanding_slope(df: DataFrame, key: Sequence[str], order: Sequence[str], x: str, y: str, least: int, out: str = "slope") -> DataFrame:
    """df with the slope of y on x over the key's rows up to this one; null below `least` rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.count("*").over(w) >= least, F.covar_pop(y, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0))))
