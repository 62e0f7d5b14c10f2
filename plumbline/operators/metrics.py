"""Evaluation metrics as aggregations; each returns a one-row or a small long DataFrame.

Labels are rounded to integers, rows with a null or non-finite value on either side are left out.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from .running import quantiles, running


def _labels(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(finite(F.col(y).cast("double")) & finite(F.col(p).cast("double"))).select(F.round(y).cast("long").alias("y"), F.round(p).cast("long").alias("p"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n)."""
    return _labels(df, y, p).groupBy("y", "p").agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) over the union of labels; empty denominators give 0."""
    c = confusion(df, y, p)
    sides = c.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(0).alias("side")), F.struct(F.col("p").alias("label"), F.lit(1).alias("side")))).alias("s"), "y", "p", "n")
    hit = F.col("y") == F.col("p")
    n = F.col("n")
    out = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(hit & (F.col("s.side") == 0), n).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & (F.col("s.side") == 1), n).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("s.side") == 0), n).otherwise(0)).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"support": F.col("tp") + F.col("fn"), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy, balanced_accuracy, kappa, mcc, precision, recall, f1 (of the larger of two labels, else macro)."""
    c = confusion(df, y, p).cache()
    margins_y = c.groupBy("y").agg(F.sum("n").alias("t")).withColumnRenamed("y", "label")
    margins_p = c.groupBy("p").agg(F.sum("n").alias("q")).withColumnRenamed("p", "label")
    m = margins_y.join(margins_p, "label", "full").na.fill(0)
    s = m.agg(F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    a = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("ok"))
    k = per_class(df, y, p)
    k = k.agg(F.count("*").alias("k"), F.max_by("precision", "label").alias("p2"), F.max_by("recall", "label").alias("r2"), F.max_by("f1", "label").alias("f2"), F.avg("precision").alias("pm"), F.avg("recall").alias("rm"), F.avg("f1").alias("fm"),
              F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"))
    n, ok, tq = F.col("n").cast("double"), F.col("ok").cast("double"), F.col("tq").cast("double")
    pe = tq / (n * n)
    two = F.col("k") == 2
    return a.join(s).join(k).select(
        (ok / n).alias("accuracy"), F.col("balanced").alias("balanced_accuracy"), ((ok / n - pe) / (1 - pe)).alias("kappa"),
        ((ok * n - tq) / F.sqrt((n * n - F.col("tt")) * (n * n - F.col("qq")))).alias("mcc"),
        F.when(two, F.col("p2")).otherwise(F.col("pm")).alias("precision"), F.when(two, F.col("r2")).otherwise(F.col("rm")).alias("recall"), F.when(two, F.col("f2")).otherwise(F.col("fm")).alias("f1"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: n, mse, rmse, mae, max_error, mape (rows of y = 0 left out), medae, r2, explained_variance, bias, msle."""
    d = df.where(finite(F.col(y).cast("double")) & finite(F.col(p).cast("double"))).select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).withColumn("e", F.col("y") - F.col("p"))
    e, yy = F.col("e"), F.col("y")
    positive = (yy > -1) & (F.col("p") > -1)
    log_gap = F.log1p(yy) - F.log1p(F.col("p"))
    median = quantiles(d, F.abs(e), [0.5])[0]
    return d.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_error"),
                 F.avg(F.when(yy != 0, F.abs(e / yy))).alias("mape"), F.lit(median).cast("double").alias("medae"),
                 (1 - F.avg(e * e) / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("r2"), (1 - F.var_pop("e") / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("explained_variance"),
                 F.avg(e).alias("bias"), F.avg(F.when(positive, log_gap * log_gap)).alias("msle"))


def pinball(df: DataFrame, y: str, p: str, tau: float = 0.5) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(F.when(e >= 0, tau * e).otherwise((tau - 1) * e)).alias("pinball"))


def deviance(df: DataFrame, y: str, p: str, power: int = 1) -> DataFrame:
    """Mean Poisson (1) or gamma (2) deviance."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    if power == 1:
        unit = 2 * (F.when(a > 0, a * F.log(a / b)).otherwise(0.0) - a + b)
        ok = (a >= 0) & (b > 0)
    else:
        unit = 2 * (a / b - F.log(a / b) - 1)
        ok = (a > 0) & (b > 0)
    return df.where(ok).agg(F.avg(unit).alias("deviance"))


def mid_ranks(df: DataFrame, score: str, out: str) -> DataFrame:
    """Rank of equal scores: the mean of their places. Counts by score are ranked, so rows of one score may be many."""
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    counts = running(counts, [score], {"_n": "_c"}).withColumn("_r", F.col("_c") - (F.col("_n") - 1) / 2)
    return df.join(counts.select(score, F.col("_r").alias(out)), score)


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Mann-Whitney with mid-ranks; null unless there are exactly two classes. Works on counts by score."""
    by = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.round(y) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    by = running(by, [score], {"n": "seen"}).withColumn("rank", F.col("seen") - (F.col("n") - 1) / 2)
    s = by.agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    neg = F.col("n") - F.col("p")
    return s.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Mean precision at each distinct score, weighted by recall gained; equal scores count together."""
    by = df.groupBy(score).agg(F.sum(F.when(F.round(y) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    by = running(by, [score], {"pos": "tp", "n": "seen"}, descending=True)
    return by.agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def probability(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: log_loss (clip 1e-15, y >= 0.5 is 1), brier, hinge (on 2p - 1)."""
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    one = F.col(y) >= 0.5
    return df.agg(F.avg(-F.when(one, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg(F.pow(F.col(p) - F.when(one, 1.0).otherwise(0.0), 2)).alias("brier"),
                  F.avg(F.greatest(F.lit(0.0), 1 - F.when(one, 1.0).otherwise(-1.0) * (2 * F.col(p) - 1))).alias("hinge"))


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, share) of uniform bins of the probability."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.when(F.col(y) >= 0.5, 1.0).otherwise(0.0)).alias("share"))


def clustering(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rand, ari, mi, nmi (geometric), homogeneity, completeness, v_measure of two labelings."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    ra = c.groupBy("a").agg(F.sum("n").alias("na"))
    rb = c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("t"))
    j = c.join(ra, "a").join(rb, "b").join(F.broadcast(total))
    s = j.agg(F.max("t").alias("t"), F.sum(two(F.col("n"))).alias("ij"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = ra.join(F.broadcast(total)).agg(F.sum(two(F.col("na"))).alias("ia"), F.sum(-F.col("na") / F.col("t") * F.log(F.col("na") / F.col("t"))).alias("ha"))
    hb = rb.join(F.broadcast(total)).agg(F.sum(two(F.col("nb"))).alias("ib"), F.sum(-F.col("nb") / F.col("t") * F.log(F.col("nb") / F.col("t"))).alias("hb"))
    r = s.join(ha).join(hb)
    ij, ia, ib, t = F.col("ij"), F.col("ia"), F.col("ib"), two(F.col("t"))
    hom, com = F.col("mi") / F.col("ha"), F.col("mi") / F.col("hb")
    return r.select(((t + 2 * ij - ia - ib) / t).alias("rand"), ((ij - ia * ib / t) / ((ia + ib) / 2 - ia * ib / t)).alias("ari"), F.col("mi"), (F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).alias("nmi"),
                    hom.alias("homogeneity"), com.alias("completeness"), (2 * hom * com / (hom + com)).alias("v_measure"))


def dcg(df: DataFrame, group: str, relevance: str, order: list, k: int) -> DataFrame:
    """(group, dcg, ndcg) of the first k by order; gain 2^rel - 1."""
    w = Window.partitionBy(group)
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    d = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_i", F.row_number().over(w.orderBy(F.desc(relevance))))
    d = d.groupBy(group).agg(F.sum(F.when(F.col("_r") <= k, gain / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1.0)).otherwise(0.0)).alias("ideal"))
    return d.select(group, "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def mase(df: DataFrame, key: str, order: list, y: str, p: str) -> DataFrame:
    """(key, mase): mean absolute error over the mean absolute step of y itself."""
    d = df.withColumn("_d", F.abs(F.col(y) - F.lag(y).over(Window.partitionBy(key).orderBy(*order))))
    return d.groupBy(key).agg((F.avg(F.abs(F.col(y) - F.col(p))) / F.nullif(F.avg("_d"), F.lit(0.0))).alias("mase"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of 6371.0088 km; degrees in."""
    r = lambda c: c * F.lit(pi / 180)
    h = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def scores_by_class(df: DataFrame, y: str, p: str, beta: float = 2.0) -> DataFrame:
    """(label, jaccard, f_beta, specificity) of each label; empty denominators give 0."""
    k = per_class(df, y, p)
    n = _labels(df, y, p).agg(F.count("*").alias("total"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    b2 = beta * beta
    tn = F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")
    return k.join(F.broadcast(n)).select("label", share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("jaccard"),
                                         share((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")).alias("f_beta"), share(tn, tn + F.col("fp")).alias("specificity"))


def kolmogorov_smirnov(df: DataFrame, y: str, score: str) -> DataFrame:
    """Largest gap between the score's distributions in the two classes; on counts by score."""
    by = df.groupBy(score).agg(F.sum(F.when(F.round(y) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.round(y) > 0, 0).otherwise(1)).alias("neg"))
    c = running(by, [score], {"pos": "cp", "neg": "cn"})
    s = c.agg(F.max("cp").alias("tp"), F.max("cn").alias("tn"))
    return c.join(F.broadcast(s)).agg(F.max(F.abs(F.col("cp") / F.col("tp") - F.col("cn") / F.col("tn"))).alias("ks"))
