"""Curves over a score, and scores relative to a null model; nothing is gathered but counts by distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from .running import quantiles, running


def _counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tp, fp): positives and negatives with at least each distinct score."""
    ok = df.where(finite(F.col(y).cast("double")) & finite(F.col(score).cast("double")))
    by = ok.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.round(y) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.round(y) > 0, 0).otherwise(1)).alias("neg"))
    return running(by, ["threshold"], {"pos": "tp", "neg": "fp"}, descending=True)


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr): a point for each distinct score and (infinity, 0, 0); empty unless both classes occur."""
    c = _counts(df, y, score)
    n = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 and n > 0")
    points = c.join(F.broadcast(n)).select(F.col("threshold").cast("double").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    return points.union(n.select(F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))


def det_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, fnr) of the same points."""
    return roc_curve(df, y, score).select("threshold", "fpr", (1 - F.col("tpr")).alias("fnr"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall): a point for each distinct score; empty without positives."""
    c = _counts(df, y, score)
    n = c.agg(F.sum("pos").alias("p")).where("p > 0")
    return c.join(F.broadcast(n)).select(F.col("threshold").cast("double").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def _pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(finite(F.col(y).cast("double")) & finite(F.col(p).cast("double"))).select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))


def tweedie_unit(y: Column, mu: Column, power: float) -> Column:
    """Unit deviance of the Tweedie family."""
    if power == 0:
        return (y - mu) * (y - mu)
    if power == 1:
        return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - y + mu)
    if power == 2:
        return 2 * (F.log(mu / y) + y / mu - 1)
    return 2 * (F.pow(F.greatest(y, F.lit(0.0)), 2 - power) / ((1 - power) * (2 - power)) - y * F.pow(mu, 1 - power) / (1 - power) + F.pow(mu, 2 - power) / (2 - power))


def tweedie(df: DataFrame, y: str, p: str, power: float) -> DataFrame:
    """One row: deviance and d2 (1 less its ratio to the deviance of the mean). Rows outside the family's range are left out."""
    d = _pairs(df, y, p)
    inside = (F.col("y") >= 0) & ((F.col("p") > 0) if power >= 1 else F.lit(True))
    mean = d.agg(F.avg("y").alias("m"))
    d = d.join(F.broadcast(mean))
    s = d.agg(F.avg(F.when(inside, tweedie_unit(F.col("y"), F.col("p"), power))).alias("deviance"),
              F.avg(F.when(F.col("y") >= 0, tweedie_unit(F.col("y"), F.col("m"), power))).alias("null"))
    return s.select("deviance", F.when(F.abs("null") > 1e-18, 1 - F.col("deviance") / F.col("null")).alias("d2"))


def relative_errors(df: DataFrame, y: str, p: str, tau: float = 0.9) -> DataFrame:
    """One row: d2_absolute (to the median), d2_pinball (to the quantile tau), log_cosh, smape (0/0 left out), rmsle."""
    d = _pairs(df, y, p)
    median, quantile = quantiles(d, F.col("y"), [0.5, tau])
    e, q = F.col("y") - F.col("p"), F.col("y") - F.lit(quantile).cast("double")
    loss = lambda e: F.when(e >= 0, tau * e).otherwise((tau - 1) * e)
    size = F.abs("y") + F.abs("p")
    gap = F.log1p("y") - F.log1p("p")
    # log cosh without overflow
    cosh = F.abs(e) + F.log1p(F.exp(-2 * F.abs(e))) - F.log(F.lit(2.0))
    return d.agg((1 - F.sum(F.abs(e)) / F.nullif(F.sum(F.abs(F.col("y") - F.lit(median).cast("double"))), F.lit(0.0))).alias("d2_absolute"),
                 (1 - F.sum(loss(e)) / F.nullif(F.sum(loss(q)), F.lit(0.0))).alias("d2_pinball"), F.avg(cosh).alias("log_cosh"),
                 F.avg(F.when(size > 0, 2 * F.abs(e) / size)).alias("smape"), F.sqrt(F.avg(F.when((F.col("y") > -1) & (F.col("p") > -1), gap * gap))).alias("rmsle"))


def label_errors(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row of two labelings: zero_one and hamming loss, and the pair counts tp, fp, fn with the Fowlkes-Mallows score."""
    c = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    whole = c.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("ok"), F.sum(two(F.col("n"))).alias("tp"))
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"_{k}"))
    s = whole.join(side("a")).join(side("b"))
    return s.select((1 - F.col("ok") / F.col("t")).alias("zero_one"), (1 - F.col("ok") / F.col("t")).alias("hamming"), "tp", (F.col("_b") - F.col("tp")).alias("fp"), (F.col("_a") - F.col("tp")).alias("fn"),
                    F.when(F.col("_a") * F.col("_b") > 0, F.col("tp") / F.sqrt(F.col("_a") * F.col("_b"))).otherwise(0.0).alias("fowlkes_mallows"))


def ranked_labels(df: DataFrame, truth: str, scores: str, k: int) -> DataFrame:
    """One row over rows of an array of label flags and one of scores: top_k, average_precision, coverage, ranking_loss.

    Equal scores rank the lower column first; rows without labels are left out.
    """
    n = F.size(scores)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(truth, i).cast("int").alias("y"), F.get(scores, i).cast("double").alias("s"), i.alias("i")))
    d = df.where(F.col(truth).isNotNull() & F.col(scores).isNotNull() & (n > 0)).select(at.alias("x"))
    before = lambda a, b: (a["s"] > b["s"]) | ((a["s"] == b["s"]) & (a["i"] < b["i"]))
    rank = lambda l, xs: F.size(F.filter(xs, lambda o: before(o, l))) + 1
    mean = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, l: acc + f(l)) / F.size(xs)
    yes, no = F.filter("x", lambda l: l["y"] == 1), F.filter("x", lambda l: l["y"] != 1)
    d = d.select("x", yes.alias("yes"), no.alias("no")).where(F.size("yes") > 0)
    hit = F.exists("yes", lambda l: rank(l, F.col("x")) <= k).cast("double")
    precision = mean(F.col("yes"), lambda l: F.size(F.filter("yes", lambda o: ~before(l, o))) / rank(l, F.col("x")))
    worst = F.aggregate("yes", F.lit(0), lambda acc, l: F.greatest(acc, rank(l, F.col("x"))))
    wrong = F.aggregate("yes", F.lit(0.0), lambda acc, l: acc + F.size(F.filter("no", lambda o: o["s"] > l["s"])) + 0.5 * F.size(F.filter("no", lambda o: o["s"] == l["s"])))
    return d.agg(F.avg(hit).alias("top_k"), F.avg(precision).alias("average_precision"), F.avg(worst.cast("double")).alias("coverage"),
                 F.avg(F.when(F.size("no") > 0, wrong / (F.size("yes") * F.size("no")))).alias("ranking_loss"))
