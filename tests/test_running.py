"""Running sums, order statistics, curves, ticks and discrete naive Bayes against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bayes, curves, metrics, paths, preprocess, running, selection, series, splits


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random() * 10]), rng.randrange(3), rng.random() < 0.4) for i in range(400)]
    return rows, spark.createDataFrame(rows, "i long, x double, g int, y boolean").repartition(7).withColumn("y", F.col("y").cast("int"))


def test_running_sums(numbers):
    rows, df = numbers
    got = {r["i"]: r["s"] for r in running.running(df, ["i"], {"x": "s"}).collect()}
    total = 0.0
    for i, x, _, _ in rows:
        total += x or 0
        assert abs(got[i] - total) < 1e-9
    got = {r["i"]: r["s"] for r in running.running(df, ["i"], {"x": "s"}, ["g"]).collect()}
    sums = [0.0] * 3
    for i, x, g, _ in rows:
        sums[g] += x or 0
        assert abs(got[i] - sums[g]) < 1e-9
    assert running.running(df.where("false"), ["i"], {"x": "s"}).count() == 0


def test_quantiles(numbers):
    rows, df = numbers
    xs = [x for _, x, _, _ in rows if x is not None]
    at = [0, 0.001, 0.25, 0.5, 0.77, 1]
    assert np.allclose(running.quantiles(df, F.col("x"), at), np.quantile(xs, at))
    assert running.quantiles(df.where("false"), F.col("x"), at) == [None] * 6
    assert running.quantiles(df.limit(1).select(F.lit(3.0).alias("x")), F.col("x"), [0.3]) == [3.0]


def test_quantile_transform(numbers):
    rows, df = numbers
    xs = np.array(sorted(x for _, x, _, _ in rows if x is not None))
    knots = np.quantile(xs, np.linspace(0, 1, len(xs)))
    for r in preprocess.quantile_transform(df, "x", "q").collect():
        if r["x"] is None:
            assert r["q"] is None
        elif np.count_nonzero(xs == r["x"]) == 1:
            assert abs(r["q"] - min(max(np.interp(r["x"], knots, np.linspace(0, 1, len(xs))), 1e-6), 1 - 1e-6)) < 1e-9
        else:
            inside = np.flatnonzero(np.abs(knots - r["x"]) < 1e-12) / (len(xs) - 1)
            assert inside.min() - 1e-9 <= r["q"] <= inside.max() + 1e-9 or r["q"] in (1e-6, 1 - 1e-6)


def test_stratified_folds(numbers):
    rows, df = numbers
    seen = [0] * 3
    got = {r["i"]: r["fold"] for r in splits.stratified_k_fold(df, "g", ["i"], 4).collect()}
    for i, _, g, _ in rows:
        assert got[i] == seen[g] % 4
        seen[g] += 1


def test_asof_without_a_key(spark):
    rng = random.Random(3)
    left = [(i, round(rng.random() * 50, 1)) for i in range(200)]
    right = sorted({round(rng.random() * 40 + 5, 1): rng.random() for _ in range(60)}.items())
    got = series.asof(spark.createDataFrame(left, "i long, t double").repartition(5), spark.createDataFrame(right, "t double, v double"), "t", "v", "p").collect()
    want = {i: next((v for s, v in reversed(right) if s <= t), None) for i, t in left}
    assert {r["i"]: r["p"] for r in got} == want
    assert series.asof(spark.createDataFrame(left, "i long, t double"), spark.createDataFrame([], "t double, v double"), "t", "v", "p").where("p is not null").count() == 0


def test_curves(numbers):
    rows, df = numbers
    pairs = [(x, y) for _, x, _, y in rows if x is not None]
    p, n = sum(y for _, y in pairs), sum(not y for _, y in pairs)
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in curves.roc_curve(df, "y", "x").collect()}
    assert len(roc) == len({x for x, _ in pairs}) + 1 and roc[math.inf] == (0, 0)
    for t, (fpr, tpr) in roc.items():
        assert abs(fpr - sum(x >= t and not y for x, y in pairs) / n) < 1e-12 and abs(tpr - sum(x >= t and y for x, y in pairs) / p) < 1e-12
    for r in curves.precision_recall_curve(df, "y", "x").collect():
        assert abs(r["precision"] - sum(x >= r["threshold"] and y for x, y in pairs) / sum(x >= r["threshold"] for x, _ in pairs)) < 1e-12
    auc = sum((a > b) + 0.5 * (a == b) for a, ya in pairs if ya for b, yb in pairs if not yb) / (p * n)
    assert abs(metrics.roc_auc(df, "y", "x").first()[0] - auc) < 1e-12
    assert curves.roc_curve(df.where("y = 1"), "y", "x").count() == 0 and curves.roc_curve(df.where("false"), "y", "x").count() == 0


def test_tweedie_powers_meet(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.5), (0.5, 0.7), (None, 1.0)], "y double, p double")
    for power in (1.0, 2.0):
        near = [curves.tweedie(df, "y", "p", power + e).first() for e in (-1e-5, 0.0, 1e-5)]
        assert abs(near[0][0] - near[1][0]) < 1e-4 and abs(near[2][0] - near[1][0]) < 1e-4 and abs(near[0][1] - near[1][1]) < 1e-3


def test_ranked_labels(spark):
    df = spark.createDataFrame([([1, 0, 0], [0.9, 0.1, 0.2]), ([0, 1, 1], [0.5, 0.5, 0.1]), ([0, 0, 0], [1.0, 2.0, 3.0]), ([1, 1, 1], [1.0, 2.0, 3.0]), (None, [1.0])], "t array<int>, s array<double>")
    r = curves.ranked_labels(df, "t", "s", 1).first()
    assert abs(r["top_k"] - 2 / 3) < 1e-12 and abs(r["coverage"] - 7 / 3) < 1e-12
    assert abs(r["average_precision"] - (1 + (1 / 2 + 2 / 3) / 2 + 1) / 3) < 1e-12 and abs(r["ranking_loss"] - (0 + 1.5 / 2) / 2) < 1e-12


def test_order_flow(spark):
    rows = [(1, 10.0, 11.0, 5.0, 7.0), (2, 10.0, 11.0, 8.0, 6.0), (3, 10.5, 10.8, 2.0, 3.0), (4, 10.0, 11.0, 4.0, 9.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, t int, b double, a double, qb double, qa double")
    got = [r["ofi"] for r in series.order_flow(df, ["k"], ["t"], "b", "a", "qb", "qa").orderBy("t").collect()]
    assert got == [None, 3.0 + 1.0, 2.0 - 3.0, -2.0 + 3.0]


def test_naive_bayes_on_separate_classes(spark):
    rng = random.Random(5)
    rows = [(c, *(float(rng.randint(0, 2) + 9 * (c == j)) for j in range(3))) for c in (0, 1, 2) for _ in range(30)]
    df = spark.createDataFrame(rows, "c int, a double, b double, d double")
    cols = ["a", "b", "d"]
    for out in (bayes.multinomial(df, cols, "c"), bayes.complement(df, cols, "c"), bayes.bernoulli(df, cols, "c", threshold=5.0)):
        assert out.where("predicted = c").count() == 90


def test_wasserstein_over_ranges(spark):
    from plumbline.operators import finance

    rng = random.Random(6)
    rows = [(round(rng.gauss(s, 1 + s), 2), s) for s in (0, 1) for _ in range(150)]
    got = finance.wasserstein_1d(spark.createDataFrame(rows, "x double, s int").repartition(5), "x", "s").first()[0]
    a, b = (np.array(sorted(x for x, s in rows if s == k)) for k in (0, 1))
    assert abs(got - np.abs(a - b).mean()) < 1e-9


def test_branches_of_a_range_partition_agree(spark):
    # more rows in a partition than range partitioning samples, and no coalescing into one range
    rng = random.Random(5)
    left = [(i, rng.random() * 50) for i in range(6000)]
    right = [(rng.random() * 50, float(i)) for i in range(60)]
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = spark.createDataFrame(left, "i long, t double"), spark.createDataFrame(right, "t double, v double")
        got = {r["i"]: r["p"] for r in series.asof(a, b, "t", "v", "p").collect()}
        bid, ask = b.where("v < 30"), b.where("v >= 30")
        mid = {r["t"]: r["mid"] for r in series.mid_price(bid, ask, "t", "v").collect()}
        sums = {r["i"]: r["s"] for r in running.running(a.withColumn("g", F.col("i") % 2), ["t"], {"i": "s"}, ["g"]).collect()}
        scored = spark.createDataFrame([(i % 2, [t, -t]) for i, t in left], "label int, s array<double>")
        auc = {r["label"]: r["roc_auc"] for r in selection.roc_auc_by_class(scored, "label", "s").collect()}
        ranks = {r["i"]: r["k"] for r in splits.ranked(a, ["t"], "k").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)

    def last(ticks, t):
        at = [s for s in ticks if s[0] <= t]
        return max(at)[1] if at else None

    assert got == {i: last(right, t) for i, t in left}
    want = {}
    for t, _ in right:
        x, y = last([r for r in right if r[1] < 30], t), last([r for r in right if r[1] >= 30], t)
        want[t] = None if x is None or y is None else (x + y) / 2
    assert mid == want
    total, by_time = [0, 0], sorted(left, key=lambda r: r[1])
    for i, _ in by_time:
        total[i % 2] += i
        assert sums[i] == total[i % 2]
    assert ranks == {i: k for k, (i, _) in enumerate(by_time)}
    place = {i: k + 1 for k, (i, _) in enumerate(by_time)}
    n = len(left) // 2
    share = (sum(place[i] for i, _ in left if i % 2 == 0) - n * (n + 1) / 2) / (n * n)
    assert abs(auc[0] - share) < 1e-12 and abs(auc[1] - share) < 1e-12


def test_ranges_of_any_order(spark):
    rows = [(None, 1), (float("nan"), 2), (float("-inf"), 3), (0.5, 4), (0.5, 5), (2.0, None)] * 40
    df = spark.createDataFrame(rows, "x double, y int").withColumn("z", F.timestamp_seconds("y"))
    for order, descending in ((["x", "y"], False), (["x", "y"], True), (["z", F.col("x")], False)):
        out = running.spread(df, order, descending=descending)
        key = F.struct(*order)
        ends = out.groupBy("_p").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        pairs = ends.alias("a").join(ends.alias("b"), F.expr("a._p < b._p"))
        assert ends.count() > 2
        assert pairs.where("a.low <= b.high" if descending else "a.high >= b.low").count() == 0


def test_measures_of_a_price_of_zero(spark):
    price = {"a": [1.0, 2.0, 0.0, 0.0, 3.0, 1.0, 2.0], "b": [1.0, 2.0, 0.5, 3.0, 2.0, 0.7], "c": [2.0, 3.0], "d": [4.0, 4.0, 4.0, 4.0, 4.0, 4.0], "e": [1.0, 0.0, 2.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in price.items() for i, v in enumerate(vs)], "k string, i int, v double")
    real = series.realised(df, ["k"], ["i"], "v").withColumn("n", F.lit(5))
    rv = {r["k"]: r for r in real.collect()}
    jump = {r["k"]: r for r in series.jump_test(df, ["k"], ["i"], "v").collect()}
    kernel = {r["k"]: r["realised_kernel"] for r in series.realised_kernel(df, ["k"], ["i"], "v", 3).collect()}
    ratio = {r["k"]: r["statistic"] for r in paths.jump_ratio(real, "n").collect()}
    with np.errstate(all="ignore"):
        x = {k: np.diff(np.log(vs)) for k, vs in price.items()}
    for k in "abcde":
        with np.errstate(all="ignore"):
            assert np.allclose(rv[k]["rv"], (x[k] ** 2).sum(), equal_nan=True), k
            assert np.allclose(jump[k]["qv"], (x[k] ** 2).sum(), equal_nan=True), k
            if len(x[k]) > 1:
                assert np.allclose(rv[k]["bipower"], math.pi / 2 * np.abs(x[k][1:] * x[k][:-1]).sum(), equal_nan=True), k
    assert math.isnan(rv["a"]["rv"]) and math.isnan(jump["a"]["statistic"]) and math.isnan(kernel["a"]) and math.isnan(ratio["a"])
    assert rv["e"]["rv"] == math.inf and jump["e"]["qv"] == math.inf and math.isnan(jump["e"]["jump"]) and math.isnan(kernel["e"])
    assert all(math.isfinite(v) for v in (rv["b"]["rv"], jump["b"]["statistic"], kernel["b"], ratio["b"]))
    assert ratio["c"] is None and jump["c"]["statistic"] is None  # too few increments
    assert math.isnan(ratio["d"]) and math.isnan(jump["d"]["statistic"])  # no variation


def test_crossings_of_a_mean_among_the_values(spark):
    # means that are a value of the series but for rounding: the sum in the order of the series decides
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(300):
        half = [round(rng.random() * 100, 2) for _ in range(20)]
        vs = half + [100 - v for v in half] + [50.0, 50.0]
        rng.shuffle(vs)
        rows += [(k, i, v) for i, v in enumerate(vs)]
        mean = 0.0
        for v in vs:
            mean += v
        mean /= len(vs)
        side = [(v > mean) - (v < mean) for v in vs]
        want[k] = sum(a != b for a, b in zip(side, side[1:]))
    rng.shuffle(rows)
    got = series.runs(spark.createDataFrame(rows, "k long, i long, v double").repartition(5), ["k"], ["i"], "v").collect()
    assert {r["k"]: r["crossings"] for r in got} == want
