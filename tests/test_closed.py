"""The normal distribution of arrays, random laws and windows against closed forms."""

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import closed, selection, variates


def test_normal_distribution_against_erfc():
    z = np.concatenate([np.linspace(-39, 39, 4001), [0.0, -3.0, 3.0, np.inf, -np.inf]])
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    np.testing.assert_allclose(closed.normal_cdf_array(z), want, rtol=1e-12, atol=1e-300)
    assert np.isnan(closed.normal_cdf_array(np.array([np.nan]))[0])


def test_laws_have_their_moments(spark):
    u = [variates.uniform(F.col("id"), 1, i) for i in range(6)]
    laws = {"normal": (variates.normal(u[0], u[1], 2, 3), 2, 9), "gamma": (variates.erlang(u[:3], 2), 6, 12), "poisson": (variates.poisson(u[0], 3.5), 3.5, 3.5), "binomial": (variates.binomial(u[0], 12, 0.3), 3.6, 2.52),
            "t": (variates.student_t(u[0], u[1], 9), 0, 9 / 7), "wald": (variates.inverse_gaussian(u[0], u[1], u[2], 2, 3), 2, 8 / 3), "beta": (variates.beta(u[:2], u[2:5]), 0.4, 0.04), "chi2": (variates.noncentral_chi2(u[2:4], u[0], u[1], 1.5), 6.5, 16)}
    n = 40000
    got = spark.range(n).agg(*(F.avg(c).alias(f"{k}_m") for k, (c, _, _) in laws.items()), *(F.var_samp(c).alias(f"{k}_v") for k, (c, _, _) in laws.items())).first()
    for k, (_, mean, var) in laws.items():
        assert abs(got[f"{k}_m"] - mean) < 5 * math.sqrt(var / n), k
        assert abs(got[f"{k}_v"] / var - 1) < 0.15, k


def test_a_draw_depends_on_its_key_alone(spark):
    d = lambda parts: spark.range(500).repartition(parts).select("id", variates.uniform(F.col("id"), 3).alias("u")).orderBy("id").collect()
    assert d(1) == d(7)


def test_windows_that_do_not_fit_are_none(spark):
    df = spark.range(10)
    assert selection.sliding_windows(df, ["id"], 8, 3).count() == 0
    assert selection.expanding_windows(df, ["id"], 9, 2, 1).count() == 0
    assert selection.sliding_windows(df, ["id"], 4, 2, 2).groupBy("split").count().count() == 3


def test_splits_of_few_rows(spark):
    for n in (1, 2, 3):
        t = selection.train_test_split(spark.range(n), ["id"], 0.9, 1).where("test").count()
        assert t == min(max(int(0.9 * n + 0.5), 1), n - 1)
