"""Operators against numpy, closed forms and the SQL oracles."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plumbline.plans.more  # noqa: F401  registers its queries
import plumbline.plans.wide  # noqa: F401
from plumbline.functions import special
from plumbline.operators import cluster, finance, gram, kernels, pairwise, series, splits
from plumbline.operators.text import fnv1a
from plumbline.plans.queries import ORACLE_SQL, QUERIES
from plumbline.quality import Failure, Report, Severity
from plumbline.streaming.moments import merge, running_moments

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sql, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), sql.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got) == len(want)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if pd.api.types.is_numeric_dtype(want[c]):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 1


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 5]
    y = 3 + x @ [2, 1e-3, 50] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"]))
    f = gram.ols(df, ["a", "b", "c"], "y").value
    design = np.column_stack([np.ones(200), x])
    beta, sse, _, _ = np.linalg.lstsq(design, y, rcond=None)
    np.testing.assert_allclose([f.intercept, *f.coef], beta, rtol=1e-6)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 196)
    np.testing.assert_allclose(f.se, se, rtol=1e-5)
    fitted = df.select(f.predict().alias("p")).toPandas()["p"]
    np.testing.assert_allclose(fitted, design @ beta, rtol=1e-6)


def test_quality_contract(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(30)], "a double, b double, y double")
    with pytest.raises(Failure) as e:
        gram.ols(df, ["a"], "y")
    assert e.value.report.issues[0].code == "ConstantTarget"
    codes = [i.code for i in gram.ols(df.withColumn("y", F.col("a") + F.rand(1)), ["a", "b"], "y").report.issues]
    assert "RankDeficient" in codes and "PseudoinverseUsed" in codes
    with pytest.raises(Failure):
        gram.ols(df.withColumn("y", F.when(F.col("a") > 3, F.col("a")).otherwise(F.lit(float("nan")))), ["b"], "y")
    report = Report()
    report.add("Collinearity", Severity.WARNING, "x", metrics={"r": 1})
    assert report.to_df(spark).first()["metrics"] == {"r": 1.0}


def test_glm_score_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    f = gram.glm(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x"], "y").value
    r = y - 1 / (1 + np.exp(-(f.intercept + f.coef[0] * x)))
    assert abs(r.sum()) < 1e-6 and abs((r * x).sum()) < 1e-6


def test_special_functions():
    for got, want in [(special.gamma_p(2.5, 3.0), 0.6937810816778), (special.chi2_pvalue(3.84145882069, 1), 0.05), (special.student_t_pvalue(1, 30), 0.32530861542),
                      (special.f_pvalue(2, 2, 20), 1.2**-10), (special.digamma(1.0), -0.5772156649015), (special.norm_ppf(0.975), 1.959963984540),
                      (special.betainc_reg(2, 3, 0.5), 0.6875), (special.logsumexp([1000, 1000]), 1000 + math.log(2)), (special.norm_cdf(0), 0.5)]:
        assert got == pytest.approx(want, rel=1e-6)


def test_kernels():
    rng = np.random.default_rng(2)
    y = rng.normal(size=12).cumsum()
    m, v, ll = kernels.kalman_local_level(y, 0.5, 1.0, 0.0, 2.0)
    level = np.minimum.outer(np.arange(12), np.arange(12)) * 0.5 + 2.0
    cov = level + np.eye(12)
    _, logdet = np.linalg.slogdet(cov)
    assert ll == pytest.approx(-0.5 * (12 * np.log(2 * np.pi) + logdet + y @ np.linalg.solve(cov, y)))
    s, _ = kernels.rts_smooth(m, v, 0.5)
    np.testing.assert_allclose(s, level @ np.linalg.solve(cov, y))
    start, move, emit = np.log([0.6, 0.4]), np.log([[0.7, 0.3], [0.2, 0.8]]), np.log(rng.dirichlet([1, 1], 6))
    from itertools import product
    paths = {p: start[p[0]] + emit[0, p[0]] + sum(move[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))) for p in product(range(2), repeat=6)}
    assert kernels.hmm_forward(start, move, emit) == pytest.approx(special.logsumexp(paths.values()))
    path, lp = kernels.hmm_viterbi(start, move, emit)
    assert lp == pytest.approx(max(paths.values())) and paths[tuple(path)] == pytest.approx(lp)
    g = kernels.arma_autocovariance(np.array([0.5]), np.array([0.4]), 1.0, 3)
    assert g[0] == pytest.approx((1 + 0.4**2 + 2 * 0.5 * 0.4) / (1 - 0.25)) and g[2] == pytest.approx(0.5 * g[1])
    value, plan = kernels.emd(np.array([0.2, 0.5, 0.3]), np.array([0.4, 0.1, 0.5]), np.abs(np.subtract.outer(np.arange(3.0), np.arange(3.0))))
    assert value == pytest.approx(0.4) and plan.sum(1) == pytest.approx([0.2, 0.5, 0.3])
    soft, plan = kernels.sinkhorn(np.array([0.5, 0.5]), np.array([0.25, 0.75]), np.array([[0.0, 1], [1, 0]]), 0.01)
    assert soft == pytest.approx(0.25, abs=1e-3) and plan.sum(0) == pytest.approx([0.25, 0.75])
    assert kernels.ucb(np.array([[1.0, 0], [1, 0], [1, 0], [1, 0]]), 0.1) == [0, 1, 0, 0]
    np.testing.assert_allclose(kernels.hedge(np.array([[1.0, 0], [0, 0]]), 1.0), [[0.5, 0.5], [1 / (1 + math.e), math.e / (1 + math.e)]])
    assert kernels.dtw(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2])) == 0
    t = np.array([0.5, 1.0, 2.5])
    slow = sum(np.log(0.3 + 0.4 * np.exp(-1.2 * (v - t[t < v])).sum()) for v in t) - 0.3 * 3 - 0.4 / 1.2 * (1 - np.exp(-1.2 * (3 - t))).sum()
    assert kernels.hawkes_loglik(t, 3.0, 0.3, 0.4, 1.2) == pytest.approx(slow)


def test_joins_in_time(spark):
    rng = np.random.default_rng(3)
    a = [tuple(sorted(map(float, rng.random(2) * 50))) + (i,) for i in range(60)]
    b = [tuple(sorted(map(float, rng.random(2) * 50))) + (i,) for i in range(60)]
    got = series.interval_join(spark.createDataFrame(a, "a0 double, a1 double, i int"), spark.createDataFrame(b, "b0 double, b1 double, j int"), 3.0).select("i", "j").collect()
    want = {(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    left = spark.createDataFrame([(1.0, "p"), (0.5, "q"), (3.0, "r")], "t double, name string")
    right = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "t double, v double")
    assert {r["name"]: r["prev"] for r in series.asof(left, right, "t", "v", "prev").collect()} == {"p": 10.0, "q": None, "r": 20.0}


def test_splits(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "i long")
    assert [r["fold"] for r in splits.k_fold(df, ["i"], 4).orderBy("i").collect()] == [i % 4 for i in range(101)]
    assert splits.time_series_blocks(10, 4) == [(2, 4), (4, 6), (6, 8), (8, 10)]
    share = df.where(splits.hash_split(F.col("i"), 0.3)).count()
    assert 15 < share < 48


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    q = df.where("vec_id % 10 = 0")
    for metric, f in pairwise.METRICS.items():
        got = pairwise.nearest(df, q, 3, metric=metric).orderBy("query", "rank").collect()
        d = f(x[::10], x)
        want = [(i * 10, j) for i in range(8) for j in [j for j in np.lexsort((np.arange(80), d[i])) if j != i * 10][:3]]
        assert [(r["query"], r["neighbour"]) for r in got] == want, metric
    values, share, comps = cluster.pca(df, "embedding", 5)
    np.testing.assert_allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    dens = {r["query"]: r["log_density"] for r in pairwise.density(df, q, 0.7).collect()}
    want = special.logsumexp(-((x - x[10]) ** 2).sum(1) / (2 * 0.49)) - math.log(80) - 5 * (0.5 * math.log(2 * math.pi) + math.log(0.7))
    assert dens[10] == pytest.approx(want)
    centres, inertia, _ = cluster.k_means(df, "embedding", 4, "vec_id")
    assert inertia == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), rel=1e-6)


def test_prices(spark):
    call = spark.range(1).select(finance.black_scholes(F.lit(100.0), F.lit(100.0), F.lit(0.05), F.lit(0.2), F.lit(1.0)).alias("c")).first()["c"]
    assert call == pytest.approx(10.450583572)
    assert finance.binomial_price(100, 100, 0.05, 0.2, 1, 2000) == pytest.approx(call, abs=2e-3)
    assert finance.binomial_price(100, 100, 0.05, 0.2, 1, 500, call=False, american=True) > finance.binomial_price(100, 100, 0.05, 0.2, 1, 500, call=False)
    a = finance.gbm_paths(spark, 50, 4, 1.0, 0.0, 0.1, 1.0, 7).orderBy("path_id").collect()
    assert a == finance.gbm_paths(spark, 50, 4, 1.0, 0.0, 0.1, 1.0, 7).repartition(3).orderBy("path_id").collect()


def test_fnv():
    def slow(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h - 2**64 if h >> 63 else h

    words = ["", "a", "foobar", "éñ", "x" * 50]
    assert fnv1a.func(pd.Series(words)).tolist() == [slow(w.encode()) for w in words]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = running_moments(stream, "user_id", "value", ["event_id"]).writeStream.format("memory").queryName("moments").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    last = spark.sql("SELECT user_id, max_by(mean, n) AS mean, max_by(variance, n) AS variance, max(n) AS n FROM moments GROUP BY user_id").toPandas().set_index("user_id").sort_index()
    want = events.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).toPandas().set_index("user_id").sort_index()
    np.testing.assert_allclose(last[["n", "mean", "variance"]].astype(float), want[["n", "mean", "variance"]].astype(float))
    assert merge((0, 0, 0), (2, 1.0, 2.0)) == (2, 1.0, 2.0)
