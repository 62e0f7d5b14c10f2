"""Registered queries of path functionals, closed forms, random laws, splits and cross-validation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closed, paths, selection, series, splits, variates
from ..sources import read, ticks
from .queries import _LABELLED, _TICKS, _labelled, query, rounded

# ---- paths --------------------------------------------------------------------------------------------------------------

_USER, _ORDER = ["user_id"], ["ts", "event_id"]
_EVENTS = "SELECT user_id, event_id, ts, epoch_us(ts) / 3.6e9 AS t, value AS x, floor(value / 10) AS y FROM events"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_INC = f"SELECT *, x - lag(x) OVER w AS d, t - lag(t) OVER w AS dt, lag(x) OVER w AS l FROM ({_EVENTS}) {_W}"


def _events(spark, d):
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 3.6e9
    return read(spark, d, "events").select("user_id", "event_id", "ts", hours.alias("t"), F.col("value").alias("x"), F.floor(F.col("value") / 10).cast("double").alias("y"))


@query(f"""SELECT user_id, round(sum(d * d), 4) AS quadratic_variation, round(sum(d * e), 4) AS covariation, round(sum(l * e), 4) + 0.0 AS ito_integral
FROM (SELECT user_id, x - lag(x) OVER w AS d, y - lag(y) OVER w AS e, lag(x) OVER w AS l FROM ({_EVENTS}) {_W}) GROUP BY 1""")
def path_variation(spark, d):
    return rounded(paths.variation(_events(spark, d), _USER, _ORDER, "x", "y"), 4)


@query(f"SELECT event_id, max(x) OVER w AS running_maximum, min(x) OVER w AS running_minimum FROM ({_EVENTS}) {_W}")
def running_extremes(spark, d):
    return paths.running_extremes(_events(spark, d), _USER, _ORDER, "x").select("event_id", "running_maximum", "running_minimum")


@query(f"SELECT user_id, round(min(CASE WHEN x >= 100 THEN t END), 6) AS first_passage FROM ({_EVENTS}) GROUP BY 1")
def first_passage_time(spark, d):
    return rounded(paths.first_passage(_events(spark, d), _USER, "t", "x", 100.0))


@query(f"""SELECT user_id, round(CASE WHEN max(x) >= 350 THEN 0 ELSE exp(coalesce(sum(CASE WHEN dt > 0 THEN ln(1 - exp(-2 * (350 - l) * (350 - x) / (2500 * dt))) END), 0)) END, 6) AS survival FROM ({_INC}) GROUP BY 1""")
def barrier_survival(spark, d):
    return rounded(paths.barrier_survival(_events(spark, d), _USER, _ORDER, "t", "x", 350.0, 50.0))


@query(f"""WITH p AS (SELECT *, abs(d) * abs(lag(d) OVER w) AS p, row_number() OVER w - 2 AS i, count(d) OVER (PARTITION BY user_id) AS n FROM ({_INC}) {_W}),
s AS (SELECT event_id, CASE WHEN i >= 8 THEN d / sqrt(pi() / 2 * sum(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / 7) ELSE 0 END AS s,
  CASE WHEN n > 1 THEN sqrt(2 * ln(n)) - (ln(pi()) + ln(ln(n))) / (2 * sqrt(2 * ln(n))) END AS h FROM p)
SELECT event_id, round(s, 6) + 0.0 AS statistic, coalesce(abs(s) > h, false) AS jump FROM s""")
def jump_statistics(spark, d):
    return rounded(paths.jump_statistics(_events(spark, d), _USER, _ORDER, "x", 8).select("event_id", "statistic", "jump"))


@query(f"""WITH r AS (SELECT series, t, ln(v) - lag(ln(v)) OVER (PARTITION BY series ORDER BY t) AS r FROM ({_TICKS})), q AS (SELECT series, r, abs(r) * abs(lag(r) OVER w) AS b, abs(r) * abs(lag(r) OVER w) * abs(lag(r, 2) OVER w) * abs(lag(r, 3) OVER w) AS q FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t)),
s AS (SELECT series, count(*) AS n, sum(r * r) AS rv, pi() / 2 * sum(b) AS bv, count(*) / power(2 / pi(), 2) * sum(q) AS q FROM q GROUP BY 1)
SELECT series, round((bv / rv - 1) / sqrt((pi() * pi() / 4 + pi() - 5) * q / (n * rv * rv)), 6) AS statistic FROM s""")
def jump_ratio(spark, d):
    t = ticks(spark, d)
    n = t.groupBy("series").agg((F.count("*") - 1).alias("n"))
    return rounded(paths.jump_ratio(series.realised(t, ["series"], ["t"], "v").join(n, "series"), "n").select("series", "statistic"))


@query(f"""WITH i AS (SELECT *, row_number() OVER w - 1 AS i FROM ({_INC}) WHERE d IS NOT NULL {_W}), p AS (SELECT user_id, d, CASE WHEN i % 2 = 1 THEN d + lag(d) OVER w END AS two FROM i {_W})
SELECT user_id, round(CASE WHEN count(*) >= 8 THEN 0.5 * log2(sum(two * two) / sum(d * d)) + 0.5 END, 6) + 0.0 AS hurst FROM p GROUP BY 1""")
def hurst_exponent(spark, d):
    return rounded(paths.hurst(_events(spark, d), _USER, _ORDER, "x"))


@query(f"""WITH q AS (SELECT *, d * d AS q, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ({_INC}) WHERE d IS NOT NULL {_W}), a AS (SELECT *, sum(q) OVER w AS a, sum(q) OVER (PARTITION BY user_id) AS s FROM q {_W}),
c AS (SELECT user_id, k, a, s - a AS b, k * ln(a / k) + (n - k) * ln((s - a) / (n - k)) AS c FROM a WHERE n >= 8 AND k >= 2 AND k < n - 2 AND a > 0 AND s - a > 0)
SELECT user_id, k AS index, round(c, 4) AS contrast, round(a, 4) AS left, round(b, 4) AS right FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, k) AS o FROM c) WHERE o = 1""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"').replace(" AS index", ' AS "index"'))
def change_point(spark, d):
    out = paths.change_point(_events(spark, d), _USER, _ORDER, "x")
    return rounded(out.withColumn("contrast", F.round("contrast", 4)).withColumns({c: F.round(c, 4) for c in ("left", "right")}))


_RESIDUAL = f"SELECT *, (d - 0.5 * (50 - l) * dt) / (30 * sqrt(dt)) AS r FROM ({_INC}) WHERE dt > 0"


@query(f"SELECT e.event_id, round(r, 6) + 0.0 AS residual FROM events e LEFT JOIN ({_RESIDUAL}) s ON e.event_id = s.event_id")
def euler_residuals(spark, d):
    return rounded(paths.mean_reverting(_events(spark, d), _USER, _ORDER, "t", "x", 0.5, 50.0, 30.0).select("event_id", "residual"))


@query(f"SELECT user_id, round(sum(-0.5 * (ln(2 * pi() * 900 * dt) + r * r)), 3) AS quasi_loglik, round(900 * sum(r * r), 1) AS least_squares FROM ({_RESIDUAL}) GROUP BY 1")
def quasi_likelihood(spark, d):
    out = paths.mean_reverting_contrasts(_events(spark, d), _USER, _ORDER, "t", "x", 0.5, 50.0, 30.0)
    return rounded(out.withColumn("least_squares", F.round("least_squares", 1)), 3)


@query(f"SELECT event_id, round(0.5 * x + 0.3 * lag(x, 1, 0) OVER w + 0.2 * lag(x, 2, 0) OVER w, 6) AS y FROM ({_EVENTS}) {_W}")
def convolution_filter(spark, d):
    return rounded(paths.fir(_events(spark, d).drop("y"), _USER, _ORDER, "x", [0.5, 0.3, 0.2], "y").select("event_id", "y"))


@query(f"""WITH b AS (SELECT list_transform(range(0, 7), lambda j: CASE WHEN j = 0 THEN (2 * pi() / 6 - 2 * pi() / 32) / pi() ELSE (sin(j * 2 * pi() / 6) - sin(j * 2 * pi() / 32)) / (pi() * greatest(j, 1)) END) AS b),
c AS (SELECT list_transform(b, lambda x: x - (2 * list_sum(b) - b[1]) / 13) AS c FROM b), r AS (SELECT event_id, c[1] * x + {' + '.join(f'c[{j + 1}] * (lag(x, {j}) OVER w + lead(x, {j}) OVER w)' for j in range(1, 7))} AS cycle FROM ({_EVENTS}), c {_W})
SELECT event_id, round(cycle, 6) + 0.0 AS cycle FROM r WHERE cycle IS NOT NULL""")
def band_pass_filter(spark, d):
    return rounded(paths.band_pass(_events(spark, d), _USER, _ORDER, "x", 6, 32, 6, "cycle").select("event_id", "cycle"))


@query(f"SELECT event_id, round(CASE WHEN count(*) OVER w >= 5 THEN covar_pop(x, t0) OVER w / nullif(var_pop(t0) OVER w, 0) END, 6) + 0.0 AS slope FROM (SELECT *, sqrt(event_id % 17) AS t0 FROM ({_EVENTS})) {_W}")
def expanding_regression(spark, d):
    e = _events(spark, d).withColumn("t0", F.sqrt(F.col("event_id") % 17))
    return rounded(selection.expanding_slope(e, _USER, _ORDER, "t0", "x", 5).select("event_id", "slope"), 6)


# ---- closed forms -------------------------------------------------------------------------------------------------------


def _phi(x: str) -> str:
    """The normal distribution by its series over odd double factorials; SQL has no error function."""
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 100), lambda odd: power({x}, 2 * odd + 1) * sqrt(pi()) / (power(2.0, odd + 1) * gamma(odd + 1.5)))))"


def _black(f: str, k: str, v: str, t: str) -> str:
    one = f"((ln({f} / {k}) + {v} * {v} * {t} / 2) / ({v} * sqrt({t})))"
    return f"({f} * {_phi(one)} - {k} * {_phi(f'({one} - {v} * sqrt({t}))')})"


_TERMS = "SELECT p_partkey, p_retailprice / 10.0 AS s, p_retailprice / 10.0 * (0.9 + (p_partkey % 5) * 0.05) AS k, 0.15 + (p_size % 10) * 0.03 AS v, (p_size + 3) / 12.0 AS t FROM part"


def _terms(spark, d):
    s = F.col("p_retailprice") / 10.0
    return read(spark, d, "part").select("p_partkey", s.alias("s"), (s * (0.9 + (F.col("p_partkey") % 5) * 0.05)).alias("k"), (0.15 + (F.col("p_size") % 10) * 0.03).alias("v"), ((F.col("p_size") + 3) / 12.0).alias("t"))


@query(f"""WITH x AS (SELECT *, s * exp(0.03 * t) AS f, exp(-0.03 * t) AS df, sqrt(v * v + 0.04 - 0.8 * v * 0.2) AS v2, v / sqrt(3) AS v3, s * exp(0.5 * (0.03 - v * v / 6) * t) AS f3 FROM ({_TERMS}))
SELECT p_partkey, round(df * {_black('f', 'k', 'v', 't')}, 6) + 0.0 AS call, 0.0::DOUBLE AS gap, round(100 * df * {_phi('((ln(f / k) - v * v * t / 2) / (v * sqrt(t)))')}, 6) AS digital, round({_black('s', 'k', 'v2', 't')}, 6) + 0.0 AS exchange, round(df * {_black('f3', 'k', 'v3', 't')}, 6) + 0.0 AS geometric FROM x""")
def option_prices(spark, d):
    s, k, v, t, r, q = *map(F.col, "skvt"), F.lit(0.03), F.lit(0.0)
    return rounded(_terms(spark, d).select("p_partkey", closed.call(s, k, r, q, v, t).alias("call"), closed.parity_gap(s, k, r, q, v, t).alias("gap"), closed.digital_call(s, k, r, v, t, 100.0).alias("digital"),
                                           closed.exchange(s, k, v, F.lit(0.2), 0.4, t).alias("exchange"), closed.geometric_asian_call(s, k, r, v, t).alias("geometric")))


@query(f"""WITH x AS (SELECT *, 0.01 + v / 10 AS r, (1 - exp(-0.5 * t)) / 0.5 AS b, sqrt(0.25 + 0.02) AS h FROM ({_TERMS})), y AS (SELECT *, exp(h * t) - 1 AS g, (h + 0.5) * (exp(h * t) - 1) + 2 * h AS n FROM x)
SELECT p_partkey, round(exp((0.04 - 0.0004 / 0.5) * (b - t) - 0.0004 / 2 * b * b - b * r), 6) AS vasicek, round(exp(4.0 * ln(2 * h * exp((h + 0.5) / 2 * t) / n) - 2 * g / n * r), 6) AS cir,
  round(0.5 * 0.9 * {_black('s', 'k', 'v', 't')}, 6) + 0.0 AS caplet, round(4 * {_black('k', 's', 'v', 't')}, 6) + 0.0 AS receiver FROM y""")
def rate_prices(spark, d):
    s, k, v, t = map(F.col, "skvt")
    r = 0.01 + v / 10
    return rounded(_terms(spark, d).select("p_partkey", closed.vasicek_bond(r, t, 0.5, 0.04, 0.02).alias("vasicek"), closed.cir_bond(r, t, 0.5, 0.04, 0.1).alias("cir"),
                                           closed.caplet(s, k, v, t, 0.5, 0.9).alias("caplet"), closed.swaption(s, k, v, t, 4.0, False).alias("receiver")))


@query(f"""WITH x AS (SELECT *, 0.5 - (0.05 - 0.02) / (v * v) AS h FROM ({_TERMS})), y AS (SELECT *, h + sqrt(h * h + 0.1 / (v * v)) AS b, h - sqrt(h * h + 0.1 / (v * v)) AS a FROM x), z AS (SELECT *, b / (b - 1) * k AS up, a / (a - 1) * k AS down FROM y)
SELECT p_partkey, round(b, 6) AS invest_beta, round(up, 6) AS invest_at, round(CASE WHEN s >= up THEN s - k ELSE (up - k) * power(s / up, b) END, 6) AS invest_value,
  round(a, 6) AS leave_beta, round(down, 6) AS leave_at, round(CASE WHEN s <= down THEN k - s ELSE (k - down) * power(s / down, a) END, 6) AS leave_value, round(0.04 / (2 * v * v), 6) AS share, round(0.04 / v, 6) AS price_of_risk FROM z""")
def real_options(spark, d):
    s, k, v, r, q = F.col("s"), F.col("k"), F.col("v"), F.lit(0.05), F.lit(0.02)
    a, b = closed.perpetual_call(s, k, r, q, v), closed.perpetual_put(s, k, r, q, v)
    names = ["invest_beta", "invest_at", "invest_value", "leave_beta", "leave_at", "leave_value"]
    return rounded(_terms(spark, d).select("p_partkey", *(c.alias(n) for c, n in zip([*a, *b], names)), closed.merton_share(F.lit(0.09), r, 2.0, v).alias("share"), closed.market_price_of_risk(F.lit(0.09), r, v).alias("price_of_risk")))


# ---- random laws --------------------------------------------------------------------------------------------------------


def _u(stream: int) -> str:
    return f"((('0x' || substr(md5('7:{stream}:' || event_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


_US = "SELECT event_id, " + ", ".join(f"{_u(i)} AS u{i}" for i in range(6)) + " FROM events"
_Z = "sqrt(-2 * ln(u0)) * cos(2 * pi() * u1)"


def _streams(spark, d):
    return read(spark, d, "events").select("event_id", *(variates.uniform(F.col("event_id"), 7, i).alias(f"u{i}") for i in range(6)))


@query(f"""SELECT event_id, round(u0, 6) AS uniform, round(-3 + 5 * u0, 6) + 0.0 AS ranged, round(-ln(u0) / 2, 6) AS exponential, round(10 + 3 * {_Z}, 6) AS normal, round(sqrt(5 * (power(u0, -0.4) - 1)) * cos(2 * pi() * u1), 6) + 0.0 AS student_t,
  round(-2 * (ln(u0) + ln(u1) + ln(u2)), 6) AS gamma, round(power({_Z} + sqrt(1.5), 2) - 2 * (ln(u2) + ln(u3)), 6) AS noncentral, round((ln(u0) + ln(u1)) / (ln(u0) + ln(u1) + ln(u2) + ln(u3) + ln(u4)), 6) AS beta FROM ({_US})""")
def continuous_laws(spark, d):
    u = [F.col(f"u{i}") for i in range(6)]
    return rounded(_streams(spark, d).select("event_id", u[0].alias("uniform"), variates.between(u[0], -3, 2).alias("ranged"), variates.exponential(u[0], 2).alias("exponential"), variates.normal(u[0], u[1], 10, 3).alias("normal"),
                                             variates.student_t(u[0], u[1], 5).alias("student_t"), variates.erlang(u[:3], 2).alias("gamma"), variates.noncentral_chi2(u[2:4], u[0], u[1], 1.5).alias("noncentral"), variates.beta(u[:2], u[2:5]).alias("beta")))


@query(f"""WITH z AS (SELECT *, 2 * power({_Z}, 2) AS y, pi() * (u3 - 0.5) AS a, -ln(u4) AS e, atan(0.5 * tan(0.75 * pi())) / 1.5 AS b FROM ({_US})), w AS (SELECT *, 2 + 2 / 6.0 * (y - sqrt(12 * y + y * y)) AS x FROM z)
SELECT event_id, round(CASE WHEN u2 <= 2 / (2 + x) THEN x ELSE 4 / x END, 6) AS inverse_gaussian, round(power(1 + power(0.5 * tan(0.75 * pi()), 2), 1 / 3.0) * sin(1.5 * (a + b)) / power(cos(a), 1 / 1.5) * power(cos(a - 1.5 * (a + b)) / e, -0.5 / 1.5), 5) + 0.0 AS stable FROM w""")
def skewed_laws(spark, d):
    u = [F.col(f"u{i}") for i in range(6)]
    out = _streams(spark, d).select("event_id", variates.inverse_gaussian(u[0], u[1], u[2], 2, 3).alias("inverse_gaussian"), variates.stable(u[3], u[4], 1.5, 0.5).alias("stable"))
    return rounded(out.withColumn("stable", F.round("stable", 5)))


_POISSON = "list_transform(range(0, 120), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-3.5 + j * ln(3.5) - lgamma(j + 1)))))"
_BINOMIAL = "list_transform(range(0, 12), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(13) - lgamma(j + 1) - lgamma(13 - j) + j * ln(0.3) + (12 - j) * ln(0.7)))))"


@query(f"""WITH c AS (SELECT {_POISSON} AS p, {_BINOMIAL} AS b), d AS (SELECT *, [(u >= 0.2)::INT + (u >= 0.7)::INT FOR u IN [u0, u1, u2, u3]] AS m FROM ({_US}), c)
SELECT event_id, (u0 < 0.3)::INTEGER AS bernoulli, ((u1 >= 0.2)::INT + (u1 >= 0.7)::INT)::INTEGER AS categorical, len(list_filter(p, lambda x: x < u2))::INTEGER AS poisson, len(list_filter(b, lambda x: x < u3))::INTEGER AS binomial,
  len(list_filter(m, lambda x: x = 0))::INTEGER AS m0, len(list_filter(m, lambda x: x = 1))::INTEGER AS m1, len(list_filter(m, lambda x: x = 2))::INTEGER AS m2 FROM d""")
def discrete_laws(spark, d):
    u, w = [F.col(f"u{i}") for i in range(6)], [0.2, 0.5, 0.3]
    out = _streams(spark, d).select("event_id", variates.bernoulli(u[0], 0.3).alias("bernoulli"), variates.categorical(u[1], w).alias("categorical"), variates.poisson(u[2], 3.5).alias("poisson"), variates.binomial(u[3], 12, 0.3).alias("binomial"),
                                    variates.multinomial(u[:4], w).alias("m"))
    return out.select("*", *(F.col("m")[i].alias(f"m{i}") for i in range(3))).drop("m")


# ---- splits and cross-validation ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) <= round(0.25 * count(*) OVER ()) AS test FROM orders")
def train_test_split(spark, d):
    return selection.train_test_split(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.25, 3)


@query("SELECT o_orderkey, s::INTEGER AS split, row_number() OVER (PARTITION BY s ORDER BY md5((s + 5) || ':' || o_orderkey), o_orderkey) <= round(0.2 * count(*) OVER (PARTITION BY s)) AS test FROM orders, range(3) t(s)")
def shuffle_split(spark, d):
    return selection.shuffle_splits(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 3, 5)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('2:' || o_orderkey), o_orderkey) <= greatest(least(floor(0.2 * count(*) OVER (PARTITION BY o_orderstatus) + 0.5), count(*) OVER (PARTITION BY o_orderstatus) - 1), 1) AS test FROM orders")
def stratified_shuffle_split(spark, d):
    return selection.stratified_shuffle(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 0.2, 2).select("o_orderkey", "test")


@query("""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('4:' || o_custkey), o_custkey) <= round(0.3 * count(*) OVER ()) AS test FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, test FROM orders JOIN g USING (o_custkey)""")
def group_shuffle_split(spark, d):
    return selection.group_shuffle(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.3, 4).select("o_orderkey", "test")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > count(*) OVER () - round(0.1 * count(*) OVER ()) AS test FROM orders")
def temporal_train_test(spark, d):
    return selection.temporal_split(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.1).select("o_orderkey", "test")


_RANKED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders"


@query(f"SELECT o_orderkey, s AS split, i >= s * 200 + 300 AS test FROM ({_RANKED}) r JOIN range(0, 10000000, 1) t(s) ON s BETWEEN i // 200 - 3 AND i // 200 WHERE s * 200 + 350 <= n AND i >= s * 200 AND i < s * 200 + 350")
def sliding_window_split(spark, d):
    return selection.sliding_windows(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 300, 50, 200).select("o_orderkey", "split", "test")


@query(f"SELECT o_orderkey, (i - 100) // 250 AS split, (i - 100) // 250 * 250 + 100 AS train_size FROM ({_RANKED}) WHERE i >= 100 AND (i - 100) % 250 < 60 AND (i - 100) // 250 * 250 + 160 <= n")
def expanding_window_split(spark, d):
    return selection.expanding_windows(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, 60, 250).select("o_orderkey", "split", "train_size")


_FOLDS = "SELECT o_orderkey, o_custkey::DOUBLE AS q, o_totalprice AS y, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders"
_FITS = f"x AS ({_FOLDS}), b AS (SELECT f.fold, regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM x, range(5) f(fold) WHERE x.fold <> f.fold GROUP BY 1)"


def _folded(spark, d):
    return splits.k_fold(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("q"), F.col("o_totalprice").cast("double").alias("y")), ["o_orderkey"], 5)


@query(f"WITH {_FITS} SELECT x.fold, round(1 - sum((y - a - b * q) ** 2) / any_value(v), 6) AS r2 FROM x JOIN b ON x.fold = b.fold JOIN (SELECT fold, var_pop(y) * count(*) AS v FROM x GROUP BY 1) s ON s.fold = x.fold GROUP BY 1")
def cross_val_score(spark, d):
    got = selection.cross_validated(_folded(spark, d), ["q"], "y", "fold")
    return spark.createDataFrame([(k, round(r2, 6)) for k, (_, r2) in got.items()], "fold int, r2 double")


@query(f"WITH {_FITS} SELECT o_orderkey, round(a + b * q, 3) AS predicted FROM x JOIN b ON x.fold = b.fold")
def cross_val_predict(spark, d):
    return rounded(selection.cross_val_predict(_folded(spark, d), ["q"], "y", "fold").select("o_orderkey", "predicted"), 3)


# ---- scores -------------------------------------------------------------------------------------------------------------


@query(f"WITH r AS (SELECT avg(CASE WHEN y = 1 THEN p END) AS t, avg(CASE WHEN y = 0 THEN p END) AS f FROM ({_LABELLED})) SELECT round(t / f, 6) AS positive, round((1 - t) / (1 - f), 6) AS negative FROM r")
def class_likelihood_ratios(spark, d):
    return rounded(selection.likelihood_ratios(_labelled(spark, d), "y", "p"))


@query("""WITH x AS (SELECT i AS label, label = i AS t, embedding[i + 1]::DOUBLE > 0.05 AS p FROM embeddings, range(10) r(i))
SELECT label, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM x GROUP BY 1""".replace("SELECT i AS label, label = i AS t", "SELECT i AS label, embeddings.label = i AS t"))
def multilabel_confusion(spark, d):
    e = read(spark, d, "embeddings")
    truth = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return selection.multilabel_confusion(e.select(truth.alias("a"), F.transform(F.slice("embedding", 1, 10), lambda s: (s.cast("double") > 0.05).cast("int")).alias("b")), "a", "b")


@query("""WITH x AS (SELECT i, (embeddings.label = i)::INT AS y, embedding[i + 1]::DOUBLE AS s FROM embeddings, range(10) r(i)), r AS (SELECT i, y, rank() OVER (PARTITION BY i ORDER BY s) + (count(*) OVER (PARTITION BY i, s) - 1) / 2.0 AS r FROM x)
SELECT i AS label, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r GROUP BY 1""")
def roc_auc_one_vs_rest(spark, d):
    return rounded(selection.roc_auc_by_class(read(spark, d, "embeddings").select("label", F.slice("embedding", 1, 10).alias("s")), "label", "s"))
