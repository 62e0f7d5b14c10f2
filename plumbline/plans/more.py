"""More registered queries: curves, relative scores, naive Bayes, tick measures, distances, and oracles of recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes, cluster, curves, gram, pairwise, running, series
from ..sources import read, ticks
from .queries import _KEY, _LABELLED, _Q, _TICKS, ORACLE_SQL, XS, _labelled, _vectors, query, rounded

# ---- curves and relative scores -----------------------------------------------------------------------------------------

_POINTS = f"""g AS (SELECT s, sum(y)::DOUBLE AS a, (count(*) - sum(y))::DOUBLE AS b FROM ({_LABELLED}) GROUP BY 1),
c AS (SELECT s, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS p, sum(b) OVER () AS n FROM g WINDOW w AS (ORDER BY s DESC))"""


@query(f"WITH {_POINTS} SELECT round(s, 6)::DOUBLE AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT 1e9::DOUBLE, 0.0, 0.0")
def roc_curve(spark, d):
    out = curves.roc_curve(_labelled(spark, d), "y", "s")
    return rounded(out.withColumn("threshold", F.least("threshold", F.lit(1e9))))


@query(f"WITH {_POINTS} SELECT round(s, 6)::DOUBLE AS threshold, round(fp / n, 6) AS fpr, round(1 - tp / p, 6) + 0.0 AS fnr FROM c UNION ALL SELECT 1e9::DOUBLE, 0.0, 1.0")
def det_curve(spark, d):
    return rounded(curves.det_curve(_labelled(spark, d), "y", "s").withColumn("threshold", F.least("threshold", F.lit(1e9))))


@query(f"WITH {_POINTS} SELECT round(s, 6)::DOUBLE AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c")
def precision_recall_curve(spark, d):
    return rounded(curves.precision_recall_curve(_labelled(spark, d), "y", "s"))


_PRICES = "SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p, avg(l_extendedprice) OVER () AS m FROM lineitem"
_UNITS = {
    0.0: "({y} - {m}) * ({y} - {m})",
    1.5: "2 * (pow({y}, 0.5) / (-0.5 * 0.5) - {y} * pow({m}, -0.5) / (-0.5) + pow({m}, 0.5) / 0.5)",
    3.0: "2 * (pow({y}, -1.0) / (-2.0 * -1.0) - {y} * pow({m}, -2.0) / (-2.0) + pow({m}, -1.0) / (-1.0))",
}
for _power, _unit in _UNITS.items():
    def _tweedie(spark, d, power=_power):
        out = curves.tweedie(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p", power)
        return out.select(F.round(F.col("deviance") / (F.pow(F.lit(1e4), F.lit(2 - power))), 6).alias("deviance"), F.round("d2", 6).alias("d2"))
    query(f"""SELECT round(avg({_unit.format(y='y', m='p')}) / pow(1e4, {2 - _power}), 6) AS deviance, round(1 - avg({_unit.format(y='y', m='p')}) / avg({_unit.format(y='y', m='m')}), 6) AS d2
FROM ({_PRICES})""", f"tweedie_deviance_{_power:g}".replace(".", "_"))(_tweedie)


@query(f"""WITH e AS (SELECT y, p, y - p AS e FROM ({_PRICES})), q AS (SELECT quantile_cont(y, 0.5) AS h, quantile_cont(y, 0.9) AS q FROM e),
l AS (SELECT *, CASE WHEN e >= 0 THEN 0.9 * e ELSE -0.1 * e END AS lm, CASE WHEN y >= q THEN 0.9 * (y - q) ELSE -0.1 * (y - q) END AS lq FROM e, q)
SELECT round(1 - sum(abs(e)) / sum(abs(y - h)), 6) + 0.0 AS d2_absolute, round(1 - sum(lm) / sum(lq), 6) + 0.0 AS d2_pinball,
  round(avg(abs(e) + ln(1 + exp(-2 * abs(e))) - ln(2)), 4) AS log_cosh, round(avg(2 * abs(e) / (abs(y) + abs(p))), 6) AS smape, round(sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 6) AS rmsle FROM l""")
def relative_errors(spark, d):
    out = curves.relative_errors(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p", 0.9)
    return rounded(out.withColumn("log_cosh", F.round("log_cosh", 4)))


@query("""WITH c AS (SELECT l_linenumber % 3 AS a, l_suppkey % 3 AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT sum(n) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS ok, sum(n * (n - 1) / 2) AS tp FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round(1 - ok / t, 6) AS zero_one, round(1 - ok / t, 6) AS hamming, tp, y.b - tp AS fp, x.a - tp AS fn, round(tp / sqrt(x.a * y.b), 6) AS fowlkes_mallows FROM w, x, y""")
def label_errors(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("long").alias("a"), (F.col("l_suppkey") % 3).cast("long").alias("b"))
    return rounded(curves.label_errors(li, "a", "b"))


@query("""WITH x AS (SELECT vec_id, i, (i = label + 1)::INT + (i = (label + 3) % 10 + 1)::INT AS y, embedding[i]::DOUBLE AS s FROM embeddings, range(1, 11) t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS r FROM x),
a AS (SELECT *, sum(y) OVER (PARTITION BY vec_id ORDER BY r) AS hits, sum(y) OVER (PARTITION BY vec_id) AS m FROM r),
b AS (SELECT u.vec_id, sum(CASE WHEN v.s > u.s THEN 1.0 WHEN v.s = u.s THEN 0.5 ELSE 0 END) / any_value(u.m * (10 - u.m)) AS loss FROM a u JOIN a v ON u.vec_id = v.vec_id AND u.y = 1 AND v.y = 0 GROUP BY 1),
c AS (SELECT vec_id, max(CASE WHEN y = 1 AND r <= 3 THEN 1.0 ELSE 0 END) AS hit, sum(CASE WHEN y = 1 THEN hits / r ELSE 0 END) / max(m) AS ap, max(CASE WHEN y = 1 THEN r END) AS worst FROM a GROUP BY 1)
SELECT round(avg(hit), 6) AS top_k, round(avg(ap), 6) AS average_precision, round(avg(worst), 6) AS coverage, round(avg(loss), 6) AS ranking_loss FROM c JOIN b USING (vec_id)""")
def ranked_labels(spark, d):
    """The first ten coordinates as scores of ten labels, of which two are true."""
    e = read(spark, d, "embeddings")
    flag = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i == F.col("label")) | (i == (F.col("label") + 3) % 10)).cast("int"))
    return rounded(curves.ranked_labels(e.select(flag.alias("truth"), F.slice("embedding", 1, 10).alias("scores")), "truth", "scores", 3))


@query("SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.999])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.9, 0.999])), 6) AS value FROM lineitem")
def quantiles(spark, d):
    at = [0.01, 0.25, 0.5, 0.9, 0.999]
    found = running.quantiles(read(spark, d, "lineitem"), F.col("l_extendedprice"), at)
    return rounded(spark.createDataFrame(list(zip(at, found)), "q double, value double"))


# ---- naive Bayes --------------------------------------------------------------------------------------------------------

_NB = "SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_returnflag AS l, l_linenumber::DOUBLE AS x1, l_quantity AS x2, (l_suppkey % 7)::DOUBLE AS x3 FROM lineitem"


def _counted(spark, d):
    return read(spark, d, "lineitem").select(*_KEY, F.col("l_returnflag").alias("l"), F.col("l_linenumber").cast("double").alias("x1"), F.col("l_quantity").alias("x2"), (F.col("l_suppkey") % 7).cast("double").alias("x3"))


_PICK = "SELECT l_orderkey, l_linenumber, predicted FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {by}, predicted) AS k FROM p) WHERE k = 1"


@query(f"""WITH x AS ({_NB}), c AS (SELECT l, count(*) AS n, sum(x1) + 1 AS a, sum(x2) + 1 AS b, sum(x3) + 1 AS c FROM x GROUP BY 1), m AS (SELECT l AS predicted, ln(n / (SELECT count(*) FROM x)) AS prior, ln(a / (a + b + c)) AS a, ln(b / (a + b + c)) AS b, ln(c / (a + b + c)) AS c FROM c),
p AS (SELECT rid, l_orderkey, l_linenumber, predicted, prior + x1 * a + x2 * b + x3 * c AS s FROM x, m) {_PICK.format(by='s DESC')}""")
def multinomial_naive_bayes(spark, d):
    return bayes.multinomial(_counted(spark, d), ["x1", "x2", "x3"], "l").select(*_KEY, "predicted")


@query(f"""WITH x AS ({_NB}), t AS (SELECT sum(x1) AS a, sum(x2) AS b, sum(x3) AS c FROM x), c AS (SELECT l, t.a - s.a + 1 AS a, t.b - s.b + 1 AS b, t.c - s.c + 1 AS c FROM (SELECT l, sum(x1) AS a, sum(x2) AS b, sum(x3) AS c FROM x GROUP BY 1) s, t),
w AS (SELECT l AS predicted, ln(a / (a + b + c)) AS a, ln(b / (a + b + c)) AS b, ln(c / (a + b + c)) AS c FROM c), p AS (SELECT rid, l_orderkey, l_linenumber, predicted, (x1 * a + x2 * b + x3 * c) / sqrt(a * a + b * b + c * c) AS s FROM x, w) {_PICK.format(by='s')}""")
def complement_naive_bayes(spark, d):
    return bayes.complement(_counted(spark, d), ["x1", "x2", "x3"], "l").select(*_KEY, "predicted")


@query(f"""WITH x AS (SELECT rid, l_orderkey, l_linenumber, l, (x1 > 3)::INT AS x1, (x2 > 3)::INT AS x2, (x3 > 3)::INT AS x3 FROM ({_NB})), m AS (SELECT l AS predicted, ln(count(*) / (SELECT count(*) FROM x)) AS prior, (sum(x1) + 1) / (count(*) + 2) AS a, (sum(x2) + 1) / (count(*) + 2) AS b, (sum(x3) + 1) / (count(*) + 2) AS c FROM x GROUP BY 1),
p AS (SELECT rid, l_orderkey, l_linenumber, predicted, prior + ln(CASE WHEN x1 = 1 THEN a ELSE 1 - a END) + ln(CASE WHEN x2 = 1 THEN b ELSE 1 - b END) + ln(CASE WHEN x3 = 1 THEN c ELSE 1 - c END) AS s FROM x, m) {_PICK.format(by='s DESC')}""")
def bernoulli_naive_bayes(spark, d):
    return bayes.bernoulli(_counted(spark, d), ["x1", "x2", "x3"], "l", threshold=3.0).select(*_KEY, "predicted")


ORACLE_SQL["gaussian_naive_bayes"] = f"""WITH v AS (SELECT l_returnflag AS predicted, count(*) AS n, avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, var_pop(l_quantity) AS v1, var_pop(l_extendedprice) AS v2 FROM lineitem GROUP BY 1),
g AS (SELECT *, v1 + 1e-9 * t AS w1, v2 + 1e-9 * t AS w2 FROM v, (SELECT max(greatest(v1, v2)) AS t FROM v)),
p AS (SELECT rid, l_orderkey, l_linenumber, predicted, ln(n / (SELECT count(*) FROM lineitem)) - 0.5 * (ln(2 * pi() * w1) + (l_quantity - m1) ** 2 / w1) - 0.5 * (ln(2 * pi() * w2) + (l_extendedprice - m2) ** 2 / w2) AS s FROM (SELECT row_number() OVER () AS rid, * FROM lineitem), g) {_PICK.format(by='s DESC')}"""

# ---- ticks --------------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT t, v FROM ({_TICKS}) WHERE series = 'click'), b AS (SELECT t, v FROM ({_TICKS}) WHERE series = 'view'), c AS (SELECT t FROM a UNION SELECT t FROM b)
SELECT round(x.t, 6) AS t, round((x.bid + b.v) / 2, 6) AS mid FROM (SELECT c.t, a.v AS bid FROM c ASOF LEFT JOIN a ON c.t >= a.t) x ASOF LEFT JOIN b ON x.t >= b.t""")
def mid_price(spark, d):
    t = ticks(spark, d)
    side = lambda name: t.where(F.col("series") == name).select("t", "v")
    return rounded(series.mid_price(side("click"), side("view"), "t", "v"))


_QUOTES = "SELECT user_id, ts, event_id, floor(value / 10) AS bid, floor(value / 10) + event_id % 3 AS ask, (event_id % 11)::DOUBLE AS bs, (event_id % 13)::DOUBLE AS qs FROM events"


def _quotes(spark, d):
    bid = F.floor(F.col("value") / 10).cast("double")
    return read(spark, d, "events").select("user_id", "ts", "event_id", bid.alias("bid"), (bid + F.col("event_id") % 3).alias("ask"), (F.col("event_id") % 11).cast("double").alias("bs"), (F.col("event_id") % 13).cast("double").alias("qs"))


@query(f"""WITH q AS (SELECT *, lag(bid) OVER w AS b0, lag(ask) OVER w AS a0, lag(bs) OVER w AS bs0, lag(qs) OVER w AS qs0 FROM ({_QUOTES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN b0 IS NOT NULL THEN (CASE WHEN bid > b0 THEN bs WHEN bid = b0 THEN bs - bs0 ELSE -bs0 END) + (CASE WHEN ask < a0 THEN -qs WHEN ask = a0 THEN qs0 - qs ELSE qs0 END) + 0.0 END AS ofi FROM q""")
def order_flow_imbalance(spark, d):
    return rounded(series.order_flow(_quotes(spark, d), ["user_id"], ["ts", "event_id"], "bid", "ask", "bs", "qs").select("event_id", "ofi"))


@query(f"SELECT event_id, round(bs / greatest(bs + qs, 1e-12) * ask + (1 - bs / greatest(bs + qs, 1e-12)) * bid, 6) AS microprice FROM ({_QUOTES})")
def microprice(spark, d):
    return rounded(_quotes(spark, d).select("event_id", series.microprice(*(F.col(c) for c in ("bid", "ask", "bs", "qs"))).alias("microprice")))


_STEPS = f"SELECT series, t, ln(v) - lag(ln(v)) OVER (PARTITION BY series ORDER BY t) AS r FROM ({_TICKS})"


@query(f"""WITH r AS (SELECT series, r, abs(r) * abs(lag(r) OVER (PARTITION BY series ORDER BY t)) AS b FROM ({_STEPS})), s AS (SELECT series, sum(r * r) AS qv, pi() / 2 * sum(b) AS bv, count(r) AS n, sum(r ** 4) AS q FROM r GROUP BY 1)
SELECT series, round(qv, 4) AS qv, round(bv, 4) AS bv, round(greatest(qv - bv, 0), 4) AS jump, round((qv - bv) / (sqrt((pi() * pi() / 4 + pi() - 5) * n / 3 * q) / sqrt(n)), 4) AS statistic FROM s""")
def jump_test(spark, d):
    return rounded(series.jump_test(ticks(spark, d), ["series"], ["t"], "v"), 4)


@query(f"""WITH r AS (SELECT series, r, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2, lag(r, 3) OVER w AS r3 FROM ({_STEPS}) WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, round(greatest(sum(r * r) + (1 + cos(0)) * sum(r * r1) + (1 + cos(pi() / 3)) * sum(r * r2) + (1 + cos(2 * pi() / 3)) * sum(r * r3), 0), 4) AS realised_kernel FROM r GROUP BY 1""")
def realised_kernel(spark, d):
    return rounded(series.realised_kernel(ticks(spark, d), ["series"], ["t"], "v", 3), 4)


@query(f"""WITH s AS (SELECT user_id, bid - lag(bid) OVER w AS a, ask - lag(ask) OVER w AS b FROM ({_QUOTES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, sum(a * a)::DOUBLE AS variance_a, sum(b * b)::DOUBLE AS variance_b, sum(a * b)::DOUBLE AS covariance FROM s GROUP BY 1""")
def realised_covariance(spark, d):
    return rounded(series.realised_covariance(_quotes(spark, d), ["user_id"], ["ts", "event_id"], "bid", "ask"))


ORACLE_SQL["two_scale_variance"] = f"""WITH x AS (SELECT series, ln(v) AS x, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series) - 1 AS n FROM ({_TICKS})),
f AS (SELECT series, sum((x - x0) ** 2) AS f FROM (SELECT series, x, lag(x) OVER (PARTITION BY series ORDER BY i) AS x0 FROM x) GROUP BY 1),
s AS (SELECT series, sum((x - x0) ** 2) AS s FROM (SELECT series, x, lag(x, 5) OVER (PARTITION BY series ORDER BY i) AS x0, i, n FROM x) WHERE i < n GROUP BY 1)
SELECT series, round(greatest(s / 5 - f / 5, 0), 6) AS tsrv FROM f JOIN s USING (series)"""

ORACLE_SQL["runs_and_crossings"] = """WITH e AS (SELECT user_id, ts, event_id, (value > lag(value) OVER w)::INT AS up, sign(value - avg(value) OVER (PARTITION BY user_id)) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, up, (s <> lag(s) OVER w)::INT AS c, sum(CASE WHEN up = 1 THEN 0 ELSE 1 END) OVER w AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, g, sum(coalesce(up, 0)) AS l, sum(coalesce(c, 0)) AS c FROM g GROUP BY 1, 2) SELECT user_id, max(l)::BIGINT AS longest_rise, sum(c)::BIGINT AS crossings FROM l GROUP BY 1"""

# ---- recursions ---------------------------------------------------------------------------------------------------------

_ROWS = "r AS (SELECT user_id, event_id, value::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"

ORACLE_SQL["garch_likelihood"] = f"""WITH RECURSIVE {_ROWS}, e AS (SELECT user_id, i, n, y - avg(y) OVER (PARTITION BY user_id) AS e, var_pop(y) OVER (PARTITION BY user_id) AS v FROM r),
f AS (SELECT user_id, i, n, e, v AS h, -0.5 * (ln(2 * pi() * v) + e * e / v) AS ll FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.n, e.e, 10 + 0.1 * f.e * f.e + 0.8 * f.h, f.ll - 0.5 * (ln(2 * pi() * (10 + 0.1 * f.e * f.e + 0.8 * f.h)) + e.e * e.e / (10 + 0.1 * f.e * f.e + 0.8 * f.h)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(ll, 6) AS loglik FROM f WHERE i = n"""

ORACLE_SQL["hawkes_likelihood"] = f"""WITH RECURSIVE x AS (SELECT series, (t - min(t) OVER (PARTITION BY series)) / 3600 AS t, row_number() OVER (PARTITION BY series ORDER BY t) AS i, count(*) OVER (PARTITION BY series) AS n FROM ({_TICKS})),
f AS (SELECT series, t, i, n, 0.0::DOUBLE AS a, ln(0.5) AS ll FROM x WHERE i = 1
UNION ALL SELECT x.series, x.t, x.i, x.n, exp(-(x.t - f.t)) * (1 + f.a), f.ll + ln(0.5 + 0.2 * exp(-(x.t - f.t)) * (1 + f.a)) FROM f JOIN x ON x.series = f.series AND x.i = f.i + 1),
h AS (SELECT series, max(t) + 1e-9 AS h FROM x GROUP BY 1), c AS (SELECT series, sum(1 - exp(-(h - t))) AS c, any_value(h) AS h FROM x JOIN h USING (series) GROUP BY 1)
SELECT series, round(ll - 0.5 * h - 0.2 * c, 4) AS loglik FROM f JOIN c USING (series) WHERE i = n"""

ORACLE_SQL["kalman_local_level"] = f"""WITH RECURSIVE {_ROWS},
f AS (SELECT user_id, event_id, i, n, 50 + 100.0 / 110 * (y - 50) AS m, 100 * (1 - 100.0 / 110) AS p, 100.0::DOUBLE AS prior, -0.5 * (ln(2 * pi() * 110) + (y - 50) ** 2 / 110) AS ll FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.event_id, r.i, r.n, f.m + (f.p + 1) / (f.p + 11) * (r.y - f.m), (f.p + 1) * (1 - (f.p + 1) / (f.p + 11)), f.p + 1, f.ll - 0.5 * (ln(2 * pi() * (f.p + 11)) + (r.y - f.m) ** 2 / (f.p + 11)) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1),
s AS (SELECT user_id, event_id, i, m AS s FROM f WHERE i = n UNION ALL SELECT f.user_id, f.event_id, f.i, f.m + f.p / (f.p + 1) * (s.s - f.m) FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i - 1)
SELECT f.user_id, f.event_id, round(f.m, 6) + 0.0 AS filtered, round(s.s, 6) + 0.0 AS smoothed, round(l.ll, 6) AS loglik FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i JOIN (SELECT user_id, ll FROM f WHERE i = n) l ON l.user_id = f.user_id"""

# ---- vectors ------------------------------------------------------------------------------------------------------------

_XY = "list_transform(range(1, 65), lambda i: {f})"
_A, _B = "q.embedding[i]::DOUBLE", "e.embedding[i]::DOUBLE"
_DISTANCES = {
    "manhattan": f"list_sum({_XY.format(f=f'abs({_A} - {_B})')})",
    "chebyshev": f"list_max({_XY.format(f=f'abs({_A} - {_B})')})",
    "canberra": f"list_sum({_XY.format(f=f'CASE WHEN abs({_A}) + abs({_B}) > 0 THEN abs({_A} - {_B}) / (abs({_A}) + abs({_B})) ELSE 0 END')})",
    "braycurtis": f"list_sum({_XY.format(f=f'abs({_A} - {_B})')}) / list_sum({_XY.format(f=f'abs({_A} + {_B})')})",
    "cosine": f"1 - list_sum({_XY.format(f=f'{_A} * {_B}')}) / sqrt(list_sum({_XY.format(f=f'{_A} * {_A}')}) * list_sum({_XY.format(f=f'{_B} * {_B}')}))",
}
for _metric, _sql in _DISTANCES.items():
    def _near(spark, d, metric=_metric):
        e, q = _vectors(spark, d)
        return rounded(pairwise.nearest(e, q, 5, metric=metric), 5).select("query", "neighbour", "distance", "rank")
    query(f"""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, {_sql} AS s FROM ({_Q}) q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY s, neighbour)::INTEGER AS rank, round(s, 5) AS distance FROM p) SELECT query, neighbour, distance, rank FROM r WHERE rank <= 5""", f"k_nearest_{_metric}")(_near)

_SQUARES = f"SELECT q.vec_id AS query, e.vec_id AS neighbour, e.label, list_sum({_XY.format(f=f'({_A} - {_B}) ** 2')}) AS s FROM ({_Q}) q JOIN embeddings e ON true"

ORACLE_SQL["k_neighbours_classifier"] = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s, neighbour) AS k FROM ({_SQUARES}) WHERE query <> neighbour), v AS (SELECT query, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1, 2)
SELECT query, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS k FROM v) WHERE k = 1"""
ORACLE_SQL["kernel_density"] = f"""WITH m AS (SELECT *, max(-s / 2) OVER (PARTITION BY query) AS m FROM ({_SQUARES})) SELECT query, round(any_value(m) + ln(sum(exp(-s / 2 - m))) - ln(count(*)) - 64 * 0.5 * ln(2 * pi()), 5) AS log_density FROM m GROUP BY 1"""


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s, neighbour) AS k FROM ({_SQUARES}) WHERE query <> neighbour) SELECT query, round(avg(label), 6) AS predicted FROM r WHERE k <= 5 GROUP BY 1")
def k_neighbours_regressor(spark, d):
    e, q = _vectors(spark, d)
    return rounded(pairwise.knn_regress(e, q, 5, "label"))


# ---- regression with its errors -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_pop(l_quantity) * count(*) AS aa, var_pop(l_discount) * count(*) AS bb, covar_pop(l_quantity, l_discount) * count(*) AS ab,
  covar_pop(l_quantity, l_extendedprice) * count(*) AS ay, covar_pop(l_discount, l_extendedprice) * count(*) AS by_, var_pop(l_extendedprice) * count(*) AS yy, avg(l_extendedprice) AS my FROM lineitem),
k AS (SELECT *, aa * bb - ab * ab AS det FROM s), b AS (SELECT *, (ay * bb - by_ * ab) / det AS b1, (by_ * aa - ay * ab) / det AS b2 FROM k),
v AS (SELECT *, (yy - b1 * ay - b2 * by_) / (n - 3) AS s2 FROM b)
SELECT 'intercept' AS term, round(my - b1 * ma - b2 * mb, 3) AS estimate, round(sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 4) AS se, round((my - b1 * ma - b2 * mb) / sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 4) AS t FROM v
UNION ALL SELECT 'l_quantity', round(b1, 3), round(sqrt(s2 * bb / det), 4), round(b1 / sqrt(s2 * bb / det), 4) FROM v UNION ALL SELECT 'l_discount', round(b2, 3), round(sqrt(s2 * aa / det), 4), round(b2 / sqrt(s2 * aa / det), 4) FROM v""")
def ols_standard_errors(spark, d):
    out = gram.to_df(spark, gram.ols(read(spark, d, "lineitem"), XS[:2], "l_extendedprice").value)
    return out.select("term", F.round("estimate", 3).alias("estimate"), F.round("se", 4).alias("se"), F.round("t", 4).alias("t"))


ORACLE_SQL["davies_bouldin"] = """WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum((v - m) ** 2)) AS d FROM x JOIN c USING (label, i) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((p.s + q.s) / d) AS r FROM m JOIN s p ON p.label = a JOIN s q ON q.label = b GROUP BY 1)"""


@query(name="davies_bouldin")
def _davies_bouldin(spark, d):
    return spark.createDataFrame([(round(cluster.separation(read(spark, d, "embeddings"), "embedding", "label")["davies_bouldin"], 6),)], "davies_bouldin double")
