"""Registered queries of the statistics operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..functions.expr import dot
from ..operators import cluster, feature, finance, gram, kernels, metrics, pairwise, preprocess, series, splits, text, trees
from ..sources import read, ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a stated precision: sums depend on the order of rows in their last bits. No negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


XS = ["l_quantity", "l_discount", "l_tax"]

# ---- linear models ------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt, avg(l_extendedprice) AS my,
  var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, var_pop(l_tax) AS tt, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_quantity, l_tax) AS qt,
  covar_pop(l_discount, l_tax) AS dt, covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, covar_pop(l_tax, l_extendedprice) AS ty FROM lineitem),
k AS (SELECT *, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det FROM s),
b AS (SELECT *, (qy * (dd * tt - dt * dt) - qd * (dy * tt - dt * ty) + qt * (dy * dt - dd * ty)) / det AS b1,
  (qq * (dy * tt - dt * ty) - qy * (qd * tt - dt * qt) + qt * (qd * ty - dy * qt)) / det AS b2,
  (qq * (dd * ty - dy * dt) - qd * (qd * ty - dy * qt) + qy * (qd * dt - dd * qt)) / det AS b3 FROM k)
SELECT 'intercept' AS term, round(my - b1 * mq - b2 * md - b3 * mt, 3) AS estimate FROM b
UNION ALL SELECT 'l_quantity', round(b1, 3) FROM b UNION ALL SELECT 'l_discount', round(b2, 3) FROM b UNION ALL SELECT 'l_tax', round(b3, 3) FROM b""")
def ols_lineitem(spark, d):
    return rounded(gram.to_df(spark, gram.ols(read(spark, d, "lineitem"), XS, "l_extendedprice").value).select("term", "estimate"), 3)


@query()
def ols_inference(spark, d):
    return gram.to_df(spark, gram.ols(read(spark, d, "lineitem"), XS, "l_extendedprice").value)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_simple(spark, d):
    f = gram.ols(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").value
    return spark.createDataFrame([(round(float(f.coef[0]), 4), round(float(f.intercept), 4), round(float(f.r2), 8))], "slope double, intercept double, r2 double")


@query("""WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my FROM lineitem)
SELECT round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) * (l_discount - mx)), 4) AS slope FROM lineitem, m""")
def wls_lineitem(spark, d):
    f = gram.ols(read(spark, d, "lineitem"), ["l_discount"], "l_extendedprice", weight="l_quantity").value
    return spark.createDataFrame([(round(float(f.coef[0]), 4),)], "slope double")


@query("""WITH s AS (SELECT count(*) AS n, var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT round(n * c / (n * v + 1000.0), 5) AS slope FROM s""")
def ridge_lineitem(spark, d):
    return spark.createDataFrame([(round(float(gram.ridge(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 1000.0).value.coef[0]), 5),)], "slope double")


@query("""WITH s AS (SELECT var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT round(sign(c) * greatest(abs(c) - 100.0 * 0.5, 0) / (v + 100.0 * 0.5), 5) AS slope FROM s""")
def elastic_net_lineitem(spark, d):
    return spark.createDataFrame([(round(float(gram.elastic_net(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 100.0, 0.5).value.coef[0]), 5),)], "slope double")


@query()
def ridge_cross_validated(spark, d):
    li = splits.stratified_k_fold(read(spark, d, "lineitem"), "l_linenumber", ["l_orderkey"], 5)
    best, errors = gram.ridge_cv(li, XS, "l_extendedprice", [0.1, 1.0, 10.0, 100.0, 1000.0], "fold")
    return spark.createDataFrame([(k, v, k == best) for k, v in errors.items()], "lam double, mse double, best boolean")


@query()
def logistic_returnflag(spark, d):
    li = read(spark, d, "lineitem").select(*XS, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    return gram.to_df(spark, gram.glm(li, XS, "y").value)


@query()
def poisson_part_size(spark, d):
    return gram.to_df(spark, gram.glm(read(spark, d, "part"), ["p_retailprice"], "p_size", "poisson").value)


# ---- preprocessing ------------------------------------------------------------------------------------------------------

_KEY = ["l_orderkey", "l_linenumber"]


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) + 0.0 AS l_quantity, round((l_extendedprice - m2) / s2, 6) + 0.0 AS l_extendedprice FROM lineitem, s""")
def standard_scaler(spark, d):
    li, cols = read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    return rounded(preprocess.standard_scaler(li, cols).transform(li).select(*_KEY, *cols))


@query("""WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity FROM lineitem, s""")
def min_max_scaler(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(preprocess.min_max_scaler(li, ["l_quantity"]).transform(li).select(*_KEY, "l_quantity"))


@query("""WITH s AS (SELECT max(abs(c_acctbal)) AS b FROM customer) SELECT c_custkey, round(c_acctbal / b, 6) + 0.0 AS c_acctbal FROM customer, s""")
def max_abs_scaler(spark, d):
    c = read(spark, d, "customer")
    return rounded(preprocess.max_abs_scaler(c, ["c_acctbal"]).transform(c).select("c_custkey", "c_acctbal"))


@query("""WITH s AS (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer)
SELECT c_custkey, round((c_acctbal - m) / r, 6) + 0.0 AS c_acctbal FROM customer, s""")
def robust_scaler(spark, d):
    c = read(spark, d, "customer")
    return rounded(preprocess.robust_scaler(c, ["c_acctbal"]).transform(c).select("c_custkey", "c_acctbal"))


for _norm, _sql in (("l1", "(abs(l_quantity) + abs(l_tax))"), ("l2", "sqrt(l_quantity * l_quantity + l_tax * l_tax)"), ("max", "greatest(abs(l_quantity), abs(l_tax))")):
    def _normalized(spark, d, n=_norm):
        return rounded(preprocess.normalize(read(spark, d, "lineitem"), ["l_quantity", "l_tax"], n).select(*_KEY, "l_quantity", "l_tax"))
    query(f"SELECT l_orderkey, l_linenumber, round(l_quantity / {_sql}, 6) AS l_quantity, round(l_tax / {_sql}, 6) AS l_tax FROM lineitem", f"normalizer_{_norm}")(_normalized)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS big FROM lineitem")
def binarizer(spark, d):
    return read(spark, d, "lineitem").select(*_KEY, preprocess.binarize(F.col("l_quantity"), 25).alias("big"))


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code FROM customer")
def ordinal_encoder(spark, d):
    return preprocess.ordinal_encode(read(spark, d, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("SELECT l_returnflag, l_linenumber, count(*) AS n, sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS \"l_returnflag_A\", sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS \"l_returnflag_N\", sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS \"l_returnflag_R\" FROM lineitem GROUP BY 1, 2")
def one_hot_encoder(spark, d):
    h = preprocess.one_hot(read(spark, d, "lineitem"), "l_returnflag")
    cols = [c for c in h.columns if c.startswith("l_returnflag_")]
    return h.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in cols))


@query("""WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT sum(s) / sum(n) AS m FROM g)
SELECT o_orderkey, round((s + 10 * m) / (n + 10), 4) AS code FROM orders JOIN g USING (o_orderpriority), m""")
def target_encoder(spark, d):
    return rounded(preprocess.target_encode(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "code", 10.0).select("o_orderkey", "code"), 4)


for _s, _fill in (("mean", "avg(c_acctbal)"), ("median", "quantile_cont(c_acctbal, 0.5)")):
    def _imputed(spark, d, s=_s):
        c = read(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
        return rounded(preprocess.impute(c, ["c_acctbal"], s).select("c_custkey", "c_acctbal"), 4)
    query(f"WITH s AS (SELECT {_fill} AS f FROM customer WHERE c_acctbal >= 0) SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE f END, 4) AS c_acctbal FROM customer, s", f"simple_imputer_{_s}")(_imputed)


@query("""WITH s AS (SELECT p_size AS f FROM part WHERE p_size > 5 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size ELSE f END AS p_size FROM part, s""")
def simple_imputer_most_frequent(spark, d):
    p = read(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size")))
    return preprocess.impute(p, ["p_size"], "most_frequent").select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS c_acctbal_missing FROM customer")
def missing_indicator(spark, d):
    c = read(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return preprocess.missing_indicator(c, ["c_acctbal"]).select("c_custkey", "c_acctbal_missing")


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS bias, round(l_quantity * l_quantity, 6) AS "l_quantity*l_quantity", round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_tax * l_tax, 6) AS "l_tax*l_tax" FROM lineitem""")
def polynomial_features(spark, d):
    p = preprocess.polynomial(read(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return rounded(p.select(*_KEY, "bias", *(F.col(f"`{c}`") for c in p.columns if "*" in c)))


@query("""WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT c_custkey, (CASE WHEN c_acctbal >= a + (b - a) * 1 / 4 THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= a + (b - a) * 2 / 4 THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= a + (b - a) * 3 / 4 THEN 1 ELSE 0 END)::INTEGER AS bin FROM customer, s""")
def k_bins_uniform(spark, d):
    return preprocess.k_bins(read(spark, d, "customer"), "c_acctbal", 4, "bin").select("c_custkey", F.col("bin").cast("int").alias("bin"))


@query("""WITH s AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, (CASE WHEN c_acctbal >= q[1] THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= q[2] THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= q[3] THEN 1 ELSE 0 END)::INTEGER AS bin FROM customer, s""")
def k_bins_quantile(spark, d):
    return preprocess.k_bins(read(spark, d, "customer"), "c_acctbal", 4, "bin", "quantile").select("c_custkey", F.col("bin").cast("int").alias("bin"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS v FROM orders")
def function_transformer_log1p(spark, d):
    return rounded(read(spark, d, "orders").select("o_orderkey", preprocess.elementwise(F.col("o_totalprice"), "log1p").alias("v")))


@query()
def power_transformer(spark, d):
    out, lam = preprocess.power_transform(read(spark, d, "customer"), "c_acctbal", "v")
    return rounded(out.select("c_custkey", "v", F.lit(lam).alias("lam")))


@query()
def quantile_transformer(spark, d):
    return rounded(preprocess.quantile_transform(read(spark, d, "customer"), "c_acctbal", "v").select("c_custkey", "v"))


# ---- feature scores -----------------------------------------------------------------------------------------------------


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, round(unnest([var_samp(l_quantity), var_samp(l_discount), var_samp(l_tax)]), 8) AS variance FROM lineitem")
def variance_threshold(spark, d):
    return rounded(feature.variances(read(spark, d, "lineitem"), XS), 8)


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY 1),
s AS (SELECT sum(n) AS n, count(*) AS k, sum(w) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
SELECT 'c_acctbal' AS feature, round((b / (k - 1)) / (w / (n - k)), 5) AS score FROM s""")
def f_classif(spark, d):
    return rounded(feature.f_classif(read(spark, d, "customer"), ["c_acctbal"], "c_mktsegment").select("feature", "score"), 5)


@query("""WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS di FROM lineitem)
SELECT 'l_discount' AS feature, round(di * di / (1 - di * di) * (n - 2), 4) AS score FROM r UNION ALL SELECT 'l_quantity', round(q * q / (1 - q * q) * (n - 2), 4) FROM r""")
def f_regression(spark, d):
    return rounded(feature.f_regression(read(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").select("feature", "score"), 4)


@query("""WITH g AS (SELECT l_returnflag, sum(l_quantity) AS o, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT o, sum(o) OVER () * n / sum(n) OVER () AS e FROM g)
SELECT 'l_quantity' AS feature, round(sum((o - e) * (o - e) / e), 5) AS score FROM e""")
def chi2(spark, d):
    return rounded(feature.chi2(read(spark, d, "lineitem"), ["l_quantity"], "l_returnflag"), 5)


@query("""WITH j AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT n, sum(n) OVER (PARTITION BY l_returnflag) AS a, sum(n) OVER (PARTITION BY l_linestatus) AS b, sum(n) OVER () AS t FROM j)
SELECT round(sum(n / t * ln(n * t / (a * b))), 8) AS mi FROM k""")
def mutual_information(spark, d):
    return rounded(feature.mutual_information(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 8)


@query("SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_features(spark, d):
    return feature.lag_features(read(spark, d, "events"), "value", [1, 3], ["user_id"], ["ts", "event_id"]).select("event_id", "value_lag1", "value_lag3")


@query("SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, d):
    return rounded(feature.rolling_mean(read(spark, d, "events"), "value", 5, ["user_id"], ["ts", "event_id"], "m").select("event_id", "m"))


# ---- text ---------------------------------------------------------------------------------------------------------------

_TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents"


@query(f"WITH t AS (SELECT doc_id, term, count(*) AS n FROM ({_TERMS}) GROUP BY 1, 2), f AS (SELECT term FROM t GROUP BY 1 HAVING count(*) >= 3) SELECT doc_id, term, n FROM t JOIN f USING (term)")
def count_vectorizer(spark, d):
    return text.count_vectorize(read(spark, d, "documents"), "doc_id", "text", 3)


@query(f"""WITH t AS (SELECT doc_id, term, count(*) AS n FROM ({_TERMS}) GROUP BY 1, 2), f AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM t GROUP BY 1),
w AS (SELECT doc_id, term, n * idf AS w FROM t JOIN f USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_vectorizer(spark, d):
    return rounded(text.tfidf(read(spark, d, "documents"), "doc_id", "text"))


@query()
def hashing_vectorizer(spark, d):
    return text.hashing_vectorize(read(spark, d, "documents"), "doc_id", "text")


@query("""SELECT event_id, 'k' AS key, cast(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def dict_vectorizer(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("r")).where("r is not null")
    return text.dict_vectorize(e, "event_id", "r")


# ---- metrics ------------------------------------------------------------------------------------------------------------

_LABELLED = "SELECT toxic AS y, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS p, (n_chars % 1000) / 1000.0 AS s, quality FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return j.select(F.col("toxic").alias("y"), F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0).alias("p"), ((F.col("n_chars") % 1000) / 1000.0).alias("s"), "quality")


@query(f"SELECT y::BIGINT AS y, p::BIGINT AS p, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_labelled(spark, d), "y", "p")


@query(f"""WITH c AS (SELECT count(*)::DOUBLE AS n, sum((y = p)::INT)::DOUBLE AS ok, sum((y = 1 AND p = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND p = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND p = 0)::INT)::DOUBLE AS fn, sum((y = 0 AND p = 0)::INT)::DOUBLE AS tn FROM ({_LABELLED})),
e AS (SELECT *, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c)
SELECT round(ok / n, 6) AS accuracy, round((re + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((ok / n - pe) / (1 - pe), 6) + 0.0 AS kappa, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc,
round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM e""")
def classification_metrics(spark, d):
    return rounded(metrics.classification(_labelled(spark, d), "y", "p"))


@query(f"WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({_LABELLED})) SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_labelled(spark, d), "y", "s"))


@query(f"WITH g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM ({_LABELLED}) GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return rounded(metrics.average_precision(_labelled(spark, d), "y", "s"))


@query(f"WITH q AS (SELECT y, s, least(greatest(s, 1e-15), 1 - 1e-15) AS q FROM ({_LABELLED})) SELECT round(avg(-CASE WHEN y >= 0.5 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(greatest(0, 1 - (2 * y - 1) * (2 * s - 1))), 6) AS hinge FROM q")
def probability_metrics(spark, d):
    return rounded(metrics.probability(_labelled(spark, d), "y", "s"))


@query(f"SELECT least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(s), 6) AS mean_p, round(avg(y), 6) AS share FROM ({_LABELLED}) GROUP BY 1")
def calibration_curve(spark, d):
    return rounded(metrics.calibration_curve(_labelled(spark, d), "y", "s"))


@query("""WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p, l_extendedprice - l_quantity * 1500.0 AS e FROM lineitem)
SELECT count(*) AS n, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(max(abs(e)), 4) AS max_error, round(avg(abs(e / y)), 4) AS mape, round(quantile_cont(abs(e), 0.5), 4) AS medae,
round(1 - avg(e * e) / var_pop(y), 4) AS r2, round(1 - var_pop(e) / var_pop(y), 4) AS explained_variance, round(avg(e), 4) AS bias, round(avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p))), 4) AS msle FROM e""")
def regression_metrics(spark, d):
    out = metrics.regression(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p")
    return rounded(out.withColumn("mse", F.round("mse", 2)), 4)


@query("SELECT round(avg(CASE WHEN l_extendedprice >= l_quantity * 1500.0 THEN 0.9 * (l_extendedprice - l_quantity * 1500.0) ELSE (0.9 - 1) * (l_extendedprice - l_quantity * 1500.0) END), 4) AS pinball FROM lineitem")
def pinball_loss(spark, d):
    return rounded(metrics.pinball(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p", 0.9), 4)


for _pw, _unit in ((1, "2 * (CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END - y + p)"), (2, "2 * (y / p - ln(y / p) - 1)")):
    def _dev(spark, d, pw=_pw):
        return rounded(metrics.deviance(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p", pw), 4)
    query(f"SELECT round(avg({_unit}), 4) AS deviance FROM (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)", "poisson_deviance" if _pw == 1 else "gamma_deviance")(_dev)


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
j AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), t),
ha AS (SELECT sum(na * (na - 1) / 2) AS ia, sum(-na / t * ln(na / t)) AS ha FROM ra, t), hb AS (SELECT sum(nb * (nb - 1) / 2) AS ib, sum(-nb / t * ln(nb / t)) AS hb FROM rb, t),
k AS (SELECT *, t * (t - 1) / 2 AS p FROM j, ha, hb, t)
SELECT round((p + 2 * ij - ia - ib) / p, 6) AS rand, round((ij - ia * ib / p) / ((ia + ib) / 2 - ia * ib / p), 6) AS ari, round(mi, 6) AS mi, round(mi / sqrt(ha * hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * mi / (ha + hb), 6) AS v_measure FROM k""")
def clustering_metrics(spark, d):
    return rounded(metrics.clustering(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""WITH r AS (SELECT l_orderkey, 2 ** (l_linenumber % 4) - 1 AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 4 DESC) AS i FROM lineitem),
s AS (SELECT l_orderkey, sum(CASE WHEN r <= 3 THEN g / log2(r + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 3 THEN g / log2(i + 1.0) ELSE 0 END) AS ideal FROM r GROUP BY 1)
SELECT l_orderkey, round(dcg, 6) AS dcg, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg(spark, d):
    li = read(spark, d, "lineitem").withColumn("rel", F.col("l_linenumber") % 4)
    return rounded(metrics.dcg(li, "l_orderkey", "rel", [F.desc("l_extendedprice"), F.col("l_linenumber")], 3))


@query("""WITH s AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT user_id, round(avg(abs(value - 50)) / avg(d), 6) AS mase FROM s GROUP BY 1""")
def mase(spark, d):
    return rounded(metrics.mase(read(spark, d, "events").withColumn("p", F.lit(50.0)), "user_id", ["ts", "event_id"], "value", "p"))


# ---- splits -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, ((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) % 5)::INTEGER AS fold FROM lineitem")
def k_fold(spark, d):
    return splits.k_fold(read(spark, d, "lineitem").select(*_KEY), _KEY, 5)


@query("SELECT l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) % 5)::INTEGER AS fold FROM lineitem")
def stratified_k_fold(spark, d):
    return splits.stratified_k_fold(read(spark, d, "lineitem"), "l_returnflag", _KEY, 5).select(*_KEY, "fold")


@query("SELECT o_orderkey, ((dense_rank() OVER (ORDER BY o_custkey) - 1) % 5)::INTEGER AS fold FROM orders")
def group_k_fold(spark, d):
    return splits.group_k_fold(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "fold")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), s AS (SELECT *, n // 5 AS b FROM r)
SELECT o_orderkey, CASE WHEN i >= n - 4 * b THEN (i - (n - 4 * b)) // b END::INTEGER AS test_of FROM s""")
def time_series_split(spark, d):
    return splits.time_series_split(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "test_of")


# ---- series -------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS std, round(skewness_pop, 4) + 0.0 AS skew, round(kurtosis_pop(value), 4) + 0.0 AS kurtosis, round(min(value), 4) AS low, round(max(value), 4) AS high FROM (SELECT e.*, k.s AS skewness_pop FROM events e JOIN (SELECT user_id, avg(z * z * z) / (avg(z * z) * sqrt(avg(z * z))) AS s FROM (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS z FROM events) GROUP BY 1) k USING (user_id)) GROUP BY user_id, skewness_pop")
def online_moments(spark, d):
    return rounded(series.moments(read(spark, d, "events"), ["user_id"], "value"), 4)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS n_eff FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return rounded(series.weighted_mean(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), 4)


@query("SELECT l_returnflag, round(covar_samp(l_extendedprice, l_quantity), 3) AS covariance, round(corr(l_extendedprice, l_quantity), 3) + 0.0 AS correlation FROM lineitem GROUP BY 1")
def online_covariance(spark, d):
    return rounded(series.covariance(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), 3)


@query("WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) SELECT user_id, round(CASE WHEN count(*) >= 3 THEN corr(value, l) END, 6) AS autocorrelation FROM l GROUP BY 1")
def autocorrelation(spark, d):
    return rounded(series.autocorrelation(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), w AS (SELECT *, CASE WHEN i = 1 THEN 0.9 ** (n - 1) ELSE 0.1 * 0.9 ** (n - i) END AS w FROM r)
SELECT user_id, round(sum(w * value), 6) AS ew_mean, round(1 / sum(w * w), 6) AS n_eff FROM w GROUP BY 1""")
def exponentially_weighted_mean(spark, d):
    return rounded(series.exponentially_weighted(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 0.1).drop("ew_variance"))


_TICKS = "SELECT event_type AS series, epoch_us(ts) / 1e6 AS t, max(event_id) AS seq, arg_max(value, event_id) AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2"
_RETURNS = f"SELECT series, t, ln(v) - lag(ln(v)) OVER (PARTITION BY series ORDER BY t) AS r FROM ({_TICKS})"


@query(f"""WITH r AS (SELECT * FROM ({_RETURNS}) WHERE r IS NOT NULL), q AS (SELECT series, r, abs(r) * abs(lag(r) OVER w) AS b, abs(r) * abs(lag(r) OVER w) * abs(lag(r, 2) OVER w) * abs(lag(r, 3) OVER w) AS q FROM r WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, round(sum(r * r), 4) AS rv, round(pi() / 2 * sum(b), 4) AS bipower, round(count(*) / 3.0 * sum(r * r * r * r), 2) AS quarticity, round(count(*) / power(2 / pi(), 2) * sum(q), 2) AS quadpower FROM q GROUP BY 1""")
def realised_variance(spark, d):
    out = series.realised(ticks(spark, d), ["series"], ["t"], "v")
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("quarticity", "quadpower")}), 4)


@query(f"""WITH c AS (SELECT series, t, v - lag(v) OVER (PARTITION BY series ORDER BY t) AS d FROM ({_TICKS})), e AS (SELECT series, d, lag(d) OVER (PARTITION BY series ORDER BY t) AS e FROM c)
SELECT series, round(CASE WHEN covar_samp(d, e) < 0 THEN 2 * sqrt(-covar_samp(d, e)) ELSE 0 END, 5) AS spread FROM e WHERE e IS NOT NULL GROUP BY 1""")
def roll_spread(spark, d):
    return rounded(series.roll_spread(ticks(spark, d), ["series"], ["t"], "v"), 5)


@query(f"""WITH c AS (SELECT series, v - lag(v) OVER (PARTITION BY series ORDER BY t) AS d, CASE WHEN seq % 2 = 0 THEN 1.0 ELSE -1.0 END * (seq % 10) AS f FROM ({_TICKS})) SELECT series, round(regr_slope(d, f), 5) AS lambda FROM c WHERE d IS NOT NULL GROUP BY 1""")
def kyle_lambda(spark, d):
    t = ticks(spark, d).withColumn("f", F.when(F.col("seq") % 2 == 0, 1.0).otherwise(-1.0) * (F.col("seq") % 10))
    return rounded(series.kyle_lambda(t, ["series"], ["t"], "v", "f"), 5)


@query(f"WITH c AS (SELECT series, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS d FROM ({_TICKS})) SELECT series, count(*) AS n, round(avg(d), 3) AS mean, round(max(d), 3) AS longest FROM c WHERE d IS NOT NULL GROUP BY 1")
def trade_durations(spark, d):
    return rounded(series.durations(ticks(spark, d), ["series"], "t"), 3)


@query(f"WITH a AS (SELECT seq, t FROM ({_TICKS}) WHERE series = 'click'), b AS (SELECT t, v FROM ({_TICKS}) WHERE series = 'view') SELECT seq, v AS previous FROM a ASOF LEFT JOIN b ON a.t >= b.t")
def previous_tick(spark, d):
    t = ticks(spark, d)
    names = [r[0] for r in t.select("series").distinct().collect()]  # a handful of series
    a, b = ("click" if "click" in names else names[0]), ("view" if "view" in names else names[-1])
    return series.asof(t.where(F.col("series") == a).select("seq", "t"), t.where(F.col("series") == b).select("t", "v"), "t", "v", "previous").select("seq", "previous")


@query(f"""WITH i AS (SELECT series, lag(t) OVER w AS t0, t AS t1, v - lag(v) OVER w AS d FROM ({_TICKS}) WINDOW w AS (PARTITION BY series ORDER BY t)), a AS (SELECT * FROM i WHERE series = 'click' AND t0 IS NOT NULL), b AS (SELECT * FROM i WHERE series = 'view' AND t0 IS NOT NULL)
SELECT round(sum(a.d * b.d), 3) AS covariance FROM a JOIN b ON a.t0 < b.t1 AND b.t0 < a.t1""")
def hayashi_yoshida(spark, d):
    t = ticks(spark, d)
    a = series.intervals(t.where("series = 'click'"), "series", "t", "v", "a")
    b = series.intervals(t.where("series = 'view'"), "series", "t", "v", "b")
    width = a.agg(F.avg(F.col("a1") - F.col("a0"))).first()[0] or 1.0
    return rounded(series.hayashi_yoshida(a, b, max(width, 1e-3)), 3)


@query()
def runs_and_crossings(spark, d):
    return series.runs(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")


# ---- sequence kernels: once for each key --------------------------------------------------------------------------------


@query()
def kalman_local_level(spark, d):
    import pandas as pd

    def run(p):
        m, v, ll = kernels.kalman_local_level(p["value"].to_numpy(float), 1.0, 10.0, 50.0, 100.0)
        s, _ = kernels.rts_smooth(m, v, 1.0)
        return pd.DataFrame({"event_id": p["event_id"].to_numpy(), "filtered": m, "smoothed": s, "loglik": ll})

    return rounded(series.per_key(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "event_id long, filtered double, smoothed double, loglik double", run))


@query()
def hmm_event_types(spark, d):
    import numpy as np
    import pandas as pd

    e = read(spark, d, "events")
    codes = {r[0]: i for i, r in enumerate(e.select("event_type").distinct().orderBy("event_type").collect())}  # a handful of types

    def run(p):
        n = len(codes)
        emit = np.log(np.stack([np.full(n, 1 / n), np.arange(1, n + 1) / (n * (n + 1) / 2)], 1))
        start, move = np.log([0.5, 0.5]), np.log([[0.9, 0.1], [0.2, 0.8]])
        x = emit[p["event_type"].map(codes).to_numpy()]
        path, lp = kernels.hmm_viterbi(start, move, x)
        return pd.DataFrame({"event_id": p["event_id"].to_numpy(), "state": path, "viterbi": lp, "loglik": kernels.hmm_forward(start, move, x)})

    return rounded(series.per_key(e.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_id long, state int, viterbi double, loglik double", run))


@query()
def garch_likelihood(spark, d):
    import pandas as pd

    return rounded(series.per_key(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "loglik double",
                                  lambda p: pd.DataFrame({"loglik": [kernels.garch_loglik(p["value"].to_numpy(float), 10.0, 0.1, 0.8)]})))


@query()
def hawkes_likelihood(spark, d):
    import pandas as pd

    def run(p):
        t = p["t"].to_numpy(float)
        t = (t - t[0]) / 3600
        return pd.DataFrame({"loglik": [kernels.hawkes_loglik(t, float(t[-1]) + 1e-9, 0.5, 0.2, 1.0)]})

    return rounded(series.per_key(ticks(spark, d), "series", ["t"], "loglik double", run), 4)


# ---- vectors ------------------------------------------------------------------------------------------------------------

_Q = "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0"


def _vectors(spark, d):
    e = read(spark, d, "embeddings")
    return e, e.where(F.col("vec_id") % 50 == 0)


@query(f"""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) ** 2)) AS s FROM ({_Q}) q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY s, neighbour)::INTEGER AS rank, round(sqrt(s), 5) AS distance FROM p) SELECT query, neighbour, distance, rank FROM r WHERE rank <= 5""")
def k_nearest(spark, d):
    e, q = _vectors(spark, d)
    return rounded(pairwise.nearest(e, q, 5), 5).select("query", "neighbour", "distance", "rank")


@query()
def k_neighbours_classifier(spark, d):
    e, q = _vectors(spark, d)
    return pairwise.knn_classify(e, q, 5)


@query()
def kernel_density(spark, d):
    e, q = _vectors(spark, d)
    return rounded(pairwise.density(e, q, 1.0), 5)


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), p AS (SELECT vec_id, c.label AS predicted, sum((embedding[i]::DOUBLE - m) ** 2) AS s FROM embeddings JOIN c ON true GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, predicted) AS k FROM p) SELECT vec_id, predicted, round(sqrt(s), 5) AS distance FROM r WHERE k = 1""")
def nearest_centroid(spark, d):
    return rounded(cluster.nearest_centroid(read(spark, d, "embeddings"), "embedding", "label", "vec_id"), 5)


@query()
def k_means(spark, d):
    e = read(spark, d, "embeddings")
    centres, inertia, rounds = cluster.k_means(e, "embedding", 10, "vec_id")
    return cluster.assign(e, "embedding", centres, "cluster", "vec_id").select("vec_id", "cluster", F.lit(inertia).alias("inertia"), F.lit(rounds).alias("rounds"))


@query()
def principal_components(spark, d):
    values, share, _ = cluster.pca(read(spark, d, "embeddings"), "embedding", 10)
    return spark.createDataFrame([(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(values, share))], "component int, variance double, share double")


@query()
def linear_discriminant(spark, d):
    return cluster.discriminant(read(spark, d, "embeddings"), "embedding", "label", "vec_id")


@query()
def quadratic_discriminant(spark, d):
    return cluster.discriminant(read(spark, d, "embeddings"), "embedding", "label", "vec_id", quadratic=True)


@query()
def gaussian_naive_bayes(spark, d):
    return cluster.gaussian_nb(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag").select(*_KEY, "predicted")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def vector_norm(spark, d):
    return rounded(read(spark, d, "embeddings").select("vec_id", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")), 5)


# ---- transport and prices -----------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_quantity AS x, sum((l_linestatus = 'O')::INT) AS a, sum((l_linestatus <> 'O')::INT) AS b FROM lineitem GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS cb, lead(x) OVER (ORDER BY x) - x AS dx FROM g)
SELECT round(sum(abs(ca - cb) * dx), 6) AS wasserstein FROM c""")
def wasserstein(spark, d):
    li = read(spark, d, "lineitem").withColumn("side", F.when(F.col("l_linestatus") == "O", 0).otherwise(1))
    return rounded(finance.wasserstein_1d(li, "l_quantity", "side"))


@query()
def black_scholes(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("s"), (F.lit(900.0) + 10 * F.col("p_size")).alias("k"))
    args = (F.col("s"), F.col("k"), F.lit(0.03), F.lit(0.2), F.lit(1.0))
    return rounded(p.select("p_partkey", finance.black_scholes(*args).alias("call"), finance.black_scholes(*args, call=False).alias("put")))


@query()
def asian_option(spark, d):
    paths = finance.gbm_paths(spark, 20_000, 50, 100.0, 0.03, 0.2, 1.0)
    pay = F.exp(F.lit(-0.03)) * F.greatest(F.col("mean") - 100, F.lit(0.0))
    return paths.agg(F.avg(pay).alias("price"), (F.stddev_samp(pay) / F.sqrt(F.count("*"))).alias("se"), F.avg("last").alias("mean_last"))


@query("SELECT unnest([0.0, 0.5, 1.0, 2.0, 3.0])::DOUBLE AS z, round(unnest([0.5, 0.691462461274, 0.841344746069, 0.977249868052, 0.998650101968]), 9) AS p")
def normal_distribution(spark, d):
    return rounded(spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.0, 2.0, 3.0)], "z double").select("z", special.column(special.norm_cdf, F.col("z")).alias("p")), 9)


# ---- trees --------------------------------------------------------------------------------------------------------------


@query()
def regression_tree(spark, d):
    li = read(spark, d, "lineitem")
    nodes = trees.grow(li, XS, "l_extendedprice", depth=3)
    return rounded(li.groupBy(trees.leaf(nodes).alias("leaf")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")), 4)


@query("""WITH e AS (SELECT DISTINCT l_linenumber AS e FROM lineitem WHERE l_linenumber < 7), t AS (SELECT count(*) AS n, sum(l_extendedprice) AS s FROM lineitem),
g AS (SELECT e, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem JOIN e ON l_linenumber <= e GROUP BY 1), b AS (SELECT e FROM g, t ORDER BY g.s * g.s / g.n + (t.s - g.s) * (t.s - g.s) / (t.n - g.n) DESC, e LIMIT 1)
SELECT (l_linenumber <= e)::BOOLEAN AS left_side, count(*) AS n, round(avg(l_extendedprice), 3) AS mean FROM lineitem, b GROUP BY 1""")
def stump(spark, d):
    li = read(spark, d, "lineitem")
    nodes = trees.grow(li, ["l_linenumber"], "l_extendedprice", depth=1, bins=256)
    return rounded(li.groupBy((F.col("l_linenumber") <= F.lit(nodes[0].threshold)).alias("left_side")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")), 3)


@query()
def forest_regression(spark, d):
    li = read(spark, d, "lineitem")
    grown = trees.forest(li, XS, "l_extendedprice", trees=3, depth=2)
    p = sum((trees.predict(t) for t in grown[1:]), trees.predict(grown[0])) / len(grown)
    return metrics.regression(li.withColumn("p", p), "l_extendedprice", "p")


@query()
def boosted_regression(spark, d):
    li = read(spark, d, "lineitem")
    start, grown = trees.boost(li, XS, "l_extendedprice", rounds=4, rate=0.5)
    p = F.lit(start)
    for t in grown:
        p = p + 0.5 * trees.predict(t)
    return metrics.regression(li.withColumn("p", p), "l_extendedprice", "p")


@query()
def hawkes_fit(spark, d):
    import pandas as pd

    def run(p):
        t = p["t"].to_numpy(float)
        t = (t - t[0]) / 3600
        mu, alpha, beta = kernels.hawkes_fit(t, float(t[-1]) + 1e-9)
        return pd.DataFrame({"mu": [mu], "alpha": [alpha], "beta": [beta]})

    return series.per_key(ticks(spark, d), "series", ["t"], "mu double, alpha double, beta double", run)


@query()
def mean_reversion_fit(spark, d):
    import pandas as pd

    def run(p):
        kappa, theta, sigma = kernels.ou_fit(p["value"].to_numpy(float), 1.0)
        return pd.DataFrame({"kappa": [kappa], "theta": [theta], "sigma": [sigma]})

    return rounded(series.per_key(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "kappa double, theta double, sigma double", run))


@query()
def particle_filter(spark, d):
    import pandas as pd

    def run(p):
        m, ll = kernels.bootstrap_filter(p["value"].to_numpy(float), 1.0, 10.0, 50.0, 100.0)
        return pd.DataFrame({"event_id": p["event_id"].to_numpy(), "filtered": m, "loglik": ll})

    return series.per_key(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "event_id long, filtered double, loglik double", run)


@query()
def recursive_least_squares(spark, d):
    import pandas as pd

    def run(p):
        theta, _ = kernels.recursive_least_squares(p[["l_quantity", "l_discount"]].to_numpy(float), p["l_extendedprice"].to_numpy(float), 0.999)
        return pd.DataFrame({"term": ["intercept", "l_quantity", "l_discount"], "estimate": theta})

    return series.per_key(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"), "l_suppkey", _KEY, "term string, estimate double", run)


# ---- more of each -------------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT unnest([0, 1])::BIGINT AS label), k AS (SELECT label, sum((y = label AND p = label)::INT) AS tp, sum((y <> label AND p = label)::INT) AS fp, sum((y = label AND p <> label)::INT) AS fn, sum((y <> label AND p <> label)::INT) AS tn FROM c, ({_LABELLED}) GROUP BY 1)
SELECT label, round(tp / (tp + fp + fn), 6) AS jaccard, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_beta, round(tn / (tn + fp), 6) AS specificity FROM k""")
def scores_by_class(spark, d):
    return rounded(metrics.scores_by_class(_labelled(spark, d), "y", "p"))


@query(f"WITH g AS (SELECT s, sum(y) AS a, count(*) - sum(y) AS b FROM ({_LABELLED}) GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY s) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY s) / sum(b) OVER () AS cb FROM g) SELECT round(max(abs(ca - cb)), 6) AS ks FROM c")
def kolmogorov_smirnov(spark, d):
    return rounded(metrics.kolmogorov_smirnov(_labelled(spark, d), "y", "s"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def grouped_regression(spark, d):
    out = gram.grouped_slopes(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT event_id, CASE WHEN count(*) OVER w >= 20 THEN round(regr_slope(value, event_id % 100) OVER w, 4) + 0.0 END AS slope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def rolling_regression(spark, d):
    e = read(spark, d, "events").withColumn("x", F.col("event_id") % 100)
    return rounded(gram.rolling_slope(e, ["user_id"], ["ts", "event_id"], "x", "value", 20, "slope").select("event_id", "slope"), 4)


@query()
def huber_regression(spark, d):
    return gram.to_df(spark, gram.huber(read(spark, d, "lineitem"), XS, "l_extendedprice", most=10, tol=1e-6).value).select("term", "estimate")


@query("""WITH z AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS z FROM events), l AS (SELECT user_id, z, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3 FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, unnest([1, 2, 3])::INTEGER AS lag, round(unnest([sum(z * z1), sum(z * z2), sum(z * z3)]) / sum(z * z), 6) + 0.0 AS acf FROM l GROUP BY 1""")
def autocorrelation_function(spark, d):
    return rounded(series.autocorrelations(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3))


@query("SELECT least(floor((value - 0) / (300.0 / 20)), 19)::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 300 GROUP BY 1")
def histogram(spark, d):
    return series.histogram(read(spark, d, "events"), "value", 20, 0.0, 300.0)


@query("""WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT i, avg(v) AS m FROM x GROUP BY 1),
w AS (SELECT sum((v - m) * (v - m)) AS w FROM x JOIN c USING (label, i)), b AS (SELECT sum(c.n * (c.m - g.m) * (c.m - g.m)) AS b FROM c JOIN g USING (i)), n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM w, b, n""")
def calinski_harabasz(spark, d):
    got = cluster.separation(read(spark, d, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(round(got["calinski_harabasz"], 4),)], "calinski_harabasz double")


@query()
def davies_bouldin(spark, d):
    return spark.createDataFrame([(cluster.separation(read(spark, d, "embeddings"), "embedding", "label")["davies_bouldin"],)], "davies_bouldin double")


@query()
def ledoit_wolf(spark, d):
    cov, share = cluster.ledoit_wolf(read(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(i, float(v), share) for i, v in enumerate(cov.diagonal())], "i int, variance double, shrinkage double")


@query()
def two_scale_variance(spark, d):
    import numpy as np
    import pandas as pd

    return rounded(series.per_key(ticks(spark, d), "series", ["t"], "tsrv double", lambda p: pd.DataFrame({"tsrv": [kernels.two_scale_variance(np.log(p["v"].to_numpy(float)), 5)]})))


@query("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, i, value AS m, 0.0::DOUBLE AS v FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.i, f.m + 0.1 * (r.value - f.m), 0.9 * (f.v + 0.1 * (r.value - f.m) * (r.value - f.m)) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, round(arg_max(m, i), 5) AS mean, round(arg_max(v, i), 4) AS variance FROM f GROUP BY 1""")
def exponentially_weighted_variance(spark, d):
    s = series.exponentially_weighted(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 0.1)
    return s.select("user_id", F.round("ew_mean", 5).alias("mean"), F.round("ew_variance", 4).alias("variance"))
