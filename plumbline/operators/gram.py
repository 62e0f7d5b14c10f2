"""Linear models on cross products: one aggregation over the rows, a small solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, total
from ..functions.special import f_pvalue, student_t_pvalue
from ..quality import Policy, Qualified, Report, Severity


@dataclass
class Gram:
    """Weighted count, means, and centred cross products of the features (and of the target, last)."""

    names: list[str]
    n: int
    weight: float
    mean: np.ndarray
    cross: np.ndarray
    bad: int

    def __sub__(self, other: Gram) -> Gram:
        """What is left when a fold's rows go."""
        w = self.weight - other.weight
        raw = self.raw() - other.raw()
        mean = (self.weight * self.mean - other.weight * other.mean) / w
        return Gram(self.names, self.n - other.n, w, mean, raw - w * np.outer(mean, mean), self.bad)

    def raw(self) -> np.ndarray:
        return self.cross + self.weight * np.outer(self.mean, self.mean)


def _products(cols: Sequence[str], weight: str | None, shift: Sequence[float]):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    z = [F.col(c).cast("double") - F.lit(s) for c, s in zip(cols, shift)]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w")]
    aggs += [F.sum(w * a).alias(f"s{i}") for i, a in enumerate(z)]
    return aggs + [F.sum(w * z[i] * z[j]).alias(f"c{i}_{j}") for i in range(len(z)) for j in range(i + 1)]


def _from_row(row, cols: Sequence[str], shift: np.ndarray, bad: int) -> Gram:
    p, w = len(cols), row["w"] or 0.0
    s = np.array([row[f"s{i}"] or 0.0 for i in range(p)])
    c = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    mean = s / w if w else s
    return Gram(list(cols), row["n"], w, mean + shift, c - w * np.outer(mean, mean), bad)


def gram(df: DataFrame, cols: Sequence[str], weight: str | None = None, by: str | None = None) -> Gram | dict:
    """Cross products about the columns' means; rows with a non-finite cell are left out and counted.

    A first, column-pruned aggregation finds the means, so that the second sums products of centred values.
    With `by`, a dict with one Gram for each value of that column.
    """
    ok = total([F.when(finite(F.col(c).cast("double")), 0).otherwise(1) for c in cols]) == 0
    first = df.agg(F.sum(F.when(ok, 0).otherwise(1)).alias("bad"), *(F.avg(F.when(ok, F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(cols))).first()
    shift = np.array([first[f"m{i}"] or 0.0 for i in range(len(cols))])
    good = df.where(ok)
    if by is None:
        return _from_row(good.agg(*_products(cols, weight, shift.tolist())).first(), cols, shift, first["bad"] or 0)
    return {r[by]: _from_row(r, cols, shift, 0) for r in good.groupBy(by).agg(*_products(cols, weight, shift.tolist())).collect()}


@dataclass
class LinearFit:
    terms: list[str]
    coef: np.ndarray
    intercept: float
    se: np.ndarray | None = None
    t: np.ndarray | None = None
    p: np.ndarray | None = None
    sigma2: float | None = None
    r2: float | None = None
    adjusted_r2: float | None = None
    f: float | None = None
    f_p: float | None = None
    loglik: float | None = None
    aic: float | None = None
    bic: float | None = None
    n: int = 0

    def predict(self):
        return total([F.lit(self.intercept), *(F.col(t) * F.lit(float(b)) for t, b in zip(self.terms, self.coef))])


def _solve(a: np.ndarray, b: np.ndarray, report: Report) -> np.ndarray:
    """Symmetric solve on unit-diagonal scale; a cut spectrum is a recorded compromise."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    values, vectors = np.linalg.eigh(a / np.outer(d, d))
    keep = values > report.policy.rank_tolerance * max(values.max(), 1e-300)
    condition = values.max() / max(values.min(), 1e-300)
    if not keep.all():
        report.add("RankDeficient", Severity.WARNING, f"rank {keep.sum()} of {len(values)}", compromise="minimum-norm solution")
        report.add("PseudoinverseUsed", Severity.ADVISORY)
    elif condition > report.policy.condition_warn:
        report.add("IllConditioned", Severity.WARNING, metrics={"condition": float(condition)})
    y = vectors[:, keep].T @ (b / d)
    return (vectors[:, keep] @ (y / values[keep])) / d


def ols(df: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, policy: Policy | None = None) -> Qualified[LinearFit]:
    """(Weighted) least squares with an intercept and full inference."""
    report = Report(policy or Policy())
    g = gram(df, [*xs, y], weight)
    if g.bad:
        report.add("NonFiniteInput", Severity.ERROR, f"{g.bad} rows")
    return _ols(g, list(xs), report)


def _ols(g: Gram, xs: list[str], report: Report, intercept_se: bool = True) -> Qualified[LinearFit]:
    p = len(xs)
    a, b, sst = g.cross[:p, :p], g.cross[:p, p], g.cross[p, p]
    if g.n <= p + 1:
        report.add("UnderdeterminedSystem", Severity.ERROR, f"{g.n} rows, {p + 1} parameters")
    elif g.n < report.policy.observations_per_parameter * (p + 1):
        report.add("InsufficientData", Severity.WARNING)
    if sst <= 0:
        report.add("ConstantTarget", Severity.ERROR, meaningless=True)
        return report.finish(LinearFit(xs, np.zeros(p), float(g.mean[p]), n=g.n))
    beta = _solve(a, b, report)
    intercept = float(g.mean[p] - beta @ g.mean[:p])
    sse = max(float(sst - 2 * beta @ b + beta @ a @ beta), 0.0)
    df_e = g.n - p - 1
    if df_e <= 0:
        return report.finish(LinearFit(xs, beta, intercept, n=g.n))
    sigma2 = sse / df_e
    inv = np.linalg.pinv(a, hermitian=True)
    var = np.concatenate([[sigma2 * (1 / g.weight + g.mean[:p] @ inv @ g.mean[:p])], sigma2 * np.diag(inv)])
    se = np.sqrt(np.maximum(var, 0))
    all_ = np.concatenate([[intercept], beta])
    t = np.divide(all_, se, out=np.full(p + 1, np.inf), where=se > 0)
    r2 = 1 - sse / sst
    f = (sst - sse) / p / sigma2 if p and sigma2 > 0 else float("inf")
    ll = -0.5 * g.n * (np.log(2 * np.pi * sse / g.n) + 1) if sse > 0 else float("inf")
    k = p + 1
    return report.finish(LinearFit(xs, beta, intercept, se, t, np.array([student_t_pvalue(v, df_e) if np.isfinite(v) else 0.0 for v in t]), sigma2, r2,
                                   1 - (1 - r2) * (g.n - 1) / df_e, f, f_pvalue(f, p, df_e) if np.isfinite(f) else 0.0, ll, 2 * k - 2 * ll, k * np.log(g.n) - 2 * ll, g.n))


def ridge(df: DataFrame, xs: Sequence[str], y: str, lam: float, fit: Gram | None = None) -> Qualified[LinearFit]:
    """(X'X + lambda I) beta = X'y on centred columns; the intercept is free of the penalty."""
    report = Report()
    g = fit or gram(df, [*xs, y])
    p = len(xs)
    beta = _solve(g.cross[:p, :p] + lam * np.eye(p), g.cross[:p, p], report)
    return report.finish(LinearFit(list(xs), beta, float(g.mean[p] - beta @ g.mean[:p]), n=g.n))


def ridge_cv(df: DataFrame, xs: Sequence[str], y: str, lams: Sequence[float], fold: str) -> tuple[float, dict[float, float]]:
    """Penalty of least squared error over the folds: fold products are subtracted from the total, no second scan."""
    folds = gram(df, [*xs, y], by=fold)
    p = len(xs)
    whole = None
    for g in folds.values():
        w = g.weight if whole is None else whole.weight + g.weight
        raw = g.raw() if whole is None else whole.raw() + g.raw()
        mean = g.mean if whole is None else (whole.weight * whole.mean + g.weight * g.mean) / w
        whole = Gram(g.names, g.n if whole is None else whole.n + g.n, w, mean, raw - w * np.outer(mean, mean), 0)
    errors = {}
    for lam in lams:
        sse = 0.0
        for g in folds.values():
            f = ridge(df, xs, y, lam, whole - g).value
            d = g.mean[p] - f.intercept - f.coef @ g.mean[:p]
            sse += g.cross[p, p] - 2 * f.coef @ g.cross[:p, p] + f.coef @ g.cross[:p, :p] @ f.coef + g.weight * d * d
        errors[lam] = float(sse / whole.weight)
    return min(errors, key=lambda k: (errors[k], k)), errors


def elastic_net(df: DataFrame, xs: Sequence[str], y: str, alpha: float, l1: float = 0.5, tol: float = 1e-10, most: int = 10_000) -> Qualified[LinearFit]:
    """Cyclic coordinate descent on the Gram: half squared error + n alpha (l1 |w| + (1 - l1) / 2 w^2)."""
    report = Report()
    g = gram(df, [*xs, y])
    p = len(xs)
    a, b, w = g.cross[:p, :p], g.cross[:p, p], np.zeros(p)
    for _ in range(most):
        change = 0.0
        for j in range(p):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            bound = g.n * alpha * l1
            new = np.sign(rho) * max(abs(rho) - bound, 0.0) / (a[j, j] + g.n * alpha * (1 - l1)) if a[j, j] > 0 else 0.0
            change, w[j] = max(change, abs(new - w[j])), new
        if change < tol:
            break
    else:
        report.add("NotConverged", Severity.WARNING, f"after {most} cycles")
    return report.finish(LinearFit(list(xs), w, float(g.mean[p] - w @ g.mean[:p]), n=g.n))


def to_df(spark, fit: LinearFit) -> DataFrame:
    """(term, estimate, se, t, p)."""
    terms, est = ["intercept", *fit.terms], [fit.intercept, *fit.coef]
    get = lambda v, i: float(v[i]) if v is not None else None
    return spark.createDataFrame([(t, float(e), get(fit.se, i), get(fit.t, i), get(fit.p, i)) for i, (t, e) in enumerate(zip(terms, est))], "term string, estimate double, se double, t double, p double")


def glm(df: DataFrame, xs: Sequence[str], y: str, family: str = "binomial", lam: float = 0.0, most: int = 50, tol: float = 1e-10) -> Qualified[LinearFit]:
    """Logistic or Poisson regression by Newton steps; each step is one aggregation of weighted cross products."""
    report = Report()
    p = len(xs) + 1
    means = df.agg(*(F.avg(x).alias(x) for x in xs), *(F.stddev_samp(x).alias(f"{x}|s") for x in xs), F.avg(y).alias("_y"), F.count("*").alias("_n")).first()
    m, s = np.array([means[x] for x in xs]), np.array([means[f"{x}|s"] or 1.0 for x in xs])
    z = [F.lit(1.0), *((F.col(x) - F.lit(float(a))) / F.lit(float(b)) for x, a, b in zip(xs, m, s))]
    rate = min(max(means["_y"], 1e-9), 1 - 1e-9 if family == "binomial" else 1e300)
    beta = np.zeros(p)
    beta[0] = np.log(rate / (1 - rate)) if family == "binomial" else np.log(rate)
    hess = np.eye(p)
    for _ in range(most):
        eta = total([c * F.lit(float(b)) for c, b in zip(z, beta)])
        mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
        w = mu * (1 - mu) if family == "binomial" else mu
        row = df.agg(*(F.sum(c * (F.col(y) - mu)).alias(f"g{i}") for i, c in enumerate(z)), *(F.sum(w * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1))).first()
        grad = np.array([row[f"g{i}"] for i in range(p)]) - lam * beta
        hess = np.array([[row[f"h{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]) + lam * np.eye(p)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if abs(step).max() < tol:
            break
    else:
        report.add("NotConverged", Severity.ERROR, f"after {most} steps")
    change = np.diag(np.concatenate([[1.0], 1 / s]))
    change[0, 1:] = -m / s
    cov = change @ np.linalg.inv(hess) @ change.T
    out = change @ beta
    se = np.sqrt(np.diag(cov))
    return report.finish(LinearFit(list(xs), out[1:], float(out[0]), se, out / se, n=means["_n"]))


def huber(df: DataFrame, xs: Sequence[str], y: str, k: float = 1.345, most: int = 50, tol: float = 1e-8) -> Qualified[LinearFit]:
    """Huber regression: weighted least squares again and again, the scale by the median absolute residual; two passes a step."""
    report = Report()
    fit = ols(df, xs, y).value
    for _ in range(most):
        r = F.abs(F.col(y) - fit.predict())
        scale = (df.agg(F.percentile_approx(r, 0.5, 10_000).alias("m")).first()["m"] or 0.0) / 0.6744897501960817
        if scale <= 0:
            break
        w = F.when(r <= k * scale, 1.0).otherwise(k * scale / r)
        new = ols(df.withColumn("_hw", w), xs, y, "_hw").value
        moved = max(abs(new.intercept - fit.intercept) / (1 + abs(fit.intercept)), *(abs(a - b) / (1 + abs(b)) for a, b in zip(new.coef, fit.coef)))
        fit = new
        if moved < tol:
            break
    else:
        report.add("NotConverged", Severity.WARNING, f"after {most} steps")
    return report.finish(fit)


def grouped_slopes(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """(key, n, slope, intercept, r2) of a simple regression in each group, in one aggregation."""
    return df.groupBy(*key).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def rolling_slope(df: DataFrame, key: Sequence[str], order: Sequence[str], x: str, y: str, window: int, out: str) -> DataFrame:
    """Slope of the last `window` rows (fewer: null)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= window, F.regr_slope(F.col(y), F.col(x)).over(w)))
