"""Centroids, k-means, principal components and discriminants over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(df: DataFrame, vec: str, by: str | None = None) -> DataFrame:
    """Per task and (integer) group: count, sum and sum of outer products of the vectors, for exact merging."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
            g = np.asarray(batch.column(1))
            for v in np.unique(g):
                s = x[g == v]
                n, m = len(s), s.mean(0)
                c = (s - m).T @ (s - m)
                if v in held:
                    n0, m0, c0 = held[v]
                    d = m - m0
                    held[v] = (n0 + n, m0 + d * n / (n0 + n), c0 + c + np.outer(d, d) * n0 * n / (n0 + n))
                else:
                    held[v] = (n, m, c)
        if held:
            yield pa.RecordBatch.from_pydict({"g": pa.array([k.item() for k in held]), "n": pa.array([h[0] for h in held.values()], pa.int64()),
                                              "m": pa.array([h[1].tolist() for h in held.values()]), "c": pa.array([h[2].ravel().tolist() for h in held.values()])})

    return df.where(F.col(vec).isNotNull()).select(vec, (F.col(by) if by else F.lit(0)).cast("long").alias("g")).mapInArrow(run, "g long, n long, m array<double>, c array<double>")


def group_moments(df: DataFrame, vec: str, by: str | None = None) -> dict:
    """{group: (n, mean, covariance with n - 1)}; each task sends one row for each group."""
    out: dict = {}
    for r in _sums(df, vec, by).toLocalIterator():
        n, m = r["n"], np.array(r["m"])
        c = np.array(r["c"]).reshape(len(m), len(m))
        if r["g"] in out:
            n0, m0, c0 = out[r["g"]]
            d = m - m0
            out[r["g"]] = (n0 + n, m0 + d * n / (n0 + n), c0 + c + np.outer(d, d) * n0 * n / (n0 + n))
        else:
            out[r["g"]] = (n, m, c)
    return {g: (n, m, c / max(n - 1, 1)) for g, (n, m, c) in sorted(out.items())}


def pca(df: DataFrame, vec: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(explained variance, share, components), largest first; a component's largest loading is positive."""
    _, _, cov = group_moments(df, vec)[0]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return values[:k], values[:k] / values.sum(), vectors[:k]


def assign(df: DataFrame, vec: str, centres: np.ndarray, out: str, ident: str) -> DataFrame:
    """(ident, out, distance): the nearest centre, ties to the smaller index."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                d = np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in centres], 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], [ident, out, "distance"])

    return df.where(F.col(vec).isNotNull()).select(ident, vec).mapInArrow(run, f"{ident} {kind}, {out} int, distance double")


def nearest_centroid(df: DataFrame, vec: str, label: str, ident: str) -> DataFrame:
    """(ident, predicted label index, distance) by class means."""
    groups = group_moments(df, vec, label)
    names = list(groups)
    got = assign(df, vec, np.stack([groups[g][1] for g in names]), "_i", ident)
    return got.select(ident, F.get(F.array(*map(F.lit, names)), F.col("_i")).cast(df.schema[label].dataType).alias("predicted"), "distance")


def k_means(df: DataFrame, vec: str, k: int, ident: str, rounds: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, float, int]:
    """Lloyd's rounds from the k rows of smallest hash: (centres, inertia of the last assignment, rounds).

    Every round is one pass: tasks send their sums by cluster.
    """
    centres = np.array([r[0] for r in df.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(ident), ident).limit(k).select(vec).collect()], float)
    inertia = 0.0
    for step in range(1, rounds + 1):
        def run(batches: Iterator[pa.RecordBatch], c=centres) -> Iterator[pa.RecordBatch]:
            n, s, cost = np.zeros(len(c), np.int64), np.zeros_like(c), np.zeros(len(c))
            for batch in batches:
                if batch.num_rows:
                    x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
                    d = np.stack([((x - v) ** 2).sum(1) for v in c], 1)
                    own = d.argmin(1)
                    n += np.bincount(own, minlength=len(c))
                    cost += np.bincount(own, d.min(1), len(c))
                    np.add.at(s, own, x)
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(len(c)), pa.int32()), "n": pa.array(n), "s": pa.array(s.tolist()), "cost": pa.array(cost)})

        rows = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "j int, n long, s array<double>, cost double").collect()
        new, n = np.zeros_like(centres), np.zeros(len(centres))
        inertia = 0.0
        for r in rows:
            new[r["j"]] += r["s"]
            n[r["j"]] += r["n"]
            inertia += r["cost"]
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], centres)
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if moved < tol:
            return centres, inertia, step
    return centres, inertia, rounds


def discriminant(df: DataFrame, vec: str, label: str, ident: str, quadratic: bool = False, shrink: float = 1e-6) -> DataFrame:
    """(ident, predicted) by Gaussian classes with a pooled (linear) or own (quadratic) covariance."""
    groups = group_moments(df, vec, label)
    names, n = list(groups), sum(g[0] for g in groups.values())
    dim = len(next(iter(groups.values()))[1])
    pooled = sum((g[0] - 1) * g[2] for g in groups.values()) / max(n - len(names), 1)
    parts = []
    for g in names:
        cov = (groups[g][2] if quadratic else pooled) + shrink * np.eye(dim)
        parts.append((groups[g][1], np.linalg.inv(cov), np.log(groups[g][0] / n) - (0.5 * np.linalg.slogdet(cov)[1] if quadratic else 0.0)))
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                score = np.stack([c - 0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m) for m, inv, c in parts], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in score.argmax(1)], pa.int64())], [ident, "predicted"])

    return df.where(F.col(vec).isNotNull()).select(ident, vec).mapInArrow(run, f"{ident} {kind}, predicted long")


def gaussian_nb(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """df with `predicted`: independent Gaussians by class; one aggregation, then row-local columns."""
    rows = df.groupBy(label).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"m_{c}") for c in cols), *(F.var_pop(c).alias(f"v_{c}") for c in cols)).orderBy(label).collect()
    total, top = sum(r["_n"] for r in rows), max((r[f"v_{c}"] or 0 for r in rows for c in cols), default=1.0)
    best = None
    for r in rows:
        s = F.lit(float(np.log(r["_n"] / total)))
        for c in cols:
            v = r[f"v_{c}"] + 1e-9 * top
            s = s - 0.5 * (F.lit(float(np.log(2 * np.pi * v))) + F.pow(F.col(c) - F.lit(r[f"m_{c}"]), 2) / F.lit(v))
        entry = F.struct(s.alias("s"), F.lit(r[label]).alias("l"))
        best = entry if best is None else F.when(entry["s"] > best["s"], entry).otherwise(best)
    return df.withColumn("predicted", best["l"])


def separation(df: DataFrame, vec: str, label: str) -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin scores of a labeling, from the groups' counts, means and spreads."""
    groups = group_moments(df, vec, label)
    n, k = sum(g[0] for g in groups.values()), len(groups)
    mean = sum(g[0] * g[1] for g in groups.values()) / n
    within = sum(np.trace(g[2]) * max(g[0] - 1, 0) for g in groups.values())
    between = sum(g[0] * float((g[1] - mean) @ (g[1] - mean)) for g in groups.values())
    names = list(groups)
    centres = np.stack([groups[g][1] for g in names])
    kind = {g: i for i, g in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = np.zeros(k), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
                g = np.array([kind[v] for v in batch.column(1).to_pylist()])
                s += np.bincount(g, np.linalg.norm(x - centres[g], axis=1), k)
                c += np.bincount(g, minlength=k)
        yield pa.RecordBatch.from_pydict({"g": pa.array(np.arange(k), pa.int32()), "s": pa.array(s), "n": pa.array(c)})

    spread = np.zeros(k)
    for r in df.where(F.col(vec).isNotNull()).select(vec, F.col(label).cast("long")).mapInArrow(run, "g int, s double, n long").groupBy("g").agg((F.sum("s") / F.sum("n")).alias("m")).collect():
        spread[r["g"]] = r["m"]
    far = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(far, np.inf)
    return {"calinski_harabasz": float(between / max(k - 1, 1) / (within / max(n - k, 1))), "davies_bouldin": float(((spread[:, None] + spread[None]) / far).max(1).mean())}


def ledoit_wolf(df: DataFrame, vec: str) -> tuple[np.ndarray, float]:
    """Covariance (n) shrunk to a multiple of the identity, and the intensity: n^-2 sum |x x' - S|^2 / |S - mu I|^2, within [0, 1]."""
    n, mean, cov = group_moments(df, vec)[0]
    s = cov * (n - 1) / n
    dim = len(mean)
    mu = np.trace(s) / dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float) - mean
                # |x x' - S|^2 = |x|^4 - 2 x' S x + |S|^2
                t += float(((x * x).sum(1) ** 2 - 2 * np.einsum("ij,jk,ik->i", x, s, x)).sum()) + len(x) * float((s * s).sum())
        yield pa.RecordBatch.from_pydict({"t": [t]})

    t = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "t double").agg(F.sum("t").alias("t")).first()["t"]
    gap = float(((s - mu * np.eye(dim)) ** 2).sum())
    share = min(1.0, max(0.0, t / n**2 / gap)) if gap > 0 else 1.0
    return (1 - share) * s + share * mu * np.eye(dim), share
