"""Distances, kernels and neighbour search between a stated query set and all rows.

The query set is sent to every task, which is right for a set of checked size only: above MOST_QUERY_BYTES the search is
made in blocks of queries, each one pass over the rows. Rows are scored in numpy batches, each task keeps k
candidates for each query, and only those meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of query vectors that is broadcast.
MOST_QUERY_BYTES = 64 << 20


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _each(f: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    return lambda a, b: np.stack([f(x[None, :], b) for x in a])


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


#: Matrices of queries by rows.
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda a, b: np.sqrt(_sq(a, b)),
    "sqeuclidean": _sq,
    "manhattan": _each(lambda x, b: np.abs(x - b).sum(1)),
    "chebyshev": _each(lambda x, b: np.abs(x - b).max(1)),
    "canberra": _each(lambda x, b: _ratio(np.abs(x - b), np.abs(x) + np.abs(b)).sum(1)),
    "braycurtis": _each(lambda x, b: _ratio(np.abs(x - b).sum(1), np.abs(x + b).sum(1))),
    "hamming": _each(lambda x, b: (x != b).mean(1)),
    "jaccard": _each(lambda x, b: 1 - _ratio(((x != 0) & (b != 0)).sum(1).astype(float), ((x != 0) | (b != 0)).sum(1).astype(float))),
    "cosine": lambda a, b: 1 - _unit(a) @ _unit(b).T,
}


def minkowski(p: float):
    return _each(lambda x, b: (np.abs(x - b) ** p).sum(1) ** (1 / p))


def kernel(name: str, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3):
    """rbf, linear, polynomial, laplacian, sigmoid, chi2 or additive_chi2."""
    return {
        "rbf": lambda a, b: np.exp(-gamma * _sq(a, b)), "linear": lambda a, b: a @ b.T, "polynomial": lambda a, b: (gamma * (a @ b.T) + coef0) ** degree,
        "laplacian": lambda a, b: np.exp(-gamma * METRICS["manhattan"](a, b)), "sigmoid": lambda a, b: np.tanh(gamma * (a @ b.T) + coef0),
        "chi2": lambda a, b: np.exp(-gamma * _each(lambda x, y: _ratio((x - y) ** 2, x + y).sum(1))(a, b)),
        "additive_chi2": _each(lambda x, y: _ratio(2 * x * y, x + y).sum(1)),
    }[name]


def _blocks(queries: DataFrame, ident: str, vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query vectors in blocks of bounded bytes, streamed to the driver."""
    ids, rows, size = [], [], 0
    for r in queries.select(ident, vec).orderBy(ident).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
        if size >= MOST_QUERY_BYTES:
            yield np.array(ids), np.array(rows, float)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, float)


def nearest(rows: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vec: str = "embedding", metric: str = "euclidean", keep: str | None = None, own: bool = False) -> DataFrame:
    """(query, neighbour, distance, rank[, keep]): the k nearest rows of each query, ties by smaller id; a query is not its own neighbour unless `own`."""
    f = METRICS[metric]
    kinds = {x.name: x.dataType.simpleString() for x in rows.schema.fields}
    cols = [ident, vec, *([keep] if keep else [])]
    schema = f"query long, neighbour long, distance double{f', {keep} {kinds[keep]}' if keep else ''}"
    out = None
    for ids, q in _blocks(queries, ident, vec):
        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in ids]
            kind = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind = batch.column(2).type if keep else None
                other = np.asarray(batch.column(0))
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                extra = batch.column(2).to_pylist() if keep else None
                d = f(q, x)
                for i in range(len(ids)):
                    near = np.lexsort((other, d[i]))[: k + 1]
                    best[i] = sorted(best[i] + [(float(d[i, j]), int(other[j]), extra[j] if keep else None) for j in near if own or other[j] != ids[i]], key=lambda t: t[:2])[:k]
            flat = [(int(i), n, d, e) for i, b in zip(ids, best) for d, n, e in b]
            if flat:
                c = list(zip(*flat))
                yield pa.RecordBatch.from_pydict({"query": pa.array(c[0], pa.int64()), "neighbour": pa.array(c[1], pa.int64()), "distance": pa.array(c[2], pa.float64()), **({keep: pa.array(c[3], kind)} if keep else {})})
        part = rows.select(*cols).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_classify(rows: DataFrame, queries: DataFrame, k: int, label: str = "label", **how) -> DataFrame:
    """(query, predicted): most frequent label of the neighbours, ties to the smaller."""
    votes = nearest(rows, queries, k, keep=label, **how).groupBy("query", label).agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("predicted"))


def knn_regress(rows: DataFrame, queries: DataFrame, k: int, y: str, **how) -> DataFrame:
    return nearest(rows, queries, k, keep=y, **how).groupBy("query").agg(F.avg(y).alias("predicted"))


def density(rows: DataFrame, queries: DataFrame, h: float, ident: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query, log_density): Gaussian kernel density of bandwidth h, by sums of exponentials of each task about its own maximum."""
    out = None
    for ids, q in _blocks(queries, ident, vec):
        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    e = -_sq(q, np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)) / (2 * h * h)
                    top = e.max(1)
                    yield pa.RecordBatch.from_pydict({"query": pa.array(ids.astype(np.int64)), "top": pa.array(top), "s": pa.array(np.exp(e - top[:, None]).sum(1)), "n": pa.array(np.full(len(ids), batch.num_rows, np.int64)), "dim": pa.array(np.full(len(ids), q.shape[1], np.int64))})
        part = rows.select(vec).mapInArrow(run, "query long, top double, s double, n long, dim long")
        out = part if out is None else out.union(part)
    top = out.groupBy("query").agg(F.max("top").alias("m"))
    return out.join(top, "query").groupBy("query").agg((F.max("m") + F.log(F.sum(F.col("s") * F.exp(F.col("top") - F.col("m")))) - F.log(F.sum("n")) - F.max("dim") * (0.5 * np.log(2 * np.pi) + np.log(h))).alias("log_density"))
