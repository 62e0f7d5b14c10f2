"""Trees grown level by level: candidate splits are scored in one aggregation of the rows for each level.

Thresholds are quantiles of the column; left is `<=`; ties go to the lowest (column,
threshold). The rows are never gathered: each level sums (weight, sum, sum of squares) by node, column and bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import total


@dataclass
class Node:
    value: float
    weight: float
    column: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1


def _below(col: str):
    return lambda edge: edge < F.col(col)


def edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of each column; few enough to be literals."""
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias(c) for c in cols)).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


def leaf(nodes: list[Node]) -> Column:
    """Number of the leaf that a row falls into, as one nested CASE."""

    def at(i: int) -> Column:
        n = nodes[i]
        if n.column is None:
            return F.lit(i)
        return F.when(F.col(n.column) <= F.lit(n.threshold), at(n.left)).otherwise(at(n.right))

    return at(0)


def predict(nodes: list[Node]) -> Column:
    def at(i: int) -> Column:
        n = nodes[i]
        if n.column is None:
            return F.lit(n.value)
        return F.when(F.col(n.column) <= F.lit(n.threshold), at(n.left)).otherwise(at(n.right))

    return at(0)


def grow(df: DataFrame, cols: Sequence[str], y: str, depth: int = 3, bins: int = 32, least: int = 1, weight: str | None = None) -> list[Node]:
    """Least-squares (for 0/1 targets: Gini) regression tree."""
    cut = edges(df, cols, bins)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.where(F.col(y).isNotNull())
    first = base.agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("s")).first()
    nodes = [Node((first["s"] or 0.0) / (first["w"] or 1.0), first["w"] or 0.0)]
    frontier = [0]
    for _ in range(depth):
        if not frontier:
            break
        bucket = {c: F.size(F.filter(F.lit(cut[c]).cast("array<double>"), _below(c))) for c in cols}
        rows = base.select(leaf(nodes).alias("node"), w.alias("w"), F.col(y).cast("double").alias("y"), *(bucket[c].alias(f"b{i}") for i, c in enumerate(cols))).where(F.col("node").isin(frontier))
        long = rows.select("node", "w", "y", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"b{i}").alias("b")) for i in range(len(cols))))).alias("k"))
        got = long.groupBy("node", "k.c", "k.b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"), F.count("*").alias("n")).collect()  # nodes x columns x bins rows
        table: dict = {}
        for r in got:
            table.setdefault(r["node"], {}).setdefault(r["c"], {})[r["b"]] = (r["w"], r["s"], r["n"])
        new = []
        for i in frontier:
            best = None
            for c, name in enumerate(cols):
                have = table.get(i, {}).get(c, {})
                tw, ts, tn = (sum(v[k] for v in have.values()) for k in range(3))
                lw = ls = ln = 0.0
                for b, e in enumerate(cut[name]):
                    a, s, n = have.get(b, (0.0, 0.0, 0))
                    lw, ls, ln = lw + a, ls + s, ln + n
                    if ln < least or tn - ln < least or lw <= 0 or tw - lw <= 0:
                        continue
                    gain = ls * ls / lw + (ts - ls) ** 2 / (tw - lw) - ts * ts / tw
                    if gain > 1e-12 * abs(ts * ts / tw) and (best is None or gain > best[0]):
                        best = (gain, name, e, (lw, ls), (tw - lw, ts - ls))
            if best:
                _, nodes[i].column, nodes[i].threshold, (a, s), (b, t) = best
                nodes[i].left, nodes[i].right = len(nodes), len(nodes) + 1
                nodes += [Node(s / a, a), Node(t / b, b)]
                new += [nodes[i].left, nodes[i].right]
        frontier = new
    return nodes


def forest(df: DataFrame, cols: Sequence[str], y: str, trees: int = 10, depth: int = 3, seed: int = 0, **how) -> list[list[Node]]:
    """Trees on Poisson(1) weights, drawn by a hash of the row number's key columns, so that a rerun draws the same."""
    out = []
    for t in range(trees):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(t), *cols, y), F.lit(1 << 30)) / float(1 << 30)
        draws = total([F.when(u > F.lit(p), 1.0).otherwise(0.0) for p in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)])
        out.append(grow(df.withColumn("_w", draws), cols, y, depth, weight="_w", **how))
    return out


def boost(df: DataFrame, cols: Sequence[str], y: str, rounds: int = 10, rate: float = 0.1, depth: int = 2, **how) -> tuple[float, list[list[Node]]]:
    """Least-squares boosting: (start, trees); the fit so far is a column of the trees grown, no table is kept between rounds."""
    start = df.agg(F.avg(y).alias("m")).first()["m"] or 0.0
    trees: list[list[Node]] = []
    for _ in range(rounds):
        fitted = total([F.lit(start), *(rate * predict(t) for t in trees)])
        trees.append(grow(df.withColumn("_r", F.col(y) - fitted), cols, "_r", depth, **how))
    return start, trees
