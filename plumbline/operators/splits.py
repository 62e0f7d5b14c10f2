"""Splits as a fold column; a row's fold depends on its key alone or on its rank in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running, spread


def k_fold(df: DataFrame, order: list[str], k: int, out: str = "fold") -> DataFrame:
    """Row number modulo k, rows numbered by partition counts of a range sort, so no single task sees all rows."""
    return ranked(df, order, "_i").withColumn(out, (F.col("_i") % k).cast("int")).drop("_i")


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Global 0-based rank by order (a key): ranks inside ranges plus the counts of those before."""
    inside = spread(df, order).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = inside.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")
    return inside.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def stratified_k_fold(df: DataFrame, label: str, order: list[str], k: int, out: str = "fold") -> DataFrame:
    """Row number inside the class modulo k; classes are ranked in range partitions, so a class may be as large as it likes."""
    one = running(df.withColumn("_one", F.lit(1)), order, {"_one": "_i"}, [label])
    return one.withColumn(out, ((F.col("_i") - 1) % k).cast("int")).drop("_one", "_i")


def group_k_fold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """Rank of the group among the sorted groups, modulo k; a group is never torn."""
    groups = ranked(df.select(group).distinct(), [group], "_g").select(group, (F.col("_g") % k).cast("int").alias(out))
    return df.join(groups, group)


def time_series_blocks(n: int, k: int) -> list[tuple[int, int]]:
    """Test blocks [start, end) of n // (k + 1) rows laid out from the tail; what is before trains."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def time_series_split(df: DataFrame, order: list[str], k: int, out: str = "test_of") -> DataFrame:
    """The split whose test block the row is in, else null."""
    n = df.count()
    r = ranked(df, order, "_i")
    at: Column = F.lit(None).cast("int")
    for i, (a, b) in enumerate(time_series_blocks(n, k)):
        at = F.when((F.col("_i") >= a) & (F.col("_i") < b), i).otherwise(at)
    return r.withColumn(out, at).drop("_i")


def hash_split(key: Column, share: float, seed: int = 0) -> Column:
    """True for about `share` of keys; the same key always falls on the same side."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30))
