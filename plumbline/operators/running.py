"""Running sums and order statistics of whole tables, without a window over all rows.

Rows are dealt to ranges of the order; each range sums for itself, and what stands before it is a row for each range,
which is small and broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each range that bounds are taken from.
SAMPLE_ROWS = 32


def spread(df: DataFrame, order: Sequence[Column | str], part: str = "_p", descending: bool = False) -> DataFrame:
    """df with the number of each row's range of the order: ascending with nulls first, or the reverse.

    The bounds are constants of the plan, from a sample taken once: range partitioning would sample again for each branch
    that reads it, and branches with other bounds do not fit together. They choose the ranges' sizes, never a result.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(order)))
    keys = df.select(key.alias("_k"))
    rows = keys.orderBy(F.rand(0)).limit(n * SAMPLE_ROWS).orderBy("_k").collect()
    rows = rows[SAMPLE_ROWS // 2::SAMPLE_ROWS]
    if not rows:
        return df.withColumn(part, F.lit(0))
    kind = keys.schema["_k"].dataType
    types = [f.dataType.simpleString() for f in kind.fields]
    # sorted again by the engine, whatever a value's way through Python did to it; all of it folds to one constant
    bounds = F.sort_array(F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"_{i}") for i, (v, t) in enumerate(zip(r[0], types)))) for r in rows)))
    # how many bounds are not beyond the row, by halves: a step for each
    out = df.withColumn(part, F.lit(0))
    for i in reversed(range(len(rows).bit_length())):
        out = out.withColumn(part, F.col(part) + F.when(F.get(bounds, F.col(part) + ((1 << i) - 1)) <= key, 1 << i).otherwise(0))
    return out.withColumn(part, -F.col(part)) if descending else out


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """df with the running sum (this row included) of each column of sums, under its name there, within each group of `by`.

    Rows of equal order within a group are summed in no stated order. Nulls add nothing; an empty table stays empty.
    """
    parts = spread(df, [*by, *order], descending=descending)
    inside = Window.partitionBy("_p", *by).orderBy(*map(F.desc, order) if descending else order).rowsBetween(Window.unboundedPreceding, 0)
    cols = [c for c in df.columns]
    totals = parts.groupBy("_p", *by).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_g_{c}") for c in by), *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    here = parts.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_s_{c}") for c in sums))
    match = F.col("_p") == F.col("_q")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return here.join(F.broadcast(totals) if not by else totals, match).select(*cols, *((F.col(f"_b_{c}") + F.col(f"_s_{c}")).alias(out) for c, out in sums.items()))


def quantiles(df: DataFrame, value: Column, at: Sequence[float]) -> list[float | None]:
    """Linear quantiles (type 7) of the non-null values, exact; None for each if there are none.

    Values are counted first, so that a value of many rows is one; the two around each quantile are picked by running counts.
    """
    counts = df.select(value.cast("double").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    if not n:
        return [None] * len(at)
    places = [q * (n - 1) for q in at]
    wanted = sorted({p for x in places for p in (floor(x), ceil(x))})
    run = running(counts, ["_v"], {"_n": "_c"})
    ranks = F.array(*map(F.lit, wanted)).cast("array<bigint>")
    # a row for each place that a value covers: two for each quantile
    got = run.select("_v", F.explode(F.filter(ranks, lambda p: (p < F.col("_c")) & (p >= F.col("_c") - F.col("_n")))).alias("at")).collect()
    value_at = {r["at"]: r["_v"] for r in got}
    return [value_at[floor(x)] + (value_at[ceil(x)] - value_at[floor(x)]) * (x - floor(x)) for x in places]
