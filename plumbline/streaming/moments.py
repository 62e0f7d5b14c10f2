"""Incremental statistics as Structured Streaming state.

State is what the batch operators would have summed: (n, mean, m2) by key, merged pairwise, so a stream that has
ended gives the batch result. A micro-batch with a non-finite value for a key is rejected for that key as a whole and
leaves its state as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "n long, mean double, m2 double, ew double"


def merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, m2) of two disjoint samples."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def running_moments(stream: DataFrame, key: str, value: str, order: list[str], alpha: float = 0.1) -> DataFrame:
    """(key, n, mean, variance, ew_mean, accepted) of all rows so far, one row for each key of each micro-batch.

    variance is null below two values; the exponentially weighted mean starts with the first value, in the order given within
    a micro-batch.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, ew = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        batch = pd.concat(list(parts)).sort_values(order)
        v = batch[value].astype(float).tolist()
        ok = all(isfinite(x) for x in v)
        if ok and v:
            m = sum(v) / len(v)
            first = n == 0
            n, mean, m2 = merge((n, mean, m2), (len(v), m, sum((x - m) ** 2 for x in v)))
            for x in v:
                ew = x if first else ew + alpha * (x - ew)
                first = False
            state.update((n, mean, m2, ew))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean if n else None], "variance": [m2 / (n - 1) if n > 1 else None], "ew_mean": [ew if n else None], "accepted": [ok]})

    return stream.select(key, value, *order).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, mean double, variance double, ew_mean double, accepted boolean", _STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *key: str) -> DataFrame:
    """Rows of each tumbling window and key; rows later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *key).agg(F.count("*").alias("n"))
