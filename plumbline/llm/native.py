"""Column expressions for word arrays, shared by the operators that use no Python code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of [0-9a-z and all outside ASCII].
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_az(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII only take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words [0-9a-z, non-ASCII]+ after lower-casing A-Z; empty for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shifted(a: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], a[i + by]) for every i where both exist."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), f)


def with_grams(df, words_col: str, out: str, k: int):
    """Add `out`: array<long>, a hash of each k consecutive words.

    Hashes of 1, 2, 4, ... words are made by joining those of half as many, so the work is
    a logarithm of k for each word. Every step is a column of its own, so that Catalyst
    computes it once.
    """
    name = f"_{out}_1"
    df = df.withColumn(name, F.transform(words_col, lambda w: F.xxhash64(w)))
    made, drop = {1: name}, [name]
    size = 1
    while size * 2 <= k:
        name = f"_{out}_{size * 2}"
        df = df.withColumn(name, shifted(F.col(made[size]), size, lambda a, b: F.xxhash64(a, b)))
        size *= 2
        made[size] = name
        drop.append(name)
    whole = size
    while whole < k:
        part = max(p for p in made if p <= k - whole)
        name = f"_{out}_{whole + part}"
        left, right, n = F.col(made[whole]), F.col(made[part]), F.greatest(F.size(words_col) - (whole + part - 1), F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(whole + 1), n), lambda a, b: F.xxhash64(a, b)))
        whole += part
        made[whole] = name
        drop.append(name)
    return df.withColumnRenamed(made[k], out).drop(*[c for c in drop if c != made[k]])


def with_window_min(df, col: str, out: str, width: int):
    """Add `out`: the least of each `width` consecutive values of an array column."""
    name, size, drop, least = col, 1, [], lambda a, b: F.least(a, b)
    while size < width:
        by = min(size, width - size)
        new = f"_{out}_{size + by}"
        df = df.withColumn(new, shifted(F.col(name), by, least))
        size += by
        name = new
        drop.append(new)
    if name == col:
        return df.withColumn(out, F.col(col))
    return df.withColumnRenamed(name, out).drop(*drop[:-1])
