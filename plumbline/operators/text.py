"""Text vectorisers in long form (doc, term or column, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Maximal runs of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def count_vectorize(docs: DataFrame, doc: str, text: str, min_df: int = 1) -> DataFrame:
    """(doc, term, n) of terms that at least min_df documents have."""
    counts = docs.select(doc, F.explode(tokens(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))
    if min_df <= 1:
        return counts
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return counts.join(df.select("term"), "term", "left_semi").select(doc, "term", "n")


def tfidf(docs: DataFrame, doc: str, text: str, min_df: int = 1, smooth: bool = True) -> DataFrame:
    """(doc, term, weight): n * idf, rows of l2 norm 1; idf = ln((N + 1) / (df + 1)) + 1, unsmoothed ln(N / df) + 1."""
    n_docs = docs.count()
    counts = count_vectorize(docs, doc, text, min_df)
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1)) + 1 if smooth else F.log(F.lit(float(n_docs)) / F.col("df")) + 1
    weighted = counts.join(df, "term").select(doc, "term", (F.col("n") * idf).alias("w"))
    norm = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


@F.pandas_udf(LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long: byte by byte over a whole Arrow batch at once."""
    data = [t.encode() for t in text]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    for i in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(-sizes[order], -i, side="left")]
        h[live] = (h[live] ^ raw[at[live] + i]) * np.uint64(0x100000001B3)
    return pd.Series(h.view(np.int64))


def hashing_vectorize(docs: DataFrame, doc: str, text: str, n_features: int = 1024) -> DataFrame:
    """(doc, bin, value): bit 0 of the term's FNV-1a hash is its sign, the rest modulo n_features its bin."""
    t = docs.select(doc, F.explode(tokens(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n")).withColumn("h", fnv1a(F.col("term")))
    sign = F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)
    return t.groupBy(doc, (F.shiftrightunsigned(F.col("h"), 1) % n_features).alias("bin")).agg(F.sum(sign * F.col("n")).alias("value"))


def dict_vectorize(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, key, value) of whitespace-separated key=value records; a bad number counts as 1."""
    part = docs.select(doc, F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("p")).where("p <> ''")
    return part.select(doc, F.substring_index("p", "=", 1).alias("key"), F.coalesce(F.expr("try_cast(substring(p, instr(p, '=') + 1) AS double)"), F.lit(1.0)).alias("v")) \
        .groupBy(doc, "key").agg(F.sum("v").alias("value"))
