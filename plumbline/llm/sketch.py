"""Threshold-scaled document sketches, with DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes
from .native import with_grams

#: Words of a shingle; a shingle's hash is kept if it is among the lowest 1 / SCALE of all hashes.
SHINGLE, SCALE = 5, 4
#: Input bytes of a bucket of neighbouring documents, and the most buckets (a list of so many bounds is held by the driver).
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 10_000
_LOWEST, _RANGE = -(1 << 63), 1 << 64


def with_sketch(df: DataFrame, text_col: str, out: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add `out`: struct(digest of the text, sorted array of the kept 40-bit shingle hashes).

    Shingles are `shingle` consecutive words (fewer words: the whole text), lower-cased and cut at
    white space. A hash is kept or not by its own value alone, so sketches of parts can be merged
    by union and documents of any two sizes can be compared.
    """
    limit = F.lit(_LOWEST + _RANGE // scale)
    df = df.withColumn("_words", F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x00-\x20]+"), ""))
    df = with_grams(df, "_words", "_grams", shingle)
    short = (F.size("_words") > 0) & (F.size("_words") < shingle)
    df = df.withColumn("_grams", F.when(short, F.array(F.xxhash64("_words"))).otherwise(F.col("_grams")))
    kept = F.transform(F.filter("_grams", lambda h: h < limit), lambda h: h.bitwiseAND(F.lit((1 << 40) - 1)))
    return df.withColumn(out, F.struct(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.sort_array(F.array_distinct(kept)).alias("kept"))).drop("_words", "_grams")


def written_out(sketch: Column) -> Column:
    """A sketch as a string: 16 hex digits of the text's digest, a colon, 10 of each kept hash."""
    return F.lower(F.concat(F.lpad(F.hex(sketch["digest"]), 16, "0"), F.lit(":"),
                            F.array_join(F.transform(sketch["kept"], lambda h: F.lpad(F.hex(h), 10, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller text's shingles in the larger's, from 0 to 1.

    Equal digests give 1; a sketch without hashes is like nothing else.
    """
    least = F.least(F.size(a["kept"]), F.size(b["kept"]))
    return F.when(a["digest"] == b["digest"], F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a["kept"], b["kept"])) / least)


def with_next(docs: DataFrame, id_col: str, carried: list[str], buckets: int) -> DataFrame:
    """Add `next`: the carried columns of the following row by ascending id (after the last: the first).

    Bounds that are ids of the table cut it into buckets of like size; a bucket's first row also goes to
    the bucket before as its guest, so each bucket finds all its neighbours alone and rows are
    shuffled once. Null ids come first; rows of equal id are ordered by their carried columns.
    """
    facts = docs.agg(F.min(id_col).alias("low"), F.count("*").alias("n"), F.count(id_col).alias("known"),
                     F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)] or [0.5], max(10_000, 10 * buckets)).alias("cuts")).first()
    low = facts["low"]
    bounds = [b for b in sorted({*(facts["cuts"] or [])}) if buckets > 1 and b > low]
    has_null = facts["known"] < facts["n"]
    cuts = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    # binary search: how many bounds are at or below the id
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    place = F.lit(0)
    if bounds:
        inside = lambda i: i <= len(bounds)
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: F.when(
            inside(acc + s) & (F.get(cuts, acc + s - 1) <= F.col(id_col)), acc + s).otherwise(acc))
    rows = docs.withColumn("_bucket", F.coalesce(F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(place), F.lit(0)))
    is_first = F.col(id_col).isNull() if has_null else F.col(id_col) == F.lit(low)
    at_bound = F.get(cuts, F.col("_bucket") - 1) == F.col(id_col) if bounds else F.lit(False)
    guests = F.when(is_first, F.lit(len(bounds))).when(at_bound, F.col("_bucket") - 1)
    rows = rows.withColumn("_at", F.explode(F.filter(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")),
                                                             F.struct(guests.alias("b"), F.lit(1).alias("guest"))), lambda x: x["b"].isNotNull())))
    rows = rows.select("*", F.col("_at.b").alias("_b"), F.col("_at.guest").alias("_guest")).drop("_at", "_bucket")
    order = Window.partitionBy("_b").orderBy("_guest", F.col(id_col).asc_nulls_first(), *carried)
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("_guest = 0").drop("_b", "_guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketch of each whole text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's. Columns: the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty; null ids come first,
    rows of equal id in the order of their texts, and each row is returned; a single document is its
    own next; other columns are ignored; an empty table gives an empty result. Texts are
    shuffled once, in buckets of about BUCKET_BYTES.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = max(1, min(MOST_BUCKETS, ceil(input_bytes(docs.sparkSession, docs) / BUCKET_BYTES)))
    rows = with_next(with_sketch(rows, "text", "sketch", shingle, scale), id_col, ["text", "sketch"], buckets)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch", shingle, scale)
    return rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       written_out(F.col("sketch")).alias("fingerprint"), written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
