"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .native import with_grams, with_window_min, words

#: Words of a window, of a k-gram; each window then has WINDOW - GRAM + 1 k-grams.
WINDOW, GRAM = 13, 8
#: A benchmark of at most so many distinct fingerprints (8 bytes each) is broadcast; above, the join shuffles.
BROADCAST_PRINTS = 1_000_000
#: Bytes of the benchmark's windows with their items up to which these are broadcast too; above, hits are joined to them by a shuffle.
BROADCAST_BYTES = 64 << 20


def _with_prints(df: DataFrame, length: int, window: int, gram: int) -> DataFrame:
    """Add `m<length>`: for each window of `length` words its fingerprint, the least k-gram hash in it."""
    k = min(gram, length)
    df = with_grams(df, "words", f"g{length}", k)
    return with_window_min(df, f"g{length}", f"m{length}", length - k + 1).drop(f"g{length}")


def _labelled(length: int):
    return lambda p: F.struct(F.lit(length).alias("length"), p.alias("print"))


def _places(prints: str):
    """Starts of the windows whose fingerprint is `print`."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(prints) - 1, F.lit(0))), lambda s: F.get(prints, s) == F.col("print"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: length, print, words (joined by a space), items.

    An item of fewer words than a window, but not none, is one window.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most `window` values
    parts = None
    for n in lengths:
        own = _with_prints(items.where(F.col("length") == n), n, window, gram)
        # outer, so that no filter on the array's size is inferred: pushed down, it would repeat the whole chain of arrays
        own = own.select("item", "length", "words", F.posexplode_outer(f"m{n}").alias("at", "print")).where("print is not null")
        own = own.select("length", "print", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("phrase"), "item")
        parts = own if parts is None else parts.union(own)
    if parts is None:
        return benchmark.sparkSession.createDataFrame([], "length int, print long, phrase string, items array<string>")
    return parts.groupBy("length", "print", "phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: which words lie in a benchmark window, and which items those come from.

    Columns: the id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and
    20 n_hit >= n_words). A window of a document and one of an item can only be equal if
    their fingerprints are, so the distinct fingerprints of each document are joined to
    those of the benchmark; hits are extended to the whole window and compared word by word.
    No shared span of a window's length is missed.

    Null and empty texts have no words and no hits; a null item id counts as the empty id;
    repeated rows are each returned; equal items count once; other columns are ignored;
    an empty documents or benchmark table gives no rows or no hits. One scan of the
    documents; only (row, hit) pairs are shuffled, never texts, while the benchmark's fingerprints stay
    under BROADCAST_PRINTS.
    """
    bench = written(benchmark_windows(benchmark, window, gram, item_col, item_text_col), "benchmark")
    heavy = 48 + F.octet_length("phrase") + F.aggregate("items", F.lit(0).cast("long"), lambda n, item: n + 16 + F.octet_length(item))
    size = bench.groupBy("length").agg(F.count_distinct("print").alias("n"), F.sum(heavy).alias("bytes")).collect()  # a row for each length
    lengths, small = sorted(r["length"] for r in size), sum(r["n"] for r in size) <= BROADCAST_PRINTS
    light = sum(r["bytes"] for r in size) <= BROADCAST_BYTES
    prints = bench.select("length", "print").distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.xxhash64(id_col, text_col).alias("mark"), words(F.col(text_col)).alias("words"))
    for n in lengths:
        rows = _with_prints(rows, n, window, gram)
    # one row of each document carries its count of words, the others its distinct fingerprints
    found = F.array(F.struct(F.lit(0).alias("length"), F.lit(None).cast("long").alias("print")))
    for n in lengths:
        found = F.concat(found, F.transform(F.array_distinct(f"m{n}"), _labelled(n)))
    if small:
        rows = rows.select("*", F.explode(found).alias("p")).select("*", "p.length", "p.print")
        rows = rows.join(F.broadcast(prints.withColumn("known", F.lit(True))), ["length", "print"], "left").where("known or length = 0")
    else:
        # row numbers hold for one scan only; a hash of the row finds it again, and what it finds is compared word by word below
        known = rows.select("mark", F.explode(found).alias("p")).select("mark", "p.length", "p.print").join(prints, ["length", "print"])
        known = known.groupBy("mark").agg(F.collect_set(F.struct("length", "print")).alias("known"))
        none = F.array(F.struct(F.lit(0).alias("length"), F.lit(None).cast("long").alias("print")))
        rows = rows.join(known, "mark", "left").select("*", F.explode(F.concat(none, F.coalesce("known", F.slice(none, 2, 1)))).alias("p")).select("*", "p.length", "p.print")
    starts = F.array().cast("array<int>")
    for n in lengths:
        starts = F.when((F.col("length") == n) & F.col("print").isNotNull(), _places(f"m{n}")).otherwise(starts)
    rows = rows.select("row", id_col, F.size("words").alias("n_words"), "length", "print", "words", F.explode_outer(starts).alias("start"))
    rows = rows.select("row", id_col, F.when(F.col("length") == 0, F.col("n_words")).alias("n_words"), "length", "print", "start",
                       F.array_join(F.slice("words", F.coalesce(F.col("start"), F.lit(0)) + 1, F.col("length")), " ").alias("phrase"))
    hits = rows.join(F.broadcast(bench) if light else bench, ["length", "print", "phrase"], "left").where("length = 0 or items is not null")
    by_row = hits.groupBy("row", id_col).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    out = by_row.select(id_col, "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
