"""A training corpus from raw documents: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes what a stage returns as Parquet in the shared folder and the next
one reads it back, so a lost executor costs a stage's unfinished tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from plumbline.llm.common import bound_batches, free, quoted, table, written

#: Bytes of an Arrow batch in a stage: an executor holds several at once, in the JVM and in its workers.
BATCH_BYTES = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; the lexicon is learnt from the training labels."""
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.keep_clean(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id; rows of one id stay together."""
    groups = simhash.near_duplicates(docs)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    name = free("_kept", docs.columns)
    return docs.join(keep.select(F.col("doc_id").alias(name)), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 100-byte strings; what is left of cut characters goes too.

    n_chars counts the new text. Documents of which nothing is left go; empty and null texts that were so before stay.
    """
    kept, report = free("kept", docs.columns), free("report", docs.columns)
    cut = suffix_dedup.dedup(docs, decoded=True, kept=kept, report=report)
    cut = cut.where(f"{report}.n_removed = 0 or {report}.n_removed < {report}.n_bytes")
    changed = F.col(f"{report}.n_removed") > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*(new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; each row by its own text, whatever other rows have its id."""
    name, key = free("_bad", docs.columns), free("_key", docs.columns)
    by_text = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    bad = decontaminate.contamination(by_text, table(spark, sf_dir, "benchmark"), id_col=key).where("contaminated").select(F.col(key).alias(name)).distinct()
    return by_text.join(bad, F.col(key) == F.col(name), "left_anti").drop(key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit), their count and digests."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, keep_seconds=0, cache_share=0.5)


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with Arrow batches of at most BATCH_BYTES from now on in the session; no stage's result depends on its batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _bounded(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
)]

#: SQL can express neither the learnt lexicon nor XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
