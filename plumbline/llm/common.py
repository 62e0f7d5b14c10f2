"""What the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library's heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives its memory back with each task: workers stay alive idle, beside those of later stages."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def bound_batches(spark: SparkSession, most: int) -> None:
    """Let no Arrow batch of the session pass `most` bytes (by a row at most); a smaller bound stays. JVM and worker both hold whole batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if now <= 0 or now > most:
        spark.conf.set(name, f"{most}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df: a Parquet table in the shared folder, read back; it is deleted when the application ends, if not discarded before."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        files, at = _file_system(df.sparkSession, df._written_at)
        files.delete(at, True)


def bitmap(marks: DataFrame, bits: int) -> bytes:
    """The numbers (0 to bits - 1) in the only column of marks as a bitmap, lowest bit first: bits / 8 bytes on the driver, whatever the table's size."""
    name = marks.columns[0]
    at = F.col(name) + 1
    parts = marks.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(bits // 8)
    for k, part in parts.collect():
        out[(k - 1) * 4096:k * 4096] = part
    return bytes(out)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(name: str, taken) -> str:
    """name, lengthened until no column has it (names are compared without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Catalyst's size estimate of the files below df (no job runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph with columns (a, b), both long.

    Alternates the large-star and small-star steps; each round is two min-aggregations
    (combined before the shuffle) and joins that AQE can split, and its table is written,
    so neither lineage nor a hub's neighbour list is ever held in one task.
    Returns (node, root), root being the smallest node of the component; isolated nodes
    and self-loops are absent. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    now = written(edges.where("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = digest(now)
    if mark[0] == 0:
        return spark.createDataFrame([], "node long, root long")
    # by another key than the one it was grouped by, so that the join has a shuffle of its own whose hot keys can be split
    beside = lambda low: (low.withColumnRenamed("a", "of"), F.negative("a") == F.negative("of"))
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (both.where("b > a").join(*beside(low))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(*beside(low)).select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        before, now = now, written(small, "edges")
        new = digest(now)
        discard(before)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
    raise RuntimeError("components did not converge")
