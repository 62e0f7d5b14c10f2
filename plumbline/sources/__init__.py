"""Reading the driver's tables, and series with an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """events as (series, t seconds, seq, v), in the order (t, seq); rows of equal series and time keep their last."""
    e = read(spark, folder, "events").where("value is not null and ts is not null")
    e = e.select(F.col("event_type").alias("series"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6).alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    return e.groupBy("series", "t").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))
