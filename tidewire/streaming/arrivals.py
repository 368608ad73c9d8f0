"""The late-data rule on a stream: accepted, clamped, late, expired and future rows land apart.

The clock is the latest arrival so far, kept per batch beside the output. Rows are judged against it when their batch comes, so
the same row can be fresh in one batch and late in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..rules import lexicon as L
from ..session import exists

CLASSES = ("fresh", "clamped", "late", "expired", "future")


def arrival_class(ts: str | Column, arrived: str | Column) -> Column:
    """future (rejected), clamped, fresh, late (beyond the look-back) or expired (beyond the age limit)."""
    ahead = F.unix_seconds(ts) - F.unix_seconds(arrived)
    return (
        F.when(ahead > 90 * 60, "future").when(ahead > 0, "clamped")
        .when(-ahead > L.MAX_AGE_DAYS * 86400, "expired").when(-ahead > L.LOOKBACK_MINUTES * 60, "late")
        .otherwise("fresh"))


def split(path: str, ts: str = "ts", arrived: str = "arrived"):
    """foreachBatch function that writes every row once, below the folder of its class; a clamped time becomes the clock.

    A batch that comes again replaces itself: its clock is taken from the batches before it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.max(arrived).alias("clock")
        if exists(spark, f"{path}/clock"):
            earlier = spark.read.schema("clock timestamp, batch long").parquet(f"{path}/clock").filter(F.col("batch") < batch_id).select("clock")
            clock = batch.select(newest).union(earlier).agg(F.max("clock").alias("clock"))
        else:
            clock = batch.select(newest)
        clock.coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        now = F.lit(spark.read.schema("clock timestamp").parquet(f"{path}/clock/batch={batch_id}").first()[0]).cast("timestamp")
        rows = batch.withColumn("class", arrival_class(ts, now))
        rows = rows.withColumn(ts, F.when(F.col("class") == "clamped", now).otherwise(F.col(ts)))
        rows.write.mode("overwrite").partitionBy("class").parquet(f"{path}/rows/batch={batch_id}")

    return write


def landed(spark: SparkSession, path: str, schema, *classes: str) -> DataFrame:
    """The rows of these classes with ``batch`` and ``class``; only their folders are read."""
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType()), StructField("class", StringType())])).parquet(f"{path}/rows")
    return rows.filter(F.col("class").isin(*classes)) if classes else rows
