"""Structured Streaming forms that Spark has operators for: first sightings, windows, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..rules import lexicon as L
from ..session import step_path
from . import replay


def first_seen(stream: DataFrame, key: str, ts: str = "ts", delay: str = "90 minutes") -> DataFrame:
    """Only the first sighting of a key passes within the watermark; ``store.first_seen`` remembers keys for good."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def cycle_windows(stream: DataFrame, ts: str = "ts", length: str = "1 hour", delay: str = "90 minutes") -> DataFrame:
    """Tumbling totals per cycle, each told once, when the watermark has closed it: runs, failures, items."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, length)).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failed"), F.sum("items").alias("items"))


def coverage_windows(stream: DataFrame, ts: str = "ts", delay: str = "90 minutes") -> DataFrame:
    """Items visible to each pass: a look-back wider than the cadence, so a late pass loses nothing."""
    look, every = f"{L.LOOKBACK_MINUTES} minutes", f"{L.CADENCE_MINUTES} minutes"
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, look, every)).agg(F.count(F.lit(1)).alias("items"))


def enrich(stream: DataFrame, static: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Stream-static join; the static side is read again for every micro-batch."""
    return stream.join(static, on, how)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drain what the source holds into the shared folder and read the result."""
    spark: SparkSession = stream.sparkSession
    base = step_path(spark, name)
    replay.drain(replay.to_files(stream, base), spark)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def file_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 1) -> DataFrame:
    """Rate-limited stream over one table's files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", f"{name}*.parquet").parquet(folder))
