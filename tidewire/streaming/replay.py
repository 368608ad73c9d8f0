"""Draining streams: everything that lies in a folder, or a table that arrives in slots, one drain per slot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import step_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start(writer, spark: SparkSession) -> StreamingQuery:
    """Start on the RocksDB state store, whose state need not fit the memory of the executors."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain(writer, spark: SparkSession) -> None:
    query = start(writer, spark)
    query.awaitTermination()


def to_files(stream: DataFrame, base: str):
    return stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt")


def to_batches(stream: DataFrame, base: str, write: Callable[[DataFrame, int], None]):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt")


def in_slots(rows: DataFrame, slot: Column, slots: int, writer: Callable[[DataFrame], object], name: str) -> None:
    """Let ``rows`` arrive slot by slot in a folder that a stream reads; it is drained after each, from its checkpoint.

    The rows are cut into slots by one write; a slot is then a folder of its own and is read alone. ``writer`` makes the
    query's writer from the stream and must name the same checkpoint every time.
    """
    spark = rows.sparkSession
    staged, landing = step_path(spark, f"{name}-staged"), step_path(spark, f"{name}-landing")
    rows.withColumn("_slot", slot).write.partitionBy("_slot").parquet(staged)
    held = spark.read.schema(rows.withColumn("_slot", F.lit(0)).schema).parquet(staged)
    for n in range(slots):
        held.filter(F.col("_slot") == n).drop("_slot").write.mode("append").parquet(landing)
        drain(writer(spark.readStream.schema(rows.schema).parquet(landing)), spark)
