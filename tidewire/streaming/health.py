"""Source health and alerts on a stream, as a segmented scan per batch.

Between batches a source leaves one small row: its streak, the items of its last runs, its last alert and whether that is open. A
batch puts them in front of its runs and scans the lot by ranges of (source, time), so a source that holds most runs
is spread over tasks. Runs of a source come in order from batch to batch; inside a batch in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import health as H, ordered
from ..rules import lexicon as L
from ..session import exists, materialize


def state_type(source: str) -> str:
    return f"source {source}, streak long, recent array<double>, last_alert timestamp, is_open boolean"


def latest_state(spark: SparkSession, path: str, batch_id: int, source: str) -> DataFrame:
    """What the batches before this one have left: the newest state below ``path``."""
    if not exists(spark, path):
        return spark.createDataFrame([], state_type(source))
    rows = spark.read.schema(state_type(source) + ", batch long").parquet(path).filter(F.col("batch") < batch_id)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(newest)).drop("batch")


def judged(runs: DataFrame, state: DataFrame, n: int = L.TRAILING_RUNS) -> DataFrame:
    """Every run with streak, status and the mean of its source's last ``n`` runs, those of earlier batches included."""
    held = state.select("source", F.posexplode("recent").alias("_place", "items")).select(
        "source", F.lit(None).cast("timestamp").alias("started_at"), F.col("_place").cast("long").alias("run_id"), F.lit(None).cast("boolean").alias("ok"),
        F.col("items").cast("double").alias("items"), F.lit(0).alias("_kind"))
    rows = held.unionByName(runs.select("source", "started_at", F.col("run_id").cast("long").alias("run_id"), "ok", F.col("items").cast("double").alias("items"), F.lit(1).alias("_kind")))
    order = ["_kind", "started_at", "run_id"]
    rows = ordered.scan(rows, ["source"], order, {"_last": (F.col("ok"), True)}, counted=F.col("_kind") == 1).withColumnRenamed("_pos", "_run_no")
    rows = ordered.look_back(rows, ["source"], order, n - 1, lambda w: {"avg_items": F.avg("items").over(w.rowsBetween(-(n - 1), 0))})
    rows = rows.filter("_kind = 1").join(state.select("source", F.col("streak").alias("_before")), "source", "left")
    streak = F.when(F.col("_last").isNull(), F.col("_run_no") + F.coalesce("_before", F.lit(0))).otherwise(F.col("_run_no") - F.col("_last"))
    return rows.withColumn("streak", streak).select("source", "run_id", "started_at", "ok", "items", "streak", H.status_of(F.col("streak")).alias("status"), "avg_items")


def next_state(scored: DataFrame, events: DataFrame, state: DataFrame, n: int = L.TRAILING_RUNS) -> DataFrame:
    """One row per source that has ever run."""
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = scored.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") < n)  # a source sends so many rows per task
    own = last.groupBy("source").agg(F.min_by("streak", "_r").alias("_streak"), F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "items"))).alias("_own"))
    told = events.groupBy("source").agg(F.max(F.when(F.col("kind") == "FUENTE-CAIDA", F.col("at"))).alias("_alert"),
                                        F.max_by("kind", F.struct("at", "run_id")).alias("_kind"))
    both = state.join(own, "source", "full").join(told, "source", "left")
    items = F.concat(F.coalesce("recent", F.array().cast("array<double>")), F.coalesce(F.transform("_own", lambda x: x["items"]), F.array().cast("array<double>")))
    return both.select(
        "source", F.coalesce("_streak", "streak").alias("streak"), F.slice(items, F.greatest(F.lit(1), F.size(items) - (n - 2)), n - 1).alias("recent"),
        F.coalesce("_alert", "last_alert").alias("last_alert"),
        F.coalesce(F.col("_kind") == "FUENTE-CAIDA", "is_open", F.lit(False)).alias("is_open"))


def watch(path: str):
    """foreachBatch function: runs (source, run_id, started_at, ok, items) to ``path``/runs, alerts to ``path``/alerts.

    A batch that comes again starts from the same state and replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = materialize(batch.select("source", "run_id", "started_at", "ok", "items"), "runs")
        state = materialize(latest_state(spark, f"{path}/state", batch_id, dict(batch.dtypes)["source"]), "state")
        scored = judged(runs, state)
        scored.write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")
        scored = spark.read.schema(scored.schema).parquet(f"{path}/runs/batch={batch_id}")
        events = H.alerts(runs, state.drop("recent"))
        events.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        events = spark.read.schema(events.schema).parquet(f"{path}/alerts/batch={batch_id}")
        next_state(scored, events, state).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    return write
