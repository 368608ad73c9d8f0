"""Source health from run logs: streaks, moving means, success rates, alerts, missing entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..rules import lexicon as L
from ..session import materialize
from . import ordered

# Runs: source, run_id, started_at, ok (boolean), items (double), latency_ms.
ORDER = ["started_at", "run_id"]


def trailing_mean(runs: DataFrame, n: int = L.TRAILING_RUNS) -> DataFrame:
    """Mean of items over the last ``n`` runs of the source, at every run."""
    return ordered.look_back(runs, ["source"], ORDER, n - 1, lambda w: {
        "avg_items": F.avg("items").over(w.rowsBetween(-(n - 1), 0))})


def status_of(streak: Column, failing_after: int = L.FAILING_AFTER) -> Column:
    return F.when(streak >= failing_after, "FAILING").when(streak > 0, "DEGRADED").otherwise("OK")


def streaks(runs: DataFrame, failing_after: int = L.FAILING_AFTER) -> DataFrame:
    """Consecutive failures at every run and the status they imply."""
    rows = ordered.scan(runs, ["source"], ORDER, {"_last": (F.col("ok"), True)}, {"_oks": ("count", F.when(F.col("ok"), F.lit(1)))})
    streak = F.col("_pos") - F.coalesce("_last", F.lit(0))
    return (
        rows.withColumn("streak", streak)
        .withColumn("success_count", F.col("_oks"))
        .withColumn("failure_count", F.col("_pos") - F.col("_oks"))
        .withColumn("status", status_of(F.col("streak"), failing_after))
        .drop("_pos", "_oks", "_last"))


def success_rate(ok_count: Column, runs: Column) -> Column:
    return F.when(runs > 0, ok_count / runs).otherwise(F.lit(0.5))


def current_health(runs: DataFrame, failing_after: int = L.FAILING_AFTER, n: int = L.TRAILING_RUNS) -> DataFrame:
    """One row per source as of its latest run, from aggregates only.

    Streak = runs after the latest success; the mean of the last ``n`` runs needs only the
    ``n`` newest rows per source, which Spark limits before the shuffle.
    """
    stamp = F.struct("started_at", "run_id")
    base = runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("success_count"),
        F.max("started_at").alias("last_run_at"),
        F.max(F.when(F.col("ok"), F.col("started_at"))).alias("last_ok_at"),
        F.max(F.when(F.col("ok"), stamp)).alias("_last_ok"),
        F.max_by("latency_ms", stamp).alias("latency_ms"))
    # Counting runs after the latest success joins each run to one small row per source.
    after = runs.filter(~F.col("ok")).join(base.select("source", "_last_ok"), "source").filter(
        F.col("_last_ok").isNull() | (stamp > F.col("_last_ok")))
    streak = after.groupBy("source").agg(F.count(F.lit(1)).alias("_s"))
    w = Window.partitionBy("source").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    recent = runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy("source").agg(
        F.avg("items").alias("avg_items"))
    out = base.join(streak, "source", "left").join(recent, "source")
    s = F.coalesce("_s", F.lit(0))
    return out.select(
        "source", "runs", "success_count", (F.col("runs") - F.col("success_count")).alias("failure_count"),
        s.alias("streak"), F.when(s >= failing_after, "FAILING").when(s > 0, "DEGRADED").otherwise("OK").alias("status"),
        success_rate(F.col("success_count"), F.col("runs")).alias("success_rate"),
        "avg_items", "latency_ms", "last_run_at", "last_ok_at")


def cycle_totals(outcomes: DataFrame, cycle: Column) -> DataFrame:
    """Per-cycle sums; a cycle is ok when fewer sources failed than were checked."""
    per = outcomes.groupBy(cycle.alias("cycle"), "source").agg(
        F.sum("items").alias("items"), F.min(F.col("ok").cast("int")).alias("_ok"))
    return per.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_ok") == 0).alias("failed"),
        F.sum("items").alias("items")).withColumn("ok", F.col("failed") < F.col("checked"))


def unsuppressed_alerts(failing: DataFrame, sent: DataFrame, hours: int = L.ALERT_SILENCE_HOURS) -> DataFrame:
    """Failing sources without an alert of theirs in the silence period before ``at``.

    Failures and sent alerts form one timeline per source; the latest alert so far is a running maximum.
    """
    line = failing.select("source", "at", "ref", F.lit(1).alias("_kind")).unionByName(
        sent.select("source", "at", F.col("ref"), F.lit(0).alias("_kind")))
    seen = ordered.running(line, ["source"], ["at", "_kind", "ref"], {
        "last_alert": ("max", F.when(F.col("_kind") == 0, F.col("at")))})
    return seen.filter((F.col("_kind") == 1) & (
        F.col("last_alert").isNull() | (F.col("last_alert") < F.col("at") - F.expr(f"interval {hours} hours")))
    ).drop("_kind")


def recoveries(runs: DataFrame, sent: DataFrame, failing_after: int = L.FAILING_AFTER) -> DataFrame:
    """Successful runs that end a failing streak, with the latest alert sent before them; without one there is nothing to close.

    ``sent``: source, at. Runs and alerts are one timeline that is scanned once; an alert of the same moment comes first.
    """
    line = runs.select("source", "started_at", "run_id", "ok", F.lit(1).alias("_run")).unionByName(
        sent.select("source", F.col("at").alias("started_at"), F.lit(None).cast(dict(runs.dtypes)["run_id"]).alias("run_id"),
                    F.lit(False).alias("ok"), F.lit(0).alias("_run")))
    is_run = F.col("_run") == 1
    rows = ordered.scan(line, ["source"], ["started_at", "_run", "run_id"], {"_last": (is_run & F.col("ok"), False)},
                        {"alert_at": ("max", F.when(~is_run, F.col("started_at")))}, is_run)
    failed = F.col("_pos") - 1 - F.coalesce("_last", F.lit(0))
    return rows.filter(is_run & F.col("ok") & (failed >= failing_after) & F.col("alert_at").isNotNull()).select(
        "source", "run_id", "started_at", "alert_at")


def alerts(runs: DataFrame, state: DataFrame | None = None, failing_after: int = L.FAILING_AFTER,
           hours: int = L.ALERT_SILENCE_HOURS) -> DataFrame:
    """source, at, run_id, kind, streak: one down alert per source and silence period, and the success that closes it.

    ``state`` (source, streak, last_alert, is_open) is what runs before these have left. The next alert of a failing run is the
    first failing run after the silence; from the first alert on the chain is followed by doubling, never run by run.
    """
    none = "source {}, streak long, last_alert timestamp, is_open boolean".format(dict(runs.dtypes)["source"])
    state = runs.sparkSession.createDataFrame([], none) if state is None else state
    rows = ordered.scan(runs.select("source", "started_at", "run_id", "ok"), ["source"], ORDER, {"_last": (F.col("ok"), True)})
    rows = rows.join(state, "source", "left").withColumn("streak", F.when(
        F.col("_last").isNull(), F.col("_pos") + F.coalesce("streak", F.lit(0))).otherwise(F.col("_pos") - F.col("_last")))
    rows = materialize(rows.select("source", F.col("started_at").alias("at"), "run_id", "ok", "streak", "last_alert", "is_open"), "streaks")
    failing = rows.filter(F.col("streak") >= failing_after)
    silent = F.expr(f"interval {hours} hours")

    first = failing.filter(F.col("last_alert").isNull() | (F.col("at") > F.col("last_alert") + silent)).groupBy("source").agg(
        F.min(F.struct("at", "run_id")).alias("a"))
    reach = materialize(first.select("source", "a.at", "a.run_id"), "alerts")
    big = F.lit((1 << 63) - 1)  # strictly after the silence, whatever the run
    probes = failing.select("source", (F.col("at") + silent).alias("at"), big.alias("run_id"), F.col("at").alias("_at"), F.col("run_id").alias("_run"))
    onward = ordered.following(failing.select("source", "at", F.col("run_id").cast("long").alias("run_id")), probes, ["source"], "at", "run_id", "to")
    jump = materialize(onward.filter("to IS NOT NULL").select("source", F.col("_at").alias("at"), F.col("_run").alias("run_id"), "to"), "jumps")
    while True:
        more = materialize(reach.join(jump, ["source", "at", "run_id"]).select("source", "to.*"), "alerts")
        if more.limit(1).count() == 0:
            break
        reach = materialize(reach.unionByName(more), "alerts")
        there = jump.select(F.col("source").alias("_s"), F.col("at").alias("_a"), F.col("run_id").alias("_r"), F.col("to").alias("_to"))
        on = (F.col("source") == F.col("_s")) & (F.col("to.at") == F.col("_a")) & (F.col("to.run_id") == F.col("_r"))
        jump = materialize(jump.join(there, on).select("source", "at", "run_id", F.col("_to").alias("to")), "jumps")
    down = materialize(reach.join(failing.select("source", "at", "run_id", "streak"), ["source", "at", "run_id"]), "down")

    good = rows.filter("ok").select("source", "at", F.col("run_id").cast("long").alias("run_id"))
    closed = ordered.following(good, down.select("source", "at", F.col("run_id").cast("long").alias("run_id"), F.lit(0).alias("_")),
                               ["source"], "at", "run_id", "to").filter("to IS NOT NULL").select("source", "to.*")
    left_open = rows.filter("ok AND is_open").groupBy("source").agg(F.min(F.struct("at", F.col("run_id").cast("long").alias("run_id"))).alias("a"))
    up = closed.unionByName(left_open.select("source", "a.*")).distinct()
    return down.select("source", "at", F.col("run_id").cast("long").alias("run_id"), F.lit("FUENTE-CAIDA").alias("kind"), "streak").unionByName(
        up.select("source", "at", "run_id", F.lit("FUENTE-RECUPERADA").alias("kind"), F.lit(0).cast("long").alias("streak")))


def missing_spells(sightings: DataFrame, as_of: Column, cadence_minutes: int = L.CADENCE_MINUTES,
                   passes: int = L.MISSING_AFTER) -> DataFrame:
    """Batch twin of the seen-entry machine: one row per entry.

    An entry is missing whenever ``passes`` cadences go by without a sighting, and present again on sight.
    ``sightings``: key, ts, obs_id.
    """
    limit = cadence_minutes * passes * 60
    rows = ordered.look_back(sightings, ["key"], ["ts", "obs_id"], 1, lambda w: {"_prev": F.lag("ts").over(w)})
    gap = F.unix_seconds("ts") - F.unix_seconds("_prev")
    per = rows.groupBy("key").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("sightings"),
        F.count_if(gap > limit).alias("spells"))
    stale = F.floor((F.unix_seconds(as_of) - F.unix_seconds("last_seen")) / (cadence_minutes * 60))
    stale = F.greatest(F.lit(0), F.least(F.lit(passes), stale))
    return per.withColumn("missing_count", stale.cast("int")).withColumn(
        "state", F.when(stale >= passes, "MISSING").otherwise("PRESENT")).withColumn(
        "spells", F.col("spells") + F.when(stale >= passes, 1).otherwise(0))


def entry_transitions(sightings: DataFrame, until: Column, cadence_minutes: int = L.CADENCE_MINUTES,
                      passes: int = L.MISSING_AFTER) -> DataFrame:
    """Every change of an entry up to ``until``: key, at, state, missing_count, sightings (so far, this one included)."""
    silence = F.expr(f"interval {cadence_minutes * passes} minutes")
    rows = ordered.look_back(sightings, ["key"], ["ts", "obs_id"], 1, lambda w: {"_prev": F.lag("ts").over(w)})
    rows = ordered.running(rows, ["key"], ["ts", "obs_id"], {"n": ("count", F.lit(1))})
    again = F.col("_prev").isNotNull() & (F.col("ts") > F.col("_prev") + silence)
    change = lambda at, state, missing, n: F.struct(
        at.alias("at"), F.lit(state).alias("state"), F.lit(missing).alias("missing_count"), n.alias("sightings"))
    back = rows.filter(again | F.col("_prev").isNull()).select("key", F.explode(F.filter(F.array(
        F.when(again, change(F.col("_prev") + silence, "MISSING", passes, F.col("n") - 1)),
        change(F.col("ts"), "PRESENT", 0, F.col("n"))), lambda x: x.isNotNull())).alias("c"))
    last = rows.groupBy("key").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    gone = last.select("key", change(F.col("ts") + silence, "MISSING", passes, F.col("n")).alias("c"))
    return back.unionByName(gone).select("key", "c.*").filter(F.col("at") <= until)
