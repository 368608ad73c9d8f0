"""Source health, alerts, missing entries and their streaming forms over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from ..rules import lexicon as L
from ..session import load, step_path
from ..streaming import arrivals, entries, health as live_health, live, replay, store
from .bindings import view, with_views
from .catalog_reports import sql_stamp, stamp
from .registry import query

END = "2024-01-31 00:00:00"


def runs(s, d):
    return view(s, d, "runs")


def R(sql):
    return with_views(sql, "runs")


_MEAN = "avg(items) OVER (PARTITION BY source ORDER BY started_at, run_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("w4_trailing_mean", R(f"SELECT run_id, round({_MEAN}, 6) AS avg_items FROM runs"))
def w4(s, d):
    return H.trailing_mean(runs(s, d)).select("run_id", F.round("avg_items", 6).alias("avg_items"))


_STREAKS = """p AS (SELECT *, row_number() OVER w AS pos, count(*) FILTER (ok) OVER w AS oks FROM runs WINDOW w AS (PARTITION BY source ORDER BY started_at, run_id)),
  s AS (SELECT *, pos - coalesce(max(CASE WHEN ok THEN pos END) OVER (PARTITION BY source ORDER BY started_at, run_id), 0) AS streak FROM p),
  st AS (SELECT *, CASE WHEN streak >= 3 THEN 'FAILING' WHEN streak > 0 THEN 'DEGRADED' ELSE 'OK' END AS status FROM s)"""


@query("w5_failure_streaks", R(f"WITH {_STREAKS} SELECT run_id, streak, status, oks AS success_count FROM st"))
def w5(s, d):
    return H.streaks(runs(s, d)).select("run_id", "streak", "status", "success_count")


@query("a12_mean_items", R(f"SELECT source, round(arg_max(m, (started_at, run_id)), 6) AS avg_items FROM (SELECT *, {_MEAN} AS m FROM runs) GROUP BY 1"))
def a12(s, d):
    return H.current_health(runs(s, d)).select("source", F.round("avg_items", 6).alias("avg_items"))


@query("a13_success_rate", R("SELECT source, round(count(*) FILTER (ok) / count(*), 6) AS success_rate FROM runs GROUP BY 1"))
def a13(s, d):
    return H.current_health(runs(s, d)).select("source", F.round("success_rate", 6).alias("success_rate"))


_HOUR = "date_trunc('hour', started_at)"


@query("a14_cycle_totals", R(f"""SELECT {sql_stamp('cycle', 'cycle')}, checked, failed, round(items, 4) AS items, failed < checked AS ok FROM (SELECT cycle, count(*) AS checked,
    count(*) FILTER (NOT o) AS failed, sum(i) AS items FROM (SELECT {_HOUR} AS cycle, source, bool_and(ok) AS o, sum(items) AS i FROM runs GROUP BY 1, 2) GROUP BY 1)"""))
def a14(s, d):
    t = H.cycle_totals(runs(s, d), F.date_trunc("hour", "started_at"))
    return t.select(stamp("cycle", "cycle"), "checked", "failed", F.round("items", 4).alias("items"), "ok")


@query("a19_freshness_profile", R(f"""SELECT source, count(*) AS items, count(CASE WHEN ok THEN started_at END) AS dated,
    date_diff('second', max(CASE WHEN ok THEN started_at END), TIMESTAMP '{END}') > 72 * 3600 AS stale FROM runs GROUP BY 1"""))
def a19(s, d):
    dated = F.when(F.col("ok"), F.col("started_at"))
    return runs(s, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.count(dated).alias("dated"),
        (F.unix_seconds(F.lit(END).cast("timestamp")) - F.unix_seconds(F.max(dated)) > 72 * 3600).alias("stale"))


@query("a20_source_health", R(f"""WITH {_STREAKS}, m AS (SELECT run_id, {_MEAN} AS mean FROM runs), z AS (SELECT st.*, m.mean, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, st.run_id DESC) AS r,
    max(CASE WHEN ok THEN started_at END) OVER (PARTITION BY source) AS last_ok FROM st JOIN m USING (run_id))
    SELECT source, pos AS runs, oks AS success_count, pos - oks AS failure_count, streak, status, round(mean, 6) AS avg_items, latency_ms,
    {sql_stamp('started_at', 'last_run_at')}, {sql_stamp('last_ok', 'last_ok_at')} FROM z WHERE r = 1"""))
def a20(s, d):
    h = H.current_health(runs(s, d)).orderBy("status", "source")
    return h.select("source", "runs", "success_count", "failure_count", "streak", "status", F.round("avg_items", 6).alias("avg_items"),
                    "latency_ms", stamp("last_run_at", "last_run_at"), stamp("last_ok_at", "last_ok_at"))


@query("a20_status_counts", with_views("SELECT status, count(*) AS n FROM accidents WHERE status IN ('PENDING_REVIEW', 'PUBLISHED', 'REJECTED') GROUP BY 1", "accidents"))
def a20_counts(s, d):
    n = view(s, d, "accidents").filter(F.col("status").isin("PENDING_REVIEW", "PUBLISHED", "REJECTED"))
    return n.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a20_last_cycles", R(f"""SELECT {sql_stamp('cycle', 'cycle')}, checked, failed, round(items, 4) AS items, failed < checked AS ok FROM (SELECT cycle, count(*) AS checked,
    count(*) FILTER (NOT o) AS failed, sum(i) AS items FROM (SELECT {_HOUR} AS cycle, source, bool_and(ok) AS o, sum(items) AS i FROM runs GROUP BY 1, 2) GROUP BY 1
    ORDER BY cycle DESC LIMIT 5)"""))
def a20_cycles(s, d):
    last = H.cycle_totals(runs(s, d), F.date_trunc("hour", "started_at")).orderBy(F.desc("cycle")).limit(5)
    return last.select(stamp("cycle", "cycle"), "checked", "failed", F.round("items", 4).alias("items"), "ok")


@query("j10_alert_suppression", R("""SELECT f.run_id AS ref FROM runs f WHERE f.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM runs a WHERE a.source = f.source
    AND a.event_type = 'signup' AND a.started_at <= f.started_at AND a.started_at >= f.started_at - INTERVAL 12 HOUR)"""))
def j10(s, d):
    r = runs(s, d).select("source", F.col("started_at").alias("at"), F.col("run_id").alias("ref"), "event_type")
    return H.unsuppressed_alerts(r.filter("event_type = 'error'"), r.filter("event_type = 'signup'")).select("ref")


@query("j12_recovery_after_alert", R(f"""WITH {_STREAKS}, q AS (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY started_at, run_id) AS prev FROM st)
    SELECT source, run_id, {sql_stamp('alert_at', 'alert_at')} FROM (SELECT q.source, q.run_id, max(a.started_at) AS alert_at FROM q JOIN runs a ON a.source = q.source
    AND a.event_type = 'signup' AND a.started_at <= q.started_at WHERE q.status = 'OK' AND q.prev = 'FAILING' GROUP BY 1, 2)"""))
def j12(s, d):
    r = runs(s, d)
    sent = r.filter("event_type = 'signup'").select("source", F.col("started_at").alias("at"))
    return H.recoveries(r, sent).select("source", "run_id", stamp("alert_at", "alert_at"))


_SILENCE = f"INTERVAL {L.ALERT_SILENCE_HOURS} HOUR"
_ALERTS = f"""{_STREAKS}, f AS (SELECT source, started_at, run_id, streak, started_at + {_SILENCE} AS quiet FROM st WHERE streak >= {L.FAILING_AFTER}),
  nx AS MATERIALIZED (SELECT f.source, f.run_id, (SELECT arg_min(g.run_id, (g.started_at, g.run_id)) FROM f g WHERE g.source = f.source AND g.started_at > f.quiet) AS onward FROM f),
  down(source, run_id) AS (SELECT source, arg_min(run_id, (started_at, run_id)) FROM f GROUP BY 1 UNION ALL SELECT nx.source, nx.onward FROM down JOIN nx USING (source, run_id) WHERE onward IS NOT NULL),
  al AS (SELECT f.* FROM f JOIN down USING (source, run_id)),
  up AS (SELECT DISTINCT al.source, (SELECT arg_min({{'t': o.started_at, 'r': o.run_id}}, (o.started_at, o.run_id)) FROM runs o WHERE o.source = al.source AND o.ok
    AND (o.started_at > al.started_at OR (o.started_at = al.started_at AND o.run_id > al.run_id))) AS o FROM al)"""
_ALERT_ROWS = f"""SELECT source, {sql_stamp('started_at', 'at')}, 'FUENTE-CAIDA' AS kind, CAST(streak AS BIGINT) AS streak FROM al
    UNION ALL SELECT source, {sql_stamp('o.t', 'at')}, 'FUENTE-RECUPERADA', 0 FROM up WHERE o IS NOT NULL"""


@query("r9_alerts_batch", R(f"WITH RECURSIVE {_ALERTS} {_ALERT_ROWS}"))
def r9_batch(s, d):
    """All alerts of the run log at once."""
    return H.alerts(runs(s, d)).select("source", stamp("at", "at"), "kind", "streak")


# --- streaming twins ----------------------------------------------------------------------------
# Runs arrive up to 80 minutes after their time, in four drains of about a week, so files overlap in time and
# every drain goes on from the checkpoint of the one before. The watermark is the real one, 90 minutes.

_DELAY, _SLOTS = "90 minutes", 4
_SLOW = "CAST(run_id * 37 % 80 AS INT)"
_SLOT = f"CAST(least({_SLOTS - 1}, (day(started_at + {_SLOW} * INTERVAL 1 MINUTE) - 1) // 8) AS INT)"
_CLOSED = "(SELECT max(started_at) - INTERVAL 90 MINUTE FROM runs)"


def _on_time():
    return F.col("started_at") + F.expr("make_dt_interval(0, 0, cast(run_id * 37 % 80 as int))")


def _week(at):
    return F.least(F.lit(_SLOTS - 1), F.floor((F.dayofmonth(at) - 1) / 8)).cast("int")


def _slot():
    return _week(_on_time())


def _arriving(s, d):
    return runs(s, d).withColumn("arrived", _on_time())


def _drained(rows, name, make, slot=None):
    """The output of a stream over ``rows``, drained slot by slot."""
    spark = rows.sparkSession
    base = step_path(spark, name)
    schema = []

    def writer(stream):
        out = make(stream)
        schema.append(out.schema)
        return replay.to_files(out, base)

    replay.in_slots(rows, _slot() if slot is None else slot, _SLOTS, writer, name)
    return spark.read.schema(schema[0]).parquet(f"{base}/out")


def _batched(rows, name, write, slot=None):
    base = step_path(rows.sparkSession, name)
    replay.in_slots(rows, _slot() if slot is None else slot, _SLOTS, lambda stream: replay.to_batches(stream, base, write), name)


@query("r1_first_seen", R("SELECT source AS key, count(*) AS passed FROM (SELECT DISTINCT source FROM runs) GROUP BY 1"))
def r1(s, d):
    """Live first-seen filter: every key passes once, however many drains have it."""
    seen = store.new_store(s, ["key"], store.SEEN, "seen")
    out = step_path(s, "first-seen")
    _batched(_arriving(s, d), "first", store.first_seen(seen, "source", "started_at", "live", out))
    return s.read.parquet(out).groupBy("key").agg(F.count(F.lit(1)).alias("passed"))


@query("r1_seen_store", R(f"""SELECT key, {sql_stamp('f', 'first_seen')}, {sql_stamp('l', 'last_seen')}, n AS sightings, CAST(m AS INT) AS missing_count, CASE WHEN m >= 6 THEN 'MISSING' ELSE 'PRESENT' END AS state
    FROM (SELECT *, greatest(0, least(6, (epoch_us(TIMESTAMP '{END}') // 1000000 - epoch_us(l) // 1000000) // 3600)) AS m FROM (SELECT source AS key, min(started_at) AS f, max(started_at) AS l, count(*) AS n FROM runs GROUP BY 1))"""))
def r1_store(s, d):
    """What the store holds after all drains: a seen key is refreshed, not passed again."""
    seen = store.new_store(s, ["key"], store.SEEN, "seen")
    _batched(_arriving(s, d), "refresh", store.first_seen(seen, "source", "started_at", "live", step_path(s, "first-seen")))
    rows = store.seen_state(seen.rows(), F.lit(END).cast("timestamp"), L.CADENCE_MINUTES, L.MISSING_AFTER)
    return rows.select("key", stamp("first_seen", "first_seen"), stamp("last_seen", "last_seen"), "sightings", "missing_count", "state")


@query("r1_first_seen_batch", R(f"SELECT source, {sql_stamp('min(started_at)', 'first_seen')} FROM runs GROUP BY 1"))
def r1_batch(s, d):
    return runs(s, d).groupBy("source").agg(F.min("started_at").alias("m")).select("source", stamp("m", "first_seen"))


_GAPS = f"""g AS (SELECT source, started_at, date_diff('microsecond', lag(started_at) OVER (PARTITION BY source ORDER BY started_at, run_id), started_at) AS gap FROM runs),
  k AS (SELECT source, count(*) AS sightings, count(*) FILTER (gap // 1000000 > 21600) AS spells, max(started_at) AS last_seen FROM g GROUP BY 1),
  k2 AS (SELECT *, least(6, greatest(0, date_diff('second', last_seen, TIMESTAMP '{END}') // 3600)) AS missing FROM k)"""


@query("r2_entry_states", R(f"""WITH {_GAPS} SELECT source, sightings, spells + CASE WHEN missing >= 6 THEN 1 ELSE 0 END AS spells, CAST(missing AS INT) AS missing_count,
    CASE WHEN missing >= 6 THEN 'MISSING' ELSE 'PRESENT' END AS state FROM k2""").replace("date_diff('microsecond', lag(started_at) OVER (PARTITION BY source ORDER BY started_at, run_id), started_at) AS gap",
    "(epoch_us(started_at) // 1000000 - epoch_us(lag(started_at) OVER (PARTITION BY source ORDER BY started_at, run_id)) // 1000000) * 1000000 AS gap").replace("date_diff('second', last_seen, TIMESTAMP '2024-01-31 00:00:00')", "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000000 - epoch_us(last_seen) // 1000000)"))
def r2(s, d):
    sight = runs(s, d).select(F.col("source").alias("key"), F.col("started_at").alias("ts"), F.col("run_id").alias("obs_id"))
    m = H.missing_spells(sight, F.lit(END).cast("timestamp"))
    return m.select(F.col("key").alias("source"), "sightings", F.col("spells").cast("long").alias("spells"), "missing_count", "state")


_CHANGES = f"""WITH g AS (SELECT source, started_at, row_number() OVER w AS n, lag(started_at) OVER w AS prev, lead(started_at) OVER w AS onward FROM runs WINDOW w AS (PARTITION BY source ORDER BY started_at, run_id)),
  c AS (SELECT source, started_at AS t, 'PRESENT' AS state, 0 AS missing_count, n AS sightings FROM g WHERE prev IS NULL OR started_at > prev + INTERVAL 6 HOUR
    UNION ALL SELECT source, started_at + INTERVAL 6 HOUR, 'MISSING', 6, n FROM g WHERE onward IS NULL OR onward > started_at + INTERVAL 6 HOUR)
  SELECT CAST(source AS VARCHAR) AS key, {sql_stamp('t', 'at')}, state, missing_count, sightings FROM c WHERE t <= {_CLOSED}"""


@query("r2_entry_transitions", R(_CHANGES))
def r2_live(s, d):
    """Live state machine: every change that the watermark has made final."""
    rows = _arriving(s, d).withColumn("ts", F.col("started_at"))
    out = _drained(rows, "entries", lambda stream: entries.entry_states(stream, "source", delay=_DELAY))
    return out.select("key", stamp("at", "at"), "state", "missing_count", "sightings")


@query("r2_transitions_batch", R(_CHANGES))
def r2_changes(s, d):
    r = runs(s, d)
    until = r.agg(F.max("started_at")).first()[0]
    sight = r.select(F.col("source").cast("string").alias("key"), F.col("started_at").alias("ts"), F.col("run_id").alias("obs_id"))
    c = H.entry_transitions(sight, F.lit(until) - F.expr("interval 90 minutes"))
    return c.select("key", stamp("at", "at"), "state", "missing_count", "sightings")


# Runs of a source come to the health stream in order, so its slots follow the time of the run.
def _in_order():
    return _week("started_at")


@query("r3_live_health", R(f"WITH {_STREAKS} SELECT st.run_id, streak, status, round(m, 6) AS avg_items FROM st JOIN (SELECT run_id, {_MEAN} AS m FROM runs) x USING (run_id)"))
def r3(s, d):
    base = step_path(s, "health")
    _batched(runs(s, d), "health", live_health.watch(base), _in_order())
    out = s.read.parquet(f"{base}/runs")
    return out.select("run_id", "streak", "status", F.round("avg_items", 6).alias("avg_items"))


@query("r9_live_alerts", R(f"WITH RECURSIVE {_ALERTS} {_ALERT_ROWS}"))
def r9(s, d):
    base = step_path(s, "alerts")
    _batched(runs(s, d), "alerts", live_health.watch(base), _in_order())
    return s.read.parquet(f"{base}/alerts").select("source", stamp("at", "at"), "kind", "streak")


# Every fiftieth run of the first half of the month comes in the last drain, long after its windows have closed.
_STRAY = "(run_id % 50 = 0 AND day(started_at) <= 15)"


def _with_strays():
    return F.when((F.col("run_id") % 50 == 0) & (F.dayofmonth("started_at") <= 15), _SLOTS - 1).otherwise(_slot())


@query("r4_cycle_windows", R(f"""SELECT {sql_stamp(_HOUR, 'cycle')}, count(*) AS runs, count(*) FILTER (NOT ok) AS failed, round(sum(items), 4) AS items FROM runs
    WHERE NOT {_STRAY} AND {_HOUR} + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1"""))
def r4(s, d):
    """Totals of the cycles that the watermark has closed; late rows are dropped (``r4_late_rows`` counts them)."""
    rows = _arriving(s, d).withColumn("ts", F.col("started_at"))
    out = _drained(rows, "cycles", lambda stream: live.cycle_windows(stream, delay=_DELAY), _with_strays())
    return out.select(stamp("window.start", "cycle"), "runs", "failed", F.round("items", 4).alias("items"))


@query("r5_coverage_windows", R(f"""SELECT {sql_stamp('w', 'start')}, count(*) AS items FROM (SELECT unnest([date_trunc('hour', started_at), date_trunc('hour', started_at) - INTERVAL 1 HOUR]) AS w, started_at FROM runs WHERE NOT {_STRAY})
    WHERE started_at < w + INTERVAL 90 MINUTE AND w + INTERVAL 90 MINUTE <= {_CLOSED} GROUP BY 1"""))
def r5(s, d):
    rows = _arriving(s, d).withColumn("ts", F.col("started_at"))
    out = _drained(rows, "coverage", lambda stream: live.coverage_windows(stream, delay=_DELAY), _with_strays())
    return out.select(stamp("window.start", "start"), "items")


_ARRIVED = "TIMESTAMP '2024-01-30 12:00:00'"


@query("r6_arrival_classes", R(f"""SELECT c, count(*) AS n FROM (SELECT CASE WHEN x > 5400 THEN 'future' WHEN x > 0 THEN 'clamped' WHEN -x > 2592000 THEN 'expired' WHEN -x > 5400 THEN 'late' ELSE 'fresh' END AS c
    FROM (SELECT epoch_us(started_at) // 1000000 - epoch_us({_ARRIVED}) // 1000000 AS x FROM runs)) GROUP BY 1"""))
def r6(s, d):
    r = runs(s, d).withColumn("arrived", F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return r.groupBy(arrivals.arrival_class("started_at", "arrived").alias("c")).agg(F.count(F.lit(1)).alias("n"))


# Strays arrive on the last day; every seventieth run is ahead of its arrival, by half an hour or two hours.
_WHEN = f"""CASE WHEN {_STRAY} THEN TIMESTAMP '2024-01-30 12:00:00' WHEN run_id % 70 = 1 THEN started_at - INTERVAL 30 MINUTE WHEN run_id % 70 = 2 THEN started_at - INTERVAL 2 HOUR
  ELSE started_at + {_SLOW} * INTERVAL 1 MINUTE END"""
_LANDED = f"""WITH a AS (SELECT *, {_WHEN} AS arrived FROM runs), b AS (SELECT *, CASE WHEN {_STRAY} THEN {_SLOTS - 1} ELSE {_SLOT} END AS slot FROM a),
  k AS (SELECT slot, max(max(arrived)) OVER (ORDER BY slot) AS clock FROM b GROUP BY slot),
  c AS (SELECT b.*, clock, epoch_us(started_at) // 1000000 - epoch_us(clock) // 1000000 AS x FROM b JOIN k USING (slot)),
  z AS (SELECT *, CASE WHEN x > 5400 THEN 'future' WHEN x > 0 THEN 'clamped' WHEN -x > 2592000 THEN 'expired' WHEN -x > 5400 THEN 'late' ELSE 'fresh' END AS class FROM c)"""


def _landing(s, d, name):
    """Runs split by the late-data rule as they arrive; the folder and the rows' type."""
    when = (F.when((F.col("run_id") % 50 == 0) & (F.dayofmonth("started_at") <= 15), F.lit("2024-01-30 12:00:00").cast("timestamp"))
            .when(F.col("run_id") % 70 == 1, F.col("started_at") - F.expr("interval 30 minutes"))
            .when(F.col("run_id") % 70 == 2, F.col("started_at") - F.expr("interval 2 hours")).otherwise(F.col("arrived")))
    rows = _arriving(s, d).withColumn("arrived", when)
    base = step_path(s, name)
    _batched(rows, name, arrivals.split(base, "started_at"), _with_strays())
    return base, rows.schema


@query("r6_side_outputs", R(f"""{_LANDED} SELECT run_id, class, CAST(slot AS BIGINT) AS batch,
    {sql_stamp("CASE WHEN class = 'clamped' THEN clock ELSE started_at END", 'at')} FROM z"""))
def r6_live(s, d):
    """Every row in the output of its class, with the drain that brought it; a clamped time is the clock's."""
    base, schema = _landing(s, d, "classes")
    return arrivals.landed(s, base, schema).select("run_id", "class", "batch", stamp("started_at", "at"))


@query("r4_late_rows", R(f"{_LANDED} SELECT class, CAST(slot AS BIGINT) AS batch, count(*) AS n FROM z WHERE class IN ('late', 'expired') GROUP BY 1, 2"))
def r4_late(s, d):
    """Late rows counted per drain, from the late outputs alone."""
    base, schema = _landing(s, d, "late")
    return arrivals.landed(s, base, schema, "late", "expired").groupBy("class", "batch").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(s, d):
    """Live runs read from the event file; rows keep the shape of the run log."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = live.file_stream(s, d, "events", schema)
    return e.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("items"))


@query("r7_stream_enrichment", R("""SELECT s_name, count(*) AS n FROM runs LEFT JOIN supplier ON s_suppkey = source GROUP BY 1"""))
def r7(s, d):
    sup = load(s, d, "supplier").select(F.col("s_suppkey").alias("source"), "s_name")
    out = live.run_available(live.enrich(_event_stream(s, d), sup, "source"), "enriched")
    return out.groupBy("s_name").agg(F.count(F.lit(1)).alias("n"))


@query("r8_idempotent_sink", R("SELECT source, min(run_id) AS run_id FROM (SELECT *, min(slot) OVER (PARTITION BY source) AS first FROM (SELECT *, " + _SLOT + " AS slot FROM runs)) WHERE slot = first GROUP BY 1"))
def r8(s, d):
    """Keys land once although the slots are drained twice, the second time from a new checkpoint."""
    sink = store.new_store(s, ["source"], {"row": "keep"}, "sink")
    rows = _arriving(s, d).select("run_id", "source", "started_at", "items")
    for writer in ("first", "again"):
        _batched(rows, f"sink-{writer}", store.idempotent_writer(sink, writer))
    return sink.rows().select("source", "row.run_id")
