"""Streaming operators against models: any order inside the watermark, replays, restarts, hot keys."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import T0, skewed_runs
from tidewire.operators import health as H
from tidewire.session import step_path
from tidewire.streaming import arrivals, entries, health, live, replay, store






# the store

def facts(rows):
    return rows.select(F.col("k").alias("key"), F.col("t").alias("first_seen"), F.col("t").alias("last_seen"), F.lit(1).cast("long").alias("sightings"))


def test_store_equals_group_by(spark, monkeypatch):
    monkeypatch.setattr(store, "SEGMENTS", 3)
    monkeypatch.setattr(store, "BUCKET", 4)
    rng = random.Random(2)
    rows = [(b, f"k{rng.choice([0, rng.randint(0, 60)])}", T0 + timedelta(minutes=rng.randint(0, 5000))) for b in range(7) for _ in range(25)]
    df = spark.createDataFrame(rows, "b int, k string, t timestamp")
    seen, passed = store.new_store(spark, ["key"], store.SEEN), []
    for b in range(7):
        passed += [(b, r.key) for r in seen.merge(facts(df.filter(F.col("b") == b)), "w", b).collect()]
        again = seen.merge(facts(df.filter(F.col("b") == b)), "w", b)  # a replay changes nothing and tells the same
        assert again is None or sorted((b, r.key) for r in again.collect()) == sorted(x for x in passed if x[0] == b)
    assert len(store.KeyStore.live(seen.commits())) <= 3
    assert seen.merge(facts(df.filter("b = 0")), "w", 0) is None or True
    want = {k: (min(t for _, x, t in rows if x == k), max(t for _, x, t in rows if x == k), sum(x == k for _, x, _ in rows)) for _, k, _ in rows}
    assert {r.key: (r.first_seen, r.last_seen, r.sightings) for r in seen.rows().collect()} == want
    assert sorted(passed) == sorted((min(b for b, x, _ in rows if x == k), k) for k in want)


def test_unrelated_keys_are_not_read(spark):
    one = store.new_store(spark, ["k"], {"row": "keep"})
    write = store.idempotent_writer(one, "w")
    for b in range(4):
        write(spark.range(b * 1000, b * 1000 + 1000).select(F.col("id").alias("k"), F.lit(b).alias("v")), b)
        assert one.read_buckets <= 1  # new keys: the filters answer
    write(spark.createDataFrame([(1500, 9), (99999, 9)], "k long, v int"), 4)
    assert one.read_buckets in (1, 2)  # the bucket of the one known key, in the one segment that has it
    assert {(r.k, r.row.v) for r in one.rows().filter("k in (1500, 99999)").collect()} == {(1500, 1), (99999, 9)}


def test_two_checkpoints_lose_nothing(spark):
    sink = store.new_store(spark, ["k"], {"row": "keep"})
    for writer, keys in (("a", [1, 2]), ("b", [2, 3])):
        store.idempotent_writer(sink, writer)(spark.createDataFrame([(k,) for k in keys], "k long"), 0)
    for _ in range(2):  # a replay
        store.idempotent_writer(sink, "c")(spark.createDataFrame([(9,)], "k long"), 0)
    assert sorted(r.k for r in sink.rows().collect()) == [1, 2, 3, 9]


def test_filters_never_miss():
    h = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63, 20_000)
    bits = store.filter_of(h[:10_000])
    assert store.may_hold(bits, h[:10_000]).all() and store.may_hold(bits, h[10_000:]).mean() < 0.001


# entries

def test_spells_do_not_depend_on_order():
    rng = random.Random(4)
    for _ in range(300):
        times = [rng.randint(0, 400) for _ in range(rng.randint(1, 25))]
        want = entries.spells_of(np.sort(np.array(times)), 15)
        rng.shuffle(times)
        spells, at = [], 0
        while at < len(times):
            n = rng.randint(1, 5)
            spells = entries.merged(spells + entries.spells_of(np.sort(np.array(times[at:at + n])), 15), 15)
            at += n
        assert spells == want


@pytest.mark.parametrize("chunk", [10_000, 2])
def test_entries_in_shuffled_files(spark, chunk):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "a", "b", f"k{i % 9}"]), T0 + timedelta(minutes=rng.randint(0, 9000)), i) for i in range(240)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, obs_id long")
    arrived = F.col("ts") + F.expr("make_dt_interval(0, 0, cast(obs_id * 31 % 85 as int))")
    slot = F.floor((F.unix_seconds(arrived) - F.unix_seconds(F.lit(T0))) / (9100 * 12)).cast("int")
    base = step_path(spark, "entries-test")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        replay.in_slots(df, slot, 5, lambda s: replay.to_files(entries.entry_states(s, "key"), base), "entries-test")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = spark.read.schema(entries.OUT).parquet(f"{base}/out").collect()
    until = max(t for _, t, _ in rows) - timedelta(minutes=90)
    want = H.entry_transitions(df, F.lit(until)).collect()
    key = lambda r: (r.key, r["at"], r.state, r.missing_count, r.sightings)
    assert len(got) > 100 and sorted(map(key, got)) == sorted(map(key, want))


def test_entries_of_a_bucket_share_calls_and_timers():
    """However many entries a bucket holds, a batch reads and writes its state once and sets one timer; nothing to tell is no frame."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.rows, self.puts, self.timers = [], 0, set()

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.puts = rows, self.puts + 1

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, at):
            self.timers.discard(at)

        def registerTimer(self, at):
            self.timers.add(at)

    class Mark:
        def __init__(self, minutes):
            self.minutes = minutes

        def getCurrentWatermarkInMs(self):
            return self.minutes * 60_000

    keys = [None, ""] + [f"k{i}" for i in range(300)]
    frame = pd.DataFrame({"key": keys, "ts": pd.to_datetime([i * 60 for i in range(len(keys))], unit="s")})
    handle, machine = Handle(), entries.Entries(360 * 60_000_000)
    machine.init(handle)
    assert list(machine.handleInputRows((5,), iter([frame]), Mark(-1))) == [] and handle.puts == 1 and handle.timers == {0}
    (told,) = machine.handleExpiredTimer((5,), Mark(100), None)
    assert told["state"].tolist() == ["PRESENT"] * 101 and handle.puts == 2 and handle.timers == {101 * 60_000}
    (gone,) = machine.handleExpiredTimer((5,), Mark(9000), None)
    gone = gone[gone["state"] == "MISSING"]
    assert sorted(gone["key"], key=str) == sorted(keys, key=str) and not handle.timers
    again = pd.DataFrame({"key": [None], "ts": pd.to_datetime([9001 * 60], unit="s")})
    (back,) = machine.handleInputRows((5,), iter([again]), Mark(9001))
    assert back[["key", "state", "sightings"]].values.tolist() == [[None, "PRESENT", 2]] and len(handle.rows) == len(keys)


# late data

def test_late_rows_land_apart(spark):
    base, at = step_path(spark, "split-test"), lambda h: T0 + timedelta(hours=h)
    first = [(1, at(0), at(0)), (2, at(5), at(5)), (3, at(6), at(5)), (4, at(9), at(5))]  # clamped, future
    second = [(5, at(3), at(8)), (6, at(8), at(8)), (7, at(-800), at(8)), (8, at(7), at(7.5))]
    write = arrivals.split(base)
    for b, rows in ((0, first), (1, second), (1, second)):  # the second batch comes twice
        write(spark.createDataFrame(rows, "id long, ts timestamp, arrived timestamp"), b)
    schema = spark.createDataFrame(first, "id long, ts timestamp, arrived timestamp").schema
    got = {(r.id, r["class"], r.batch, r.ts) for r in arrivals.landed(spark, base, schema).collect()}
    assert got == {(1, "late", 0, at(0)), (2, "fresh", 0, at(5)), (3, "clamped", 0, at(5)), (4, "future", 0, at(9)),
                   (5, "late", 1, at(3)), (6, "fresh", 1, at(8)), (7, "expired", 1, at(-800)), (8, "fresh", 1, at(7))}
    late = arrivals.landed(spark, base, schema, "late")
    assert {r.id for r in late.collect()} == {1, 5}
    write(spark.createDataFrame([], schema), 2)  # an empty batch


# health and alerts

def model(runs):
    """Runs and alerts, one run at a time."""
    state, scored, events = {}, set(), set()
    for r in sorted(runs.collect(), key=lambda r: (r.started_at, r.run_id)):
        streak, last, is_open, recent = state.get(r.source, (0, None, False, []))
        streak, recent = 0 if r.ok else streak + 1, (recent + [r["items"]])[-20:]
        if streak >= 3 and (last is None or r.started_at - last > timedelta(hours=12)):
            events.add((r.source, r.started_at, "FUENTE-CAIDA", streak))
            last, is_open = r.started_at, True
        elif r.ok and is_open:
            events.add((r.source, r.started_at, "FUENTE-RECUPERADA", 0))
            is_open = False
        state[r.source] = (streak, last, is_open, recent)
        scored.add((r.run_id, streak, "FAILING" if streak >= 3 else "DEGRADED" if streak else "OK", round(sum(recent) / len(recent), 6)))
    return scored, events


def test_alerts_equal_model(spark):
    runs = skewed_runs(spark, 900)
    assert {(r.source, r["at"], r.kind, r.streak) for r in H.alerts(runs).collect()} == model(runs)[1]
    assert H.alerts(runs.limit(0)).count() == 0


def test_live_health_and_alerts_equal_model(spark):
    runs = skewed_runs(spark, 600)
    base = step_path(spark, "watch-test")
    slot = F.floor((F.unix_seconds("started_at") - F.unix_seconds(F.lit(T0))) / (40000 * 20)).cast("int")
    write = health.watch(base)

    def twice(batch, batch_id):  # every batch is replayed
        write(batch, batch_id)
        write(batch, batch_id)

    replay.in_slots(runs, slot, 3, lambda s: replay.to_batches(s, base, twice), "watch-test")
    scored, events = model(runs)
    got = spark.read.parquet(f"{base}/runs").collect()
    assert {(r.run_id, r.streak, r.status, round(r.avg_items, 6)) for r in got} == scored and len(got) == 600
    assert {(r.source, r["at"], r.kind, r.streak) for r in spark.read.parquet(f"{base}/alerts").collect()} == events


def test_recovery_needs_a_sent_alert(spark):
    at = lambda h: T0 + timedelta(hours=h)
    runs = spark.createDataFrame([(s, i, at(i), i in (4, 9)) for s in "ab" for i in range(10)], "source string, run_id long, started_at timestamp, ok boolean")
    sent = spark.createDataFrame([("a", at(3.5)), ("a", at(2)), ("b", at(6))], "source string, at timestamp")
    assert {tuple(r) for r in H.recoveries(runs, sent).collect()} == {("a", 4, at(4), at(3.5)), ("a", 9, at(9), at(3.5)), ("b", 9, at(9), at(6))}


# windows

def test_only_closed_windows_come_out(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [(0, at(0.2), True, 1.0), (0, at(4), False, 2.0), (1, at(0.5), True, 4.0), (2, at(0.4), True, 8.0), (2, at(9.9), True, 16.0)]
    df = spark.createDataFrame(rows, "slot int, ts timestamp, ok boolean, items double")
    base = step_path(spark, "window-test")
    replay.in_slots(df, F.col("slot"), 3, lambda s: replay.to_files(live.cycle_windows(s), base), "window-test")
    got = {(r.window.start, r.runs, r.failed, r["items"]) for r in spark.read.parquet(f"{base}/out").collect()}
    # The first window closes after the first drain (watermark 2:30), so later rows of it are dropped; the last stays open.
    assert got == {(at(0), 1, 0, 1.0), (at(4), 1, 1, 2.0)}
