"""A store of keys with facts that can be merged, as immutable segments: first-seen with refresh, and a sink where keys land once.

Every batch adds one segment, cut into hash buckets and sorted by key; reading merges the segments. Whether a key of a batch is
known is asked first of a Bloom filter per bucket and segment, and only buckets that may hold one of the batch's keys are read, so
a batch of new keys reads no keys at all. The number of buckets is a power of two that grows with the store, and segments
are merged when there are many, so a bucket stays small and a batch reads no more because others have stored much.

A segment counts once its commit is written. A batch that comes again finds its commit and changes nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import exists, materialize, step_path

#: Keys of a bucket, segments that are kept before they are merged, bits and hashes per key of a filter (wrong for one key in 100,000).
BUCKET, SEGMENTS, BITS, HASHES = 100_000, 8, 24, 12
MERGES = {"min": F.min, "max": F.max, "sum": F.sum}
COMMITS = "seq long, writer string, batch long, buckets long, rows long, covers array<long>, done map<string, long>"


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """HASHES positions below ``size`` for every hash, one column each."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    rows = (h[:, None] + step[:, None] * np.arange(1, HASHES + 1, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((rows >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def filter_of(h: np.ndarray) -> bytes:
    flags = np.zeros(-(-max(len(h), 1) * BITS // 8) * 8, bool)
    flags[_places(h, len(flags)).ravel()] = True
    return np.packbits(flags, bitorder="little").tobytes()


def may_hold(bits: bytes, h: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits, np.uint8)
    place = _places(h, len(raw) * 8)
    return (raw[place >> 3] >> (place & 7).astype(np.uint8) & 1).all(axis=1)


class KeyStore:
    """``keys``: the columns that name a key. ``merges``: how each other column is merged: min, max, sum, or keep (the first)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merges: dict[str, str]):
        self.spark, self.path, self.keys, self.merges = spark, path, keys, merges
        #: Bucket files that the last batch had to read.
        self.read_buckets = 0

    # --- what is there

    def commits(self) -> list[dict]:
        """Commits in order; few, as segments are merged."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMITS).json(f"{self.path}/commits/*")
        return [r.asDict(recursive=True) for r in rows.orderBy("seq").collect()]

    @staticmethod
    def live(commits: list[dict]) -> list[dict]:
        gone = {s for c in commits for s in c["covers"] or ()}
        return [c for c in commits if c["seq"] not in gone]

    def _segments(self, live: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/seq={c['seq']}" for c in live]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)

    def _merged(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        aggs = [(F.min_by(c, order) if order else F.min(c)) if how == "keep" else MERGES[how](c) for c, how in self.merges.items()]
        return rows.groupBy(*self.keys).agg(*[a.alias(c) for a, c in zip(aggs, self.merges)])

    def rows(self) -> DataFrame | None:
        """Every key with its merged facts; None before the first batch."""
        live = self.live(self.commits())
        return self._merged(self._segments(live), "seq") if live else None

    # --- a batch

    def merge(self, batch: DataFrame, writer: str, batch_id: int) -> DataFrame | None:
        """Add a batch; returns its keys that were not known, with their facts. ``writer`` names the checkpoint it comes from."""
        commits = self.commits()
        again = [c for c in commits if c["writer"] == writer and c["batch"] == batch_id]
        if again:
            seq = again[0]["seq"]
            held = f"{self.path}/new/seq={seq}"
            return self.spark.read.parquet(held) if exists(self.spark, held) else None
        if any((c["done"] or {}).get(writer, -1) >= batch_id for c in commits):
            return None  # merged long ago
        live = self.live(commits)
        seq = commits[-1]["seq"] + 1 if commits else 0
        own = materialize(self._merged(batch).withColumn("_h", F.xxhash64(*self.keys)), "batch")
        n = own.count()
        known = self._known(own, live)
        fresh = own if known is None else own.join(known, self.keys, "left_anti")
        fresh = fresh.drop("_h")
        fresh.write.mode("overwrite").parquet(f"{self.path}/new/seq={seq}")
        self._write(own, seq, self._buckets(n + sum(c["rows"] for c in live)), n, writer, batch_id, [], {})
        live = self.live(self.commits())
        if len(live) > SEGMENTS:
            self._compact(live, seq + 1)
        return self.spark.read.schema(fresh.schema).parquet(f"{self.path}/new/seq={seq}")

    @staticmethod
    def _buckets(rows: int) -> int:
        return 1 << max(2, (rows // BUCKET).bit_length())

    def _write(self, rows: DataFrame, seq: int, buckets: int, n: int, writer: str | None, batch_id: int | None, covers: list, done: dict) -> None:
        placed = rows.withColumn("bucket", F.pmod("_h", F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("bucket", *self.keys)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/seq={seq}")
        blooms = pa.schema([("bucket", pa.int64()), ("bits", pa.binary())])

        def run(batches):
            held: dict[int, list] = {}
            for b in batches:
                at = b.column("bucket").to_numpy()
                h = b.column("_h").to_numpy()
                for k in np.unique(at).tolist():
                    held.setdefault(k, []).append(h[at == k])
            for k, parts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([filter_of(np.concatenate(parts))], pa.binary())], schema=blooms)

        stored = self.spark.read.schema(placed.select("_h", "bucket").schema).parquet(f"{self.path}/data/seq={seq}")
        stored.repartition(buckets, "bucket").select("bucket", "_h").mapInArrow(run, "bucket long, bits binary").write.mode(
            "overwrite").parquet(f"{self.path}/blooms/seq={seq}")
        note = dict(seq=seq, writer=writer, batch=batch_id, buckets=buckets, rows=n, covers=covers, done=done)
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/seq={seq}")

    def _known(self, own: DataFrame, live: list[dict]) -> DataFrame | None:
        """Keys of the batch that a segment holds."""
        self.read_buckets = 0
        if not live:
            return None
        blooms = self.spark.read.option("basePath", f"{self.path}/blooms").parquet(*[f"{self.path}/blooms/seq={c['seq']}" for c in live])
        blooms = blooms.withColumn("buckets", F.element_at(F.create_map(*[F.lit(x) for c in live for x in (c["seq"], c["buckets"])]), F.col("seq").cast("long")))
        sizes = sorted({c["buckets"] for c in live})
        asked = own.select("_h", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("buckets"))
        asked = asked.withColumn("bucket", F.pmod("_h", F.col("buckets")))
        maybe = pa.schema([("_h", pa.int64()), ("seq", pa.int64()), ("bucket", pa.int64())])

        def probe(_, left, right):
            h = left.column("_h").to_numpy()
            parts = []
            for seq, bits in zip(right.column("seq").to_pylist(), right.column("bits").to_pylist()):
                hit = h[may_hold(bits, h)]
                parts.append(pa.table({"_h": hit, "seq": np.full(len(hit), seq), "bucket": np.full(len(hit), right.column("bucket")[0].as_py())}, schema=maybe))
            return pa.concat_tables(parts) if parts else maybe.empty_table()

        group = ["buckets", "bucket"]
        hits = asked.groupBy(*group).cogroup(blooms.select(*group, F.col("seq").cast("long").alias("seq"), "bits").groupBy(*group)).applyInArrow(
            probe, "_h long, seq long, bucket long")
        hits = materialize(hits, "maybe")
        places = [(r.seq, r.bucket) for r in hits.select("seq", "bucket").distinct().collect()]  # segments x buckets at most
        self.read_buckets = len(places)
        if not places:
            return None
        stored = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/seq={s}/bucket={b}" for s, b in places])
        return stored.join(own.select(*self.keys), self.keys, "left_semi").select(*self.keys).distinct()

    def _compact(self, live: list[dict], seq: int) -> None:
        rows = materialize(self._merged(self._segments(live), "seq").withColumn("_h", F.xxhash64(*self.keys)), "merged")
        n = rows.count()
        done: dict[str, int] = {}
        for c in live:
            for w, b in {**(c["done"] or {}), **({c["writer"]: c["batch"]} if c["writer"] else {})}.items():
                done[w] = max(done.get(w, -1), b)
        self._write(rows, seq, self._buckets(n), n, None, None, [c["seq"] for c in live], done)


def first_seen(store: KeyStore, key: str, ts: str, writer: str, out: str):
    """foreachBatch function: keys never seen before land in ``out`` with their batch, all others only refresh the store.

    The store merges first_seen (min), last_seen (max) and sightings (sum).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        facts = batch.select(F.col(key).alias("key"), F.col(ts).alias("first_seen"), F.col(ts).alias("last_seen"), F.lit(1).cast("long").alias("sightings"))
        fresh = store.merge(facts, writer, batch_id)
        if fresh is not None:
            fresh.write.mode("overwrite").parquet(f"{out}/writer={writer}/batch={batch_id}")

    return write


SEEN = {"first_seen": "min", "last_seen": "max", "sightings": "sum"}


def seen_state(seen: DataFrame, as_of, cadence_minutes: int, passes: int) -> DataFrame:
    """The store's keys with missing_count and state as of a moment."""
    stale = F.floor((F.unix_seconds(as_of) - F.unix_seconds("last_seen")) / (cadence_minutes * 60))
    missing = F.greatest(F.lit(0), F.least(F.lit(passes), stale)).cast("int")
    return seen.withColumn("missing_count", missing).withColumn("state", F.when(missing >= passes, "MISSING").otherwise("PRESENT"))


def idempotent_writer(store: KeyStore, writer: str):
    """foreachBatch function: every key lands once, with the least of its rows in the first batch that has it, whatever is
    replayed or drained anew from another checkpoint. ``store`` keeps the other columns as one struct ``row`` (keep)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in store.keys]
        row = F.struct(*rest) if rest else F.struct(F.lit(True).alias("stored"))
        store.merge(batch.select(*store.keys, row.alias("row")), writer, batch_id)

    return write


def new_store(spark: SparkSession, keys: list[str], merges: dict[str, str], name: str = "store") -> KeyStore:
    return KeyStore(spark, step_path(spark, name), keys, merges)
