"""The seen-entry machine: PRESENT on sight, MISSING after six silent cadences, never deleted.

Sightings may come in any order within the watermark. An entry keeps its open spells: runs of sightings with no gap longer than the
silence. Merging a sighting into them does not depend on the order, and a spell that the watermark has left behind by the
silence is closed and forgotten, so an entry holds a spell or two however often it is seen. What happened is told
as soon as the watermark makes it final, which a timer sees to. Entries are worked off by buckets of their keys: calls and
timers then do not grow with the number of entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..rules import lexicon as L

OUT = "key string, at timestamp, state string, missing_count int, sightings long"
#: Groups of entries that are worked off together: a call and its state cost the same for one entry as for hundreds.
BUCKETS = 1024
#: An open spell of an entry in microseconds; ``told``: its start has been passed on. An entry without one has a row with ``n`` 0.
SPELL = StructType([
    StructField("named", BooleanType()), StructField("key", StringType()), StructField("before", LongType()), StructField("state", StringType()),
    StructField("start", LongType()), StructField("stop", LongType()), StructField("n", LongType()), StructField("told", BooleanType())])


def spells_of(times: np.ndarray, silence: int) -> list[list]:
    """Sorted times as spells [start, stop, n, told]."""
    cut = np.flatnonzero(np.diff(times) > silence) + 1
    edges = [0, *cut.tolist(), len(times)]
    return [[int(times[a]), int(times[b - 1]), b - a, False] for a, b in zip(edges, edges[1:]) if b > a]


def merged(spells: list[list], silence: int) -> list[list]:
    """Spells in order, with those joined that are no more than the silence apart."""
    out: list[list] = []
    for start, stop, n, told in sorted(spells):
        if out and start - out[-1][1] <= silence:
            out[-1] = [out[-1][0], max(out[-1][1], stop), out[-1][2] + n, out[-1][3] or told]
        else:
            out.append([start, stop, n, told])
    return out


class Entries(StatefulProcessor):
    """The entries of one bucket: per key the sightings of closed spells, the state and the open spells."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getListState("spells", SPELL)

    def _held(self) -> dict[str | None, list]:
        held: dict[str | None, list] = {}
        for named, key, before, state, start, stop, n, told in self.spells.get():
            entry = held.setdefault(key if named else None, [int(before), state, []])
            if n:
                entry[2].append([int(start), int(stop), int(n), bool(told)])
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for frame in rows:  # one Arrow batch at a time, never all sightings of a bucket
            times = frame["ts"].to_numpy("datetime64[us]").astype(np.int64)
            which, names = pd.factorize(frame["key"], use_na_sentinel=False)
            order = np.lexsort((times, which))
            for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
                name = names[which[part[0]]]
                entry = held.setdefault(None if pd.isna(name) else name, [0, "PRESENT", []])
                entry[2] = merged(entry[2] + spells_of(times[part], self.silence), self.silence)
        yield from self._tell(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._tell(self._held(), timerValues.getCurrentWatermarkInMs())

    def _tell(self, held: dict[str | None, list], watermark_ms: int) -> Iterator[pd.DataFrame]:
        mark, out, keep, due = watermark_ms * 1000, [], [], []
        for key, (before, state, spells) in held.items():
            while spells:
                start, stop, n, told = spells[0]
                state = "PRESENT"
                if not told:
                    if start > mark:
                        due.append(start)
                        break
                    out.append((key, start, "PRESENT", 0, before + 1))
                    spells[0][3] = True
                if stop + self.silence > mark:
                    due.append(stop + self.silence)
                    break
                out.append((key, stop + self.silence, "MISSING", L.MISSING_AFTER, before + n))
                before, state = before + n, "MISSING"
                del spells[0]
            keep += [(key is not None, key or "", before, state, *x) for x in spells or [[0, 0, 0, False]]]
        self.spells.put(keep)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        if out:
            frame = pd.DataFrame(out, columns=["key", "at", "state", "missing_count", "sightings"])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame

    def close(self) -> None:
        pass


def entry_states(stream: DataFrame, key: str, ts: str = "ts", delay: str = "90 minutes") -> DataFrame:
    """Transitions of every entry, each once the watermark has passed it. Needs the RocksDB state store (``replay.start``)."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    silence = L.CADENCE_MINUTES * L.MISSING_AFTER * 60 * 1_000_000
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Entries(silence), outputStructType=OUT, outputMode="append", timeMode="eventTime")
