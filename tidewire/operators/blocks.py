"""Comparison of groups of rows, block by block.

Groups of any size are cut into blocks of ``BLOCK`` rows. Every pair of blocks that has to meet is a key of its own: the rows travel
packed, come sorted by it, and a task holds two blocks at a time. What a pair of blocks returns is at most one row per member,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = 2048
#: Pairs of rows that are looked at together: few enough for the cache.
CELLS = 1 << 18
_KEY = ["_ga", "_gb", "_ba", "_bb"]


class Side:
    """The rows of one block, in the order of time and id."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __len__(self) -> int:
        return len(self.table)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def rows(self, name: str) -> pa.Array:
        column = self.table.column(name).combine_chunks()
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column

    def matrix(self, name: str) -> np.ndarray:
        """A list column whose lists are all of one length."""
        return self.rows(name).flatten().to_numpy(zero_copy_only=False).reshape(len(self), -1).astype(np.float64)


def meet(rows: DataFrame, group: str, pairs: DataFrame, judge: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """``judge(a, b, record)`` over every pair of blocks of every pair of groups; ``b`` is None where a block meets itself.

    ``rows``: group, t, id and what the judge reads. ``pairs``: group_a <= group_b and extra columns, which become the record.
    """
    extra = [c for c in pairs.columns if c not in ("group_a", "group_b")]
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    # Nothing that grows with the table is broadcast: stored groups and pairs are far larger in memory than their files.
    placed = rows.join(sizes.hint("merge"), group).withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    size = {x: sizes.select(F.col(group).alias(f"group_{x}"), F.col("_n").alias(f"_n{x}")) for x in "ab"}
    wide = pairs.join(size["a"].hint("merge"), "group_a").join(size["b"].hint("merge"), "group_b")
    same = F.col("_ga") == F.col("_gb")

    def side(mine: str, other: str, number: int) -> DataFrame:
        names = [c for c in rows.columns if c != group]
        own = wide.select(F.col(f"group_{mine}").alias(group), F.col("group_a").alias("_ga"), F.col("group_b").alias("_gb"), F.col(f"_n{other}").alias("_m"), *extra)
        met = placed.join(own.hint("merge"), group).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        # A group that meets itself: each pair of blocks once, and a block itself from one side.
        met = met.filter(~same | ((F.col("_blk") <= F.col("_other")) if mine == "a" else (F.col("_other") < F.col("_blk"))))
        ba, bb = ("_blk", "_other") if mine == "a" else ("_other", "_blk")
        return met.select("_ga", "_gb", F.col(ba).alias("_ba"), F.col(bb).alias("_bb"), F.lit(number).alias("_side"), *names, *extra)

    both = side("a", "b", 0).unionByName(side("b", "a", 1))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held, now, done, n = [], None, [], 0

        def judged():
            table = pa.Table.from_batches(held)
            first = np.searchsorted(table.column("_side").to_numpy(), 1)
            a, b = Side(table.slice(0, first)), Side(table.slice(first))
            itself = now[0] == now[1] and now[2] == now[3]
            if itself or (len(a) and len(b)):
                record = {c: table.column(c)[0].as_py() for c in extra}
                return judge(a, None if itself else b, record)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _KEY], axis=1)
            edges = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if lo == hi:
                    continue
                key = tuple(keys[lo].tolist())
                if held and key != now:
                    result = judged()
                    if result is not None and len(result[out.names[0]]):
                        done.append(pa.RecordBatch.from_arrays([pa.array(result[f.name], f.type) for f in out], schema=out))
                        n += len(done[-1])
                    held = []
                    if n > 10_000:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done, n = [], 0
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            result = judged()
            if result is not None and len(result[out.names[0]]):
                done.append(pa.RecordBatch.from_arrays([pa.array(result[f.name], f.type) for f in out], schema=out))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return both.repartition(*_KEY).sortWithinPartitions(*_KEY, "_side", "t", "id").mapInArrow(run, schema)


def earlier(probe: Side, other: Side | None) -> tuple[Side, np.ndarray]:
    """The candidates of a side, and for each of its rows how many of them come before it in (time, id)."""
    if other is None:
        return probe, np.arange(len(probe))
    t, i = np.concatenate([other["t"], probe["t"]]), np.concatenate([other["id"], probe["id"]])
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((i, t))] = np.arange(len(t))
    return other, np.searchsorted(rank[:len(other)], rank[len(other):])


def slices(n: int, width: int):
    """Ranges of rows whose comparison with ``width`` others stays within ``CELLS``."""
    step = max(1, CELLS // max(width, 1))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def local_roots(adjacent: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """Connected components of one block pair as (node, smallest id) rows: a spanning star."""
    return roots_of(*np.nonzero(adjacent), ids_a, ids_b)


def roots_of(ra: np.ndarray, rb: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """As ``local_roots``, from the places of the links."""
    if len(ra) == 0:
        return None
    ids, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    src, dst = at[ra], at[len(ids_a) + rb]
    label = np.arange(len(ids))
    while True:
        nxt = label.copy()
        np.minimum.at(nxt, src, label[dst])
        np.minimum.at(nxt, dst, label[src])
        nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            break
        label = nxt
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return {"node": ids[moved], "root": ids[label[moved]]}
