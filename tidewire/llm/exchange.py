"""Chunks of text that stay where they are while their keys travel.

The texts are written once as a table of chunks, bucketed by ``part`` (the task that wrote them, so a task writes one
file). Keys of the chunks go by shuffle to shards of the key space; what a shard answers comes back by a join on
``part``, which moves the answers and not the texts. A key is sent once per chunk, however often the chunk has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, materialize_bucketed, shuffle_width, small_batches
from .common import forget, keyed_text, text_chunks

#: Texts that a worker cuts into chunks at a time.
BATCH_BYTES = 8 << 20
#: A reader holds a row group at a time, several times over. By default it would be all that a task has written, as Parquet first
#: looks at the size after 100 rows, and rows are chunks of megabytes.
STORED = {"compression": "zstd", "parquet.block.size": 2 << 20, "parquet.page.size.row.check.min": 1}
CHUNKS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())),
                    ("carried", pa.list_(pa.string()))])
CHUNKS_DDL = "part long, chunk long, ids array<long>, texts array<binary>, carried array<string>"
ASK = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("shard", pa.int64()), ("body", pa.list_(pa.binary()))])
ASK_DDL = "part long, chunk long, shard long, body array<binary>"
ANSWER = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary())])
ANSWER_DDL = "part long, chunk long, shard long, answer binary"


class Chunks:
    """The chunk table of ``docs``; ``size``: all bytes of text; ``carry``: a string of each row that goes along."""

    def __init__(self, docs: DataFrame, chunk_bytes: int, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None):
        texts = keyed_text(docs, id_col, text_col, carried=F.lit(None).cast("string") if carry is None else carry)
        self.spark = docs.sparkSession
        self.size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        # with fewer buckets than shuffle partitions, Spark would rather move the texts
        self.buckets = max(shuffle_width(self.spark), -(-self.size // (16 << 20)))

        def cut(batches):
            forget()
            part = TaskContext.get().partitionId()
            for chunk, (rows, own) in enumerate(text_chunks(batches, chunk_bytes)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([part]), pa.array([chunk]), pa.array([rows.column("id").to_pylist()], CHUNKS.field("ids").type),
                    pa.array([own], CHUNKS.field("texts").type),
                    pa.array([rows.column("carried").to_pylist()], CHUNKS.field("carried").type)], schema=CHUNKS)

        with small_batches(self.spark, BATCH_BYTES):
            self.table = materialize_bucketed(texts.mapInArrow(cut, CHUNKS_DDL), "chunks", "part", self.buckets, **STORED)

    def shards(self, bytes_each: int) -> int:
        return max(1, -(-self.size // bytes_each))

    def with_answers(self, answers: DataFrame | None) -> DataFrame:
        """Every chunk with the answers to it, in the order of the shards."""
        if answers is None:
            return self.table.withColumn("answer", F.lit(None).cast("array<binary>"))
        own = answers.groupBy("part", "chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias("a"))
        per_part = own.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "a.answer"))).alias("all"))
        joined = self.table.join(per_part.hint("merge"), "part", "left")
        return joined.select(*CHUNKS.names, F.try_element_at("all", "chunk").alias("answer"))

    def map(self, rows: DataFrame, fn: Callable[[dict], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
        """``fn`` over chunk rows, one at a time."""
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from fn(batch.slice(i, 1).to_pylist()[0])

        return rows.mapInArrow(run, ddl)


def ask(row: dict, parts: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    """What a chunk sends: (shard, body) as rows."""
    parts = list(parts)
    if parts:
        n = len(parts)
        yield pa.RecordBatch.from_arrays([
            pa.array([row["part"]] * n), pa.array([row["chunk"]] * n), pa.array([s for s, _ in parts], pa.int64()),
            pa.array([b for _, b in parts], ASK.field("body").type)], schema=ASK)


def answered(asked: DataFrame, fn: Callable[[list[list[bytes]]], list[bytes]], name: str) -> DataFrame:
    """``fn`` over the bodies that all chunks sent to one shard, with one answer each; stored."""
    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield _reply(held, fn)
                    held = []
                held.append(row)
        if held:
            yield _reply(held, fn)

    rows = asked.repartition("shard").sortWithinPartitions("shard")
    return materialize(rows.mapInArrow(run, ANSWER_DDL), name)


def _reply(rows: list[dict], fn) -> pa.RecordBatch:
    answers = fn([r["body"] for r in rows])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in ("part", "chunk", "shard")]
                                      + [pa.array(answers, pa.binary())], schema=ANSWER)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte over all numbers: sorted numbers then compress."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view(np.uint64)[:, 0]


def within(keys: np.ndarray, shards: int) -> np.ndarray:
    """40 bits of a key that, inside its shard, rise with it."""
    high = (keys >> np.uint64(32)) * np.uint64(shards) & np.uint64(0xFFFFFFFF)
    return high << np.uint64(8) | keys >> np.uint64(24) & np.uint64(0xFF)


def in_turn(first: DataFrame, second: DataFrame, shards: int) -> DataFrame:
    """Both answers to each chunk, the first before the second, each led by a byte that tells which it is."""
    return first.withColumn("answer", F.concat(F.lit(bytes([1])), "answer")).union(
        second.withColumn("shard", F.col("shard") + shards).withColumn("answer", F.concat(F.lit(bytes([2])), "answer")))


def split_turns(answers: list[bytes] | None) -> tuple[list[bytes], list[bytes]]:
    return [x[1:] for x in answers or [] if x[0] == 1], [x[1:] for x in answers or [] if x[0] == 2]
