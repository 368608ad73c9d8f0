"""Reading text in bounded chunks inside tasks, and values every executor may need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Text that one step of a task holds at a time. A longer single text makes a chunk of its own.
CHUNK_BYTES = 2 << 20
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15
_memories: list[dict] = []


def memory() -> dict:
    """A dictionary that a worker keeps from task to task, until it is told to forget."""
    _memories.append({})
    return _memories[-1]


def forget() -> None:
    """Drop what this worker has kept for other operators: an executor's workers outlive a step."""
    for held in _memories:
        held.clear()


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only what an operator reads, under fixed names, so other columns of ``docs`` cannot clash."""
    return docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"),
                       *[c.alias(n) for n, c in more.items()])


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``limit`` bytes of text, with the texts as bytes; null is the empty text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at), [x or b"" for x in texts.slice(at, to - at).to_pylist()]
            at = to


def concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbours, by doubling the length."""
    out, have, part, length = None, 0, values, 1
    while True:
        if width & length:
            if out is None:
                out, have = part, length
            else:
                n = max(0, len(part) - have)
                out = out[:n] * np.uint64(pow(MULTIPLIER, length, 1 << 64)) + part[have:have + n]
                have += length
        if have == width:
            return mix(out)
        n = max(0, len(part) - length)
        part = part[:n] * np.uint64(pow(MULTIPLIER, length, 1 << 64)) + part[length:length + n]
        length *= 2


def ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of the ranges [lo, hi), and the number of the range it is from."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    first = np.cumsum(size) - size
    return np.arange(len(of)) - first[of] + lo[of], of


def between(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, stop)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of ``starts``."""
    return between(starts, np.minimum(starts + width, n), n)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
