"""Repeated lines: of every line that several documents hold, only those of the first document stay.

The hash of every long line goes, once per task and document up to two, to a segment of the hash space. There two Bloom filters
are filled: the first holds what was seen once, the second what the first already held. What the second filter
holds is suspected; a false positive costs a line that travels in vain. Only suspected lines are shuffled with their
text, to be confirmed and to find the first document. The texts stay in the chunk table, and answers come back to it.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import materialize, shuffle_width
from .common import CHUNK_BYTES, batch_of, mix
from .exchange import Chunks

#: Code points of a key that may repeat.
LEAST = 10
#: Hashes of a segment, bits of each filter per hash, and bits that a hash sets.
SEGMENT, BITS, HASHES = 1 << 22, 16, 4
#: Hashes that a task holds before it passes them on, and those put into the filters together.
HELD, TOGETHER = 1 << 20, 1 << 16
#: Stands for a missing id: behind all others.
LAST = (1 << 63) - 1

SENT = pa.schema([("h", pa.int64()), ("part", pa.int64())])
SUSPECTS = pa.schema([("key", pa.binary()), ("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])


def key_of(line: bytes) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; None if it is too short to count."""
    key = line.strip().lower()
    n = len(key)
    return key if n >= LEAST and (n >= 4 * LEAST or len(key.decode(errors="replace")) >= LEAST) else None


class Bloom:
    """Membership of 64-bit hashes: never wrong about what it holds, seldom about the rest."""

    def __init__(self, entries: int):
        self.shift = np.uint64(64 - max(10, (entries * BITS - 1).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift) - 3), np.uint8)

    def _places(self, h: np.ndarray):
        a = mix(h)
        step = mix(a) | np.uint64(1)
        for _ in range(HASHES):
            place = a >> self.shift
            yield (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)
            a = a + step

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self._places(h):
            np.bitwise_or.at(self.bits, byte, bit)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for byte, bit in self._places(h):
            out &= (self.bits[byte] & bit) > 0
        return out


def twice_seen(hashes: list[np.ndarray]) -> np.ndarray:
    """Which of the hashes of a segment occur more than once in it, or seem to."""
    every = np.concatenate(hashes).view(np.uint64)
    once, twice = Bloom(len(every)), Bloom(len(every))
    for at in range(0, len(every), TOGETHER):
        own, n = np.unique(every[at:at + TOGETHER], return_counts=True)
        twice.add(own[(n > 1) | once.holds(own)])
        once.add(own)
    return twice.holds(every)


def _sent(most: int):
    """(h, part) of the long lines of each part, twice if two of its documents hold the line."""
    def run(batches):
        part, owner, again = None, {}, set()

        def out():
            h = np.fromiter((x for some in (owner, again) for x in some), np.uint64, len(owner) + len(again))
            return batch_of(SENT, h=h.view(np.int64), part=np.full(len(h), part, np.int64))

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if owner and (row["part"] != part or len(owner) > most):
                    yield out()
                    owner, again = {}, set()
                part = row["part"]
                for i, text in enumerate(row["texts"]):
                    at = (row["chunk"], i)
                    for line in text.split(b"\n"):
                        key = key_of(line)
                        if key:
                            h = xxh64_intdigest(key)
                            if owner.setdefault(h, at) != at:
                                again.add(h)
        if owner:
            yield out()

    return run


def _suspected(batches):
    """The rows of a segment whose hash was seen twice. A segment has a bounded number of rows and is held."""
    h, part = [], []
    for batch in batches:
        h.append(batch.column("h").to_numpy())
        part.append(batch.column("part").to_numpy())
    if h:
        hit = twice_seen(h)
        yield batch_of(SENT, h=np.concatenate(h)[hit], part=np.concatenate(part)[hit])


def _lines_of(batches):
    """The suspected lines of each chunk, with the first and the last document that holds them."""
    part, asked = None, set()
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).select(["part", "ids", "texts"]).to_pylist()[0]
            if row["part"] != part:
                part, asked = row["part"], set(batch.column("hashes")[r].values.to_numpy().view(np.uint64).tolist())
            held: dict[bytes, tuple[int, int]] = {}
            for doc_id, text in zip(row["ids"], row["texts"]):
                doc_id = LAST if doc_id is None else doc_id
                for line in text.split(b"\n"):
                    key = key_of(line)
                    if key and xxh64_intdigest(key) in asked:
                        lo, hi = held.get(key, (doc_id, doc_id))
                        held[key] = min(lo, doc_id), max(hi, doc_id)
            if held:
                yield batch_of(SUSPECTS, key=list(held), part=[part] * len(held), first=[x for x, _ in held.values()],
                               last=[x for _, x in held.values()])


def _kept(batches):
    """Every document without the lines that an earlier one has."""
    part, first = None, {}
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).select(["part", "ids", "texts"]).to_pylist()[0]
            if row["part"] != part:
                part, repeats = row["part"], batch.column("repeats")[r].as_py()
                first = {x["digest"]: x["first"] for x in repeats or ()}
            lines, dropped, texts = [], [], []
            for doc_id, text in zip(row["ids"], row["texts"]):
                doc_id, own = LAST if doc_id is None else doc_id, text.split(b"\n")
                lines.append(len(own))
                if first:
                    keys = [key_of(line) for line in own]
                    own = [line for line, key in zip(own, keys) if not key or first.get(md5(key).digest(), doc_id) >= doc_id]
                dropped.append(lines[-1] - len(own))
                texts.append(b"\n".join(own) if dropped[-1] else text)
            yield batch_of(KEPT, doc_id=row["ids"], n_lines=lines, n_dropped=dropped, kept=texts)


def _to_parts(chunks: Chunks, answers: DataFrame) -> DataFrame:
    """The chunk table with the one answer to each part. Texts are not shuffled."""
    return chunks.table.join(answers.hint("merge"), "part", "left")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (what is left, as bytes).

    Lines end at \\n; a null or empty text is one empty line, and an empty table gives no rows. A line with a key of ten code
    points or more goes if a smaller id holds the key, so lines that only rows of one id hold all stay, as do all lines of the
    first id. Rows without id come last, and count as one document. Lines are the same if their keys are, byte by byte;
    an answer names a confirmed key by its MD5.
    """
    chunks = Chunks(docs, CHUNK_BYTES, id_col, text_col)
    sent = materialize(chunks.table.mapInArrow(_sent(HELD), "h long, part long"), "hashes")
    segments = max(shuffle_width(docs.sparkSession), -(-sent.count() // SEGMENT))
    suspects = sent.repartition(segments, "h").mapInArrow(_suspected, "h long, part long")
    asked = suspects.groupBy("part").agg(F.collect_set("h").alias("hashes"))
    rows = _to_parts(chunks, asked).filter("hashes IS NOT NULL").select("part", "ids", "texts", "hashes")
    lines = materialize(rows.mapInArrow(_lines_of, "key binary, part long, first long, last long"), "suspects")
    keys = lines.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("latest")).filter("first < latest").drop("latest")
    found = lines.select("key", "part", "last").join(keys, "key").filter("last > first")
    repeats = found.groupBy("part").agg(F.collect_set(F.struct(F.unhex(F.md5("key")).alias("digest"), "first")).alias("repeats"))
    rows = _to_parts(chunks, repeats).select("part", "ids", "texts", "repeats")
    return rows.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept binary")
