"""Duplicate passages of words: every word in a window of ``width`` words that occurs somewhere else.

Reference blocks of half that length, at every block-th word of a document, are indexed without overlap: a repeat
of ``width`` words holds a whole block of either place. Every rolling window of block length probes the
index. Around each hit the windows of full width are compared by hash over the corpus, so the hits
grow to maximal exact repeats. Keys are sent once per chunk of text, so the copies of a passage are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from . import exchange, logbloom
from .common import covered, mix, ragged, rolling
from .exchange import Chunks

WIDTH = 35
CHUNK, SHARD = 1 << 20, 8 << 20
KEY_BYTES, CHECK_BYTES = 5, 6
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])
KEPT_DDL = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"


class Words:
    """Words of the texts of a chunk as 64-bit values, and where each text's begin."""

    def __init__(self, texts: list[bytes]):
        self.lists = [t.split() for t in texts]
        self.starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in self.lists], out=self.starts[1:])
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for own in self.lists for w in own), np.int64, int(self.starts[-1]))
        self.values = np.array([xxh64_intdigest(w) for w in number], np.uint64)[ids] if number else np.zeros(0, np.uint64)

    def begins(self, length: int, least: int) -> np.ndarray:
        """Starts of the windows of ``length`` words in texts of at least ``least``."""
        size = np.diff(self.starts)
        ok = size >= max(length, least)
        return ragged(self.starts[:-1][ok], self.starts[1:][ok] - length + 1)[0]


def _block(width: int) -> int:
    return (width + 1) // 2


def _ask_blocks(row: dict, shards: int, width: int):
    w, block = Words(row["texts"]), _block(width)
    at = w.begins(block, width)
    h = rolling(w.values, block)[at] if len(at) else np.zeros(0, np.uint64)
    keys, count = np.unique(h, return_counts=True)
    stored = np.zeros(len(keys), np.uint8)
    doc = np.searchsorted(w.starts, at, "right") - 1
    stored[np.searchsorted(keys, h[(at - w.starts[doc]) % block == 0])] = 1
    flags = stored | (count > 1).astype(np.uint8) << 1
    yield from exchange.ask(row, ((s, [exchange.planes(exchange.within(keys[i:j], shards), KEY_BYTES), flags[i:j].tobytes()])
                                  for s, i, j in logbloom.slices(keys, shards)))


def _groups(parts: list[np.ndarray]):
    """Sort order of rows by some numbers, the first row of each group of equals, and the groups' sizes."""
    order = np.lexsort(parts[::-1]) if len(parts) > 1 else np.argsort(parts[0], kind="stable")
    new = np.zeros(max(len(order) - 1, 0), bool)
    for p in parts:
        new |= p[order][1:] != p[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    return order, first, np.diff(np.append(first, len(order)))


def _tell_blocks(bodies: list[list[bytes]]) -> list[bytes]:
    """Per key: 1 if some document has it as a block and it occurs more than once."""
    key = np.concatenate([exchange.from_planes(b[0], KEY_BYTES) for b in bodies])
    flags = np.frombuffer(b"".join(b[1] for b in bodies), np.uint8)
    order, first, count = _groups([key])
    seen = np.bitwise_or.reduceat(flags[order], first)
    hit = (seen & 1 > 0) & ((seen & 2 > 0) | (count > 1))
    return _back(hit.astype(np.uint8), order, count, [len(b[1]) for b in bodies])


def _back(values: np.ndarray, order: np.ndarray, count: np.ndarray, size: list[int]) -> list[bytes]:
    """The groups' values to their rows, cut by sender."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, count)
    return [x.tobytes() for x in np.split(out, np.cumsum(size)[:-1])]


def _candidates(row: dict, answers: list[bytes] | None, width: int):
    """Words, and the starts and keys of the windows of full width that hold a hit."""
    w, block = Words(row["texts"]), _block(width)
    at = w.begins(block, width)
    code = np.frombuffer(b"".join(answers or []), np.uint8)
    if not len(at) or not code.any():
        return w, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = rolling(w.values, block)[at]
    hits = at[code[np.searchsorted(np.unique(h), h)] == 1]
    before = width - block  # words of a window before the block that it holds
    near = covered(np.maximum(hits - before, 0), before + 1, len(w.values))
    starts = w.begins(width, width)
    starts = starts[near[starts]]
    check = rolling(mix(w.values), width)[starts] >> np.uint64(16)
    return w, starts, rolling(w.values, width)[starts], check


def _ask_windows(row: dict, shards: int, width: int):
    _, _, h, check = _candidates(row, row["answer"], width)
    keys, first, count = np.unique(h, return_index=True, return_counts=True)
    check, many = check[first], (count > 1).astype(np.uint8)
    yield from exchange.ask(row, ((s, [exchange.planes(exchange.within(keys[i:j], shards), KEY_BYTES),
                                       exchange.planes(check[i:j], CHECK_BYTES), many[i:j].tobytes()])
                                  for s, i, j in logbloom.slices(keys, shards)))


def _tell_windows(bodies: list[list[bytes]]) -> list[bytes]:
    """Per key: 1 if its window occurs more than once."""
    key = np.concatenate([exchange.from_planes(b[0], KEY_BYTES) for b in bodies])
    check = np.concatenate([exchange.from_planes(b[1], CHECK_BYTES) for b in bodies])
    many = np.frombuffer(b"".join(b[2] for b in bodies), np.uint8)
    order, first, count = _groups([key, check])
    repeated = (count > 1) | (np.maximum.reduceat(many[order], first) > 0)
    return _back(repeated.astype(np.uint8), order, count, [len(b[2]) for b in bodies])


def _kept(row: dict, width: int):
    hits, repeats = exchange.split_turns(row["answer"])
    w, starts, h, _ = _candidates(row, hits, width)
    code = np.frombuffer(b"".join(repeats), np.uint8)
    if len(starts):
        starts = starts[code[np.searchsorted(np.unique(h), h)] == 1]
    gone = covered(starts, width, len(w.values))
    out = {f.name: [] for f in KEPT}
    for i, (doc_id, words) in enumerate(zip(row["ids"], w.lists)):
        own = gone[w.starts[i]:w.starts[i + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
        kept, at = [], 0
        for x, y in edge.tolist():
            kept += words[at:x]
            at = y
        kept += words[at:]
        for name, value in zip(out, (doc_id, len(words), int(own.sum()), [{"start": x, "stop": y} for x, y in edge.tolist()],
                                     b" ".join(kept).decode())):
            out[name].append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in KEPT], schema=KEPT)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (maximal removed runs of words), kept (text).

    Words end at ASCII white space. A word goes if a window of ``width`` words over it has the same words as a window
    that starts anywhere else, also in the same document, so of equal rows nothing stays that is long enough. Windows
    are those of the input and do not cross texts. Null and empty texts have no words; kept words are joined by one space.
    """
    chunks = Chunks(docs, CHUNK, id_col, text_col)
    shards = chunks.shards(SHARD)
    asked = chunks.map(chunks.table, lambda row: _ask_blocks(row, shards, width), exchange.ASK_DDL)
    hits = exchange.answered(asked, _tell_blocks, "hits")
    asked = chunks.map(chunks.with_answers(hits), lambda row: _ask_windows(row, shards, width), exchange.ASK_DDL)
    repeats = exchange.answered(asked, _tell_windows, "repeats")
    both = exchange.in_turn(hits, repeats, shards)
    return chunks.map(chunks.with_answers(both), lambda row: _kept(row, width), KEPT_DDL)
