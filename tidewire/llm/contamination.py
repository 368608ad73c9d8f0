"""Passages of a test set in training text, through a stored positional inverted index.

``build_index`` cuts the documents into blocks and stores, per block, every term with its sorted word positions.
``phrase_matches`` and ``proximity_matches`` then read only the index. A phrase is found by taking the
postings of its rarest term in the block, shifting them by the term's place in the phrase, and keeping the
positions that the other terms' shifted postings also hold, next rarest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import col, keyed_text, ragged, text_chunks

INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("terms", pa.binary()),
                   ("bounds", pa.binary()), ("positions", pa.binary())])
INDEX_DDL = "doc_ids array<long>, ends binary, terms binary, bounds binary, positions binary"
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
HITS = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("n_hit", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
HITS_DDL = ("block long, row long, doc_id long, n_words long, n_hit long, "
            "spans array<struct<start: long, stop: long>>, items array<string>")
#: Test text that one pass over the index takes; more test text takes more passes.
ITEM_BYTES = 32 << 20
#: Candidate positions looked at together.
CANDIDATES = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Words of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII."""
    return text.translate(_FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per block of documents.

    Null and empty texts have no words but stay in ``doc_ids``; a very long text is a block of its own.
    """
    def run(batches):
        for rows, texts in text_chunks(batches):
            number: dict[bytes, int] = {}
            words = [terms_of(t) for t in texts]
            ends = np.cumsum([len(w) for w in words])
            ids = np.fromiter((number.setdefault(t, len(number)) for w in words for t in w), np.int32, int(ends[-1]))
            bounds = np.zeros(len(number) + 1, np.int64)
            np.cumsum(np.bincount(ids, minlength=len(number)), out=bounds[1:])
            yield pa.RecordBatch.from_arrays([
                pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([ends.astype(np.int64).tobytes()], pa.binary()), pa.array([b" ".join(number)], pa.binary()),
                pa.array([bounds.astype(np.uint32).tobytes()], pa.binary()),
                pa.array([np.argsort(ids, kind="stable").astype(np.uint32).tobytes()], pa.binary())], schema=INDEX)

    index = keyed_text(docs, id_col, text_col).mapInArrow(run, INDEX_DDL)
    return materialize(index.withColumn("block", F.monotonically_increasing_id()), "postings")


class Block:
    """One row of the index, with the postings of the asked terms as sorted keys (term number, position)."""

    def __init__(self, row: dict, asked: dict[bytes, int]):
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.n_words = np.diff(self.ends, prepend=0)
        bounds, places = np.frombuffer(row["bounds"], np.uint32), np.frombuffer(row["positions"], np.uint32)
        found = sorted((asked[t], i) for i, t in enumerate(row["terms"].split(b" ")) if t in asked)
        self.start, self.size = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        parts, at = [], 0
        for number, i in found:
            part = places[bounds[i]:bounds[i + 1]].astype(np.int64)
            self.start[number], self.size[number] = at, len(part)
            parts.append(part)
            at += len(part)
        self.places = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.keys = np.repeat(np.array([n for n, _ in found], np.int64), [len(p) for p in parts]) << 32 | self.places

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term has that position in its postings."""
        key = term.astype(np.int64) << 32 | place
        at = np.searchsorted(self.keys, key)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def phrases(self, windows: np.ndarray, lengths: np.ndarray):
        """(window, position) of every occurrence. ``windows``: term numbers, padded with -1."""
        if not len(self.keys) or not len(windows):
            return
        sizes = np.where(windows < 0, np.iinfo(np.int64).max, self.size[windows])
        alive = np.flatnonzero(sizes.min(axis=1) > 0)
        order = np.argsort(sizes[alive], axis=1, kind="stable")
        least = sizes[alive, order[:, 0]]
        cuts = np.searchsorted(np.cumsum(least), np.arange(CANDIDATES, least.sum() + CANDIDATES, CANDIDATES))
        for lo, hi in zip([0, *cuts[:-1] + 1], cuts + 1):
            own = alive[lo:hi]
            if not len(own):
                continue
            rare = windows[own, order[lo:hi, 0]]
            place, of = ragged(self.start[rare], self.start[rare] + self.size[rare])
            place = self.places[place] - order[lo:hi, 0][of]
            ok = place >= 0
            place, of = place[ok], of[ok]
            for k in range(1, windows.shape[1]):
                offset = order[lo:hi, k][of]
                term = windows[own[of], offset]
                ok = (term < 0) | self.holds(term, place + offset)
                place, of = place[ok], of[ok]
            last = place + lengths[own[of]] - 1
            ok = np.searchsorted(self.ends, place, "right") == np.searchsorted(self.ends, last, "right")
            yield own[of[ok]], place[ok]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, stop) as maximal runs."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(first))], 1)


def _rows(row: dict, block: Block, start: np.ndarray, stop: np.ndarray, item: np.ndarray, names: list[str | None]):
    """The documents of a block with their runs of hit words and the items found in each."""
    doc = np.searchsorted(block.ends, start, "right")
    begin = block.ends - block.n_words
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(block.ends) + 1))
    out = {f.name: [] for f in HITS}
    for i, (doc_id, n) in enumerate(zip(row["doc_ids"], block.n_words.tolist())):
        own = order[cuts[i]:cuts[i + 1]]
        runs = _merged(np.unique(np.stack([start[own], stop[own]], 1), axis=0) - begin[i])
        found = {names[j] for j in np.unique(item[own])} - {None}
        for name, value in zip(out, (row["block"], i, doc_id, n, int((runs[:, 1] - runs[:, 0]).sum()) if len(runs) else 0,
                                     [{"start": a, "stop": b} for a, b in runs.tolist()], sorted(found))):
            out[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in HITS], schema=HITS)


def _item_groups(items: DataFrame, item_col: str, text_col: str):
    """Test items in groups of bounded size: (names, list of terms)."""
    names, texts, size = [], [], 0
    for name, text in items.select(col(item_col).cast("string"), col(text_col)).toLocalIterator():
        words = terms_of((text or "").encode())
        if not words:
            continue
        names.append(name)
        texts.append(words)
        size += len(text)
        if size >= ITEM_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
    yield names, texts


def _search(index: DataFrame, items: DataFrame, item_col: str, text_col: str, prepare, find) -> DataFrame:
    """One pass over the index per group of items; the passes' rows are put together per document."""
    passes = []
    for names, texts in _item_groups(items, item_col, text_col):
        if passes and not names:
            break
        asked: dict[bytes, int] = {}
        numbered = [[asked.setdefault(t, len(asked)) for t in words] for words in texts]
        plan = index.sparkSession.sparkContext.broadcast((names, asked, *prepare(numbered)))

        def run(batches, plan=plan):
            names, asked, *windows = plan.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    block = Block(row, asked)
                    found = [x for x in find(block, *windows)]
                    start, stop, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else [
                        np.zeros(0, np.int64)] * 3
                    yield _rows(row, block, start, stop, item, names)

        passes.append(index.select("block", *INDEX.names).mapInArrow(run, HITS_DDL))
    if len(passes) == 1:
        return passes[0].drop("block", "row")
    both = passes[0]
    for more in passes[1:]:
        both = both.union(more)

    def together(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                runs = _merged(np.array([(s["start"], s["stop"]) for s in r["spans"]], np.int64).reshape(-1, 2))
                r["spans"] = [{"start": a, "stop": b} for a, b in runs.tolist()]
                r["n_hit"], r["items"] = int((runs[:, 1] - runs[:, 0]).sum()), sorted(r["items"])
            yield pa.RecordBatch.from_pylist(rows, schema=HITS)

    return both.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).mapInArrow(together, HITS_DDL).drop("block", "row")


def phrase_matches(index: DataFrame, items: DataFrame, width: int = 10, item_col: str = "item_id",
                   text_col: str = "text") -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit, spans (word ranges hit), items (ids found, sorted).

    A window is ``width`` consecutive words of an item; a shorter item is one window, one without words none.
    A document word inside an occurrence of a window is hit; matches do not cross documents. Items with equal
    ids count once; an item without id marks words but is not listed. No items: nothing is hit.
    """
    def prepare(numbered):
        windows = sorted({(*w[i:i + width], *[-1] * (width - len(w)), n) for n, w in enumerate(numbered)
                          for i in range(max(1, len(w) - width + 1))})
        table = np.array(windows, np.int64).reshape(-1, width + 1)
        return table[:, :-1], (table[:, :-1] >= 0).sum(axis=1), table[:, -1]

    def find(block, windows, lengths, item):
        for window, place in block.phrases(windows, lengths):
            yield place, place + lengths[window], item[window]

    return _search(index, items, item_col, text_col, prepare, find)


def proximity_matches(index: DataFrame, items: DataFrame, within: int, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """As ``phrase_matches``, for all distinct words of an item, in any order, inside ``within`` words.

    The span runs from each place of the item's rarest term to the farthest of the nearest places of the
    others that together fit into ``within`` words, tried for every start of such a stretch.
    """
    def prepare(numbered):
        return ([sorted(set(w)) for w in numbered],)

    def find(block, items):
        for n, terms in enumerate(items):
            sizes = block.size[terms]
            if not len(block.keys) or sizes.min() == 0:
                continue
            lists = [block.places[block.start[t]:block.start[t] + block.size[t]] for t in terms]
            near = lists[int(sizes.argmin())]
            first, _ = ragged(near - within + 1, near + 1)  # a stretch that fits holds a place of the rarest term
            first = np.unique(first[first >= 0])
            last = first
            for places in lists:
                at = np.searchsorted(places, first)
                nearest = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], np.iinfo(np.int64).max)
                last = np.maximum(last, nearest)
            ok = last < first + within
            first, last = first[ok], last[ok]
            holds = np.zeros(len(first), bool)
            for t in terms:  # a stretch begins with one of the terms
                holds |= block.holds(np.full(len(first), t), first)
            first, last = first[holds], last[holds]
            ok = np.searchsorted(block.ends, first, "right") == np.searchsorted(block.ends, last, "right")
            yield first[ok], last[ok] + 1, np.full(int(ok.sum()), n)

    return _search(index, items, item_col, text_col, prepare, find)
