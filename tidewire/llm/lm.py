"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The n-gram counts of all training texts are summed by a shuffle, each segment of the key space becomes a part of
the filter, and the parts are broadcast if together they are sure to stay below a limit. Otherwise each segment answers the
texts whose n-grams it has counted; the filter, and so the scores, are the same. A token's probability is smoothed from the
unigram up: P(w|h) = (c(hw) + strength * P(w|h')) / (c(h) + strength), all counts from the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import materialize, small_batches
from . import exchange, logbloom, sums
from .common import CHUNK_BYTES, batch_of, keyed_text, mix, text_chunks
from .exchange import Chunks

#: n-grams of one filter segment, about; and the largest filter that is broadcast.
SEGMENT_KEYS, BROADCAST_BYTES = 1 << 21, 192 << 20
STRENGTH = 20.0
#: Rows that a worker gets at a time: keys come in pieces of many megabytes, and the JVM holds a batch several times over.
BATCH_BYTES = 8 << 20
SPACE = bytes([*range(9, 14), 32])
#: 1 for bytes of words, 0 for space.
INSIDE = bytes(x not in SPACE for x in range(256))

PARTS = pa.schema([("segment", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64()), ("tail", sums.TAIL)])
SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, " + sums.TAIL_DDL


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the end (of no bytes) first; the number of each token's word; tokens of each text."""
    joined = b"\n".join([*texts, b""]).lower()
    inside = np.frombuffer(joined.translate(INSIDE), np.int8)
    start, stop = np.flatnonzero(inside != np.concatenate([[np.int8(0)], inside[:-1]])).reshape(-1, 2).T
    before = np.searchsorted(stop, np.cumsum([len(t) + 1 for t in texts]), "right")  # words up to the end of each text
    # Words without the space between them are one Arrow array; a first end gets number 0.
    ends = np.concatenate([[0, 0], np.cumsum(np.insert(stop - start, before, 0))])
    tokens = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined.translate(None, SPACE))])
    seen = tokens.dictionary_encode()
    at, held = (np.frombuffer(b, t) for b, t in zip(seen.dictionary.buffers()[1:], (np.int64, np.uint8)))
    at, held = at[:len(seen.dictionary) + 1].tolist(), held.tobytes()
    return [held[i:j] for i, j in zip(at, at[1:])], seen.indices.to_numpy()[1:].astype(np.int64), np.diff(before, prepend=0) + 1


class Tokens:
    """Tokens of some texts (words with A-Z lower-cased, then one end each) and their n-grams.

    ``ids[n]`` numbers the n+1-gram that ends at each token, ``keys[n]`` has the key of each number. A gram is numbered from the
    numbers of its context and its word, so only distinct grams are hashed.
    """

    def __init__(self, texts: list[bytes], order: int):
        self.words, self.word, self.size = _numbered(texts)
        self.begin = np.cumsum(self.size) - self.size
        hashes = np.array([xxh64_intdigest(w) for w in self.words], np.uint64)
        self.ids, self.keys, end, self.padding = [self.word], [mix(hashes)], mix(hashes[:1]), []
        for _ in range(1, order):
            contexts = np.concatenate([self.keys[-1], end])  # the last is what stands before a text
            context = np.concatenate([[0], self.ids[-1][:-1]])
            context[self.begin] = len(contexts) - 1
            seen = pa.array(context * len(hashes) + self.word).dictionary_encode()  # by hash, nothing is sorted
            grams, ids = seen.dictionary.to_numpy(), seen.indices.to_numpy().astype(np.int64)
            self.ids.append(ids)
            self.keys.append(self._longer(contexts[grams // len(hashes)], hashes[grams % len(hashes)]))
            end = self._longer(end, hashes[:1])
            self.padding.append(end)

    def all_keys(self) -> np.ndarray:
        """The keys, and those of a context before the first word: as many ends as it takes."""
        return np.concatenate([*self.keys, *self.padding[:-1]])

    @staticmethod
    def _longer(context: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(context * np.uint64(0xD6E8FEB86659FD93) ^ last)


def gram_filter(texts: DataFrame, order: int, segments: int) -> DataFrame:
    """(segment, bits): the filter over the n-grams, n from 1 to ``order``, of all ``texts``."""
    def count(batches):
        for _, own in text_chunks(batches, 2 * CHUNK_BYTES):
            t = Tokens(own, order)
            keys = t.all_keys()
            counts = np.concatenate([*[np.bincount(i, minlength=len(k)) for i, k in zip(t.ids, t.keys)], np.full(len(keys), len(own))])[:len(keys)]
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort]
            for s, a, b in logbloom.slices(keys, segments):
                yield batch_of(PARTS, segment=[s], keys=[keys[a:b].tobytes()], counts=[counts[a:b].astype(np.uint32).tobytes()])

    def store(batches):
        for s, rows in by_segment(batches):
            keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            times = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            order_ = np.argsort(keys)
            keys, times = keys[order_], times[order_]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            bits = logbloom.build(keys[first], np.add.reduceat(times, first, dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"segment": [s], "bits": [bits]})

    parts = texts.mapInArrow(count, "segment long, keys binary, counts binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(store, "segment long, bits binary")


def by_segment(batches):
    """The rows of one segment at a time, from batches sorted by segment."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != at and held:
                yield at, held
                held = []
            at = row["segment"]
            held.append(row)
    if held:
        yield at, held


class Scorer:
    """What scoring needs besides the filter: exact counts of frequent words, and the totals."""

    def __init__(self, order: int, strength: float, head: dict[bytes, tuple], total: int, distinct: int):
        self.order, self.strength, self.head, self.total, self.distinct = order, strength, head, total, distinct

    def prepare(self, ids: list, held_out: list, texts: list[bytes]) -> dict:
        """All but the filter's answers: distinct n-gram keys, where each token's are, and what the words give."""
        t = Tokens(texts, self.order)
        keys = t.all_keys()
        sort = np.argsort(keys)
        rank = np.empty(len(keys), np.int32)
        rank[sort] = np.arange(len(keys), dtype=np.int32)
        first = np.cumsum([0, *map(len, t.keys)])
        count = np.array([self.head.get(w, (-1,))[0] for w in t.words], np.int64)[t.word]
        doc = np.repeat(np.arange(len(texts)), t.size)
        here = count >= 0
        rest = ~here
        return {"ids": ids, "held_out": held_out, "size": t.size, "begin": t.begin, "keys": keys[sort],
                "at": np.stack([rank[f + i] for f, i in zip(first, t.ids)]),
                "known": np.add.reduceat((count > 0).astype(np.int64), t.begin),
                "base": np.add.reduceat(np.where(here, np.log10(np.maximum(count, 0) + 0.5), 0), t.begin),
                "tail": sums.tails(doc[rest], t.word[rest], t.words, len(texts))}

    def finish(self, chunk: dict, codes: np.ndarray) -> pa.RecordBatch:
        """Scores, from the quantised count of each distinct key."""
        c = logbloom.values()[codes][chunk["at"]]
        p = (c[0] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        ends = c[0][chunk["begin"] + chunk["size"] - 1]  # texts ended: the count of every context that is only ends
        for n in range(1, self.order):
            context = np.concatenate([[0.0], c[n - 1][:-1]])
            context[chunk["begin"]] = ends
            together = np.minimum(c[n], c[0])  # of errors of the filter, those that cannot be
            context = np.maximum(context, together)
            p = (together + self.strength * p) / (context + self.strength)
        score = np.add.reduceat(np.log10(p), chunk["begin"])
        return batch_of(SCORED, doc_id=chunk["ids"], held_out=chunk["held_out"], n_tokens=chunk["size"],
                        known=chunk["known"], base=chunk["base"], score=score, tail=chunk["tail"])


def _near(docs: DataFrame, scorer, shared) -> DataFrame:
    """``shared``: the whole filter, put together once for all workers, which hold it in one piece."""
    def run(batches):
        own, found = scorer.value, shared.value
        for rows, texts in text_chunks(batches):
            chunk = own.prepare(rows.column("id"), rows.column("held_out"), texts)
            yield own.finish(chunk, found.ask(chunk["keys"]))

    return docs.mapInArrow(run, SCORED_DDL)


def _far(docs: DataFrame, scorer, order: int, segments: int) -> DataFrame:
    """The same without the whole filter anywhere: n-grams and their counts go to the segments once per chunk of text; each builds
    its part of the filter, asks it there, and the answers go back to the texts."""
    def count(row):
        t = Tokens(row["texts"], order)
        learns = np.array([x == "false" for x in row["carried"]])
        token = np.repeat(learns, t.size)
        counts = [np.bincount(i[token], minlength=len(k)) for i, k in zip(t.ids, t.keys)]
        keys = t.all_keys()
        counts = np.concatenate([*counts, np.full(len(keys), learns.sum())])[:len(keys)]
        sort = np.argsort(keys)
        keys, counts = keys[sort], counts[sort]
        yield from exchange.ask(row, ((s, [exchange.planes(keys[a:b], 8), exchange.planes(counts[a:b], 4)])
                                      for s, a, b in logbloom.slices(keys, segments)))

    def tell(bodies):
        keys = np.concatenate([exchange.from_planes(b[0], 8) for b in bodies])
        counts = np.concatenate([exchange.from_planes(b[1], 4) for b in bodies]).astype(np.int64)
        sort = np.argsort(keys)
        ordered = keys[sort]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = np.flatnonzero(new)
        times, ordered = np.add.reduceat(counts[sort], first), ordered[first]
        seen = times > 0
        parts = [(int(logbloom.segment_of(ordered[:1], segments)[0]), logbloom.build(ordered[seen], times[seen]))] if seen.any() else []
        codes = np.empty(len(keys), np.uint8)
        codes[sort] = logbloom.Filter(segments, parts).ask(ordered)[np.cumsum(new) - 1]
        return [x.tobytes() for x in np.split(codes, np.cumsum([len(b[0]) // 8 for b in bodies])[:-1])]

    def finish(row):
        own = scorer.value
        chunk = own.prepare(row["ids"], [x == "true" for x in row["carried"]], row["texts"])
        yield own.finish(chunk, np.frombuffer(b"".join(row["answer"]), np.uint8))

    chunks = Chunks(docs, 2 * CHUNK_BYTES, "id", "text", F.col("held_out").cast("string"))
    with small_batches(docs.sparkSession):
        codes = exchange.answered(chunks.map(chunks.table, count, exchange.ASK_DDL), tell, "codes")
    return chunks.map(chunks.with_answers(codes), finish, SCORED_DDL)


def score_documents(docs: DataFrame, held_out: Column, order: int = 2, strength: float = STRENGTH,
                    id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose ``held_out`` is not true and scores all. Tokens are the words between ASCII white
    space, A-Z lower-cased, then one end; a null or empty text is its end alone. ``base_score`` uses the exact counts of
    all training tokens, ``score`` is the model's log10 probability. Repeated rows count as often as they come; with
    nothing to learn from, all counts are 0. Texts are scored whole; null ids stay null; other columns are left out.
    """
    texts = keyed_text(docs, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False)))
    training = texts.filter(~F.col("held_out")).select("text")
    counts = materialize(sums.word_counts(training, fold=True, with_end=True), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    segments = max(1, -(-total * order // SEGMENT_KEYS))
    context = docs.sparkSession.sparkContext
    scorer = context.broadcast(Scorer(order, strength, sums.head_of(counts, "n"), total, distinct))
    # An n-gram is stored at most as often as it occurs, so before any is counted it is known which filters are small.
    if total * order * logbloom.BITS_PER_ENTRY // 8 <= broadcast_bytes:
        with small_batches(docs.sparkSession, BATCH_BYTES):
            rows = materialize(gram_filter(training, order, segments), "filter").toArrow()
        held = [(s.as_py(), bits.as_buffer()) for s, bits in zip(rows.column("segment"), rows.column("bits"))]
        shared = context.broadcast(logbloom.Filter(segments, held))
        del rows, held
        scored = _near(texts, scorer, shared)
    else:
        shared, scored = None, _far(texts, scorer, order, segments)
    with small_batches(docs.sparkSession, BATCH_BYTES):
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    for sent in (scorer, shared):
        if sent is not None:
            sent.unpersist()  # nothing behind the stored scores reads it
    n = F.col("n")
    times = F.coalesce(F.col("c"), F.lit(0))
    full = sums.tail_sums(scored, counts.select("word", F.col("n").alias("c")),
                          tail_known=F.when(times > 0, n).otherwise(0), tail_base=n * F.log10(times + 0.5))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        "score")
