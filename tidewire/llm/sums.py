"""Sums over a document's words of a value from a table of all words.

The most frequent words of the corpus, a fixed number of them, are looked up where the text is read. The rest
of a document's words leave as (word, times) and meet the table in a join; no word there is frequent.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, text_chunks

#: Words looked up in place, and the longest of them in bytes: 16 MB at most with their values.
HEAD, HEAD_BYTES = 200_000, 64
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
TAIL = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
TAIL_DDL = "tail array<struct<word: binary, n: long>>"


def word_counts(texts: DataFrame, fold: bool, with_end: bool) -> DataFrame:
    """(word, n) over all texts; the end of a text is the word of no bytes."""
    def run(batches):
        count: Counter = Counter()
        for _, own in text_chunks(batches):
            for t in own:
                count.update((t.lower() if fold else t).split())
            if with_end:
                count[b""] += len(own)
            if len(count) > HELD:
                yield batch_of(COUNTS, word=list(count), n=list(count.values()))
                count.clear()
        if count:
            yield batch_of(COUNTS, word=list(count), n=list(count.values()))

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, *values: str) -> dict[bytes, tuple]:
    """The most frequent words with their values; the end of text is always among them."""
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    rows = short.orderBy((F.length("word") == 0).desc(), F.col("n").desc(), "word").limit(HEAD).select("word", *values).toArrow()
    return dict(zip((bytes(w) for w in rows.column("word").to_pylist()),
                    zip(*(rows.column(v).to_pylist() for v in values))))


def tails(doc: np.ndarray, word: np.ndarray, words: list[bytes], n_docs: int) -> pa.Array:
    """Per document the words with their times, from parallel arrays of occurrences."""
    pair, times = np.unique(doc.astype(np.int64) << 32 | word, return_counts=True)
    ends = np.searchsorted(pair >> 32, np.arange(n_docs + 1))
    column = pa.array(words, pa.binary()).take(pa.array(pair & 0xFFFFFFFF))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [column, pa.array(times, pa.int64())], ["word", "n"]))


def tail_sums(rows: DataFrame, table: DataFrame, **sums: Column) -> DataFrame:
    """``rows`` (with a key ``row`` and ``tail``) joined with the sums over their tail words.

    ``sums`` are expressions over n (times in the document) and the columns of ``table``, which is null for
    words that it does not have. A row without tail words gets 0.
    """
    parts = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("n"))
    found = parts.join(table, "word", "left").groupBy("row").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return rows.drop("tail").join(found, "row", "left").fillna(0, list(sums))
