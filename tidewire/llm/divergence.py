"""How far the sources of a language lie apart in their use of terms, with every distinct text read once.

Identical texts of a language are one text with a multiplicity per source: digests travel, texts stay in the chunk table, and
the first place of a text is the only one where it is cut into terms. Its counts go to each of its sources, weighted.

A pair of sources is never compared term by term. A term that a source lacks has the same probability as every other such
term, so a pair is that floor for all kept terms, plus a correction for each distinct count of either source, plus one
for each term that both have. The last part is summed inside tasks for blocks of sources.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import CHUNK_BYTES, batch_of, col, ragged
from .exchange import Chunks

#: Documents of a language that a kept term is in at least, and terms listed per source.
LEAST_DOCUMENTS, TERMS = 10, 10
#: Sources of a block: a task holds the sums of two blocks, this many squared.
BLOCK = 128
#: Counts that a task holds before it passes them on, and pairs that it looks at together.
HELD, PAIRS = 400_000, 1 << 19

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COPIES = pa.schema([("lang", pa.string()), ("digest", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("at", pa.int64())])
CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.int64())])
SUMS_DDL = "lang string, a long, b long, v long"


def _collapsed(chunks: Chunks) -> DataFrame:
    """lang, digest, source, n (rows with this text), at (first place of the text in the chunk table, as one number)."""
    def run(row):
        count, first = Counter(), {}
        for i, (text, carried) in enumerate(zip(row["texts"], row["carried"])):
            lang, source = json.loads(carried)
            digest = md5(text).digest()
            count[lang, digest, source] += 1
            first.setdefault((lang, digest), i)
        at = row["part"] << 40 | row["chunk"] << 20
        yield batch_of(COPIES, lang=[k[0] for k in count], digest=[k[1] for k in count], source=[k[2] for k in count],
                       n=list(count.values()), at=[at | first[k[:2]] for k in count])

    rows = chunks.map(chunks.table, run, "lang string, digest binary, source string, n long, at long")
    return rows.groupBy("lang", "digest", "source").agg(F.sum("n").alias("n"), F.min("at").alias("at"))


def _tally(rows: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts of each distinct text, times its rows in each source."""
    def batch(held):
        for (lang, source), (count, docs) in held.items():
            yield batch_of(CELLS, lang=[lang] * len(count), source=[source] * len(count),
                           term=[t.decode(errors="replace") for t in count], n=list(count.values()), docs=[docs[t] for t in count])

    most = HELD

    def run(batches):
        held = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for rows in batches:
            for r in range(rows.num_rows):
                row = rows.slice(r, 1).to_pylist()[0]
                for raw in row["answer"] or ():
                    place, weights = json.loads(raw)
                    lang = json.loads(row["carried"][place])[0]
                    terms = row["texts"][place].translate(_FOLD).split()
                    own = Counter(terms) if len(weights) > 1 or weights[0]["n"] > 1 else None
                    for w in weights:
                        count, docs = held[lang, w["source"]]
                        size -= len(count)
                        if own is None:
                            count.update(terms)
                            docs.update(set(terms))
                        else:
                            for t, n in own.items():
                                count[t] += n * w["n"]
                                docs[t] += w["n"]
                        size += len(count)
                        if size > most:
                            yield from batch(held)
                            held.clear()
                            size = 0
        yield from batch(held)

    cells = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str) -> Column:
    """Smoothed probability in billionths, rounded up to a whole number above zero."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} + 2 * v as decimal(20, 0))")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _joint(block: int, most: int):
    """Corrections of pairs of sources for the terms that both have. A row is a term with its sources of two blocks, by number;
    rows come sorted by language and blocks, so the sums of one pair of blocks are held at a time."""
    def add(sums, mixed, number, p, p0, last):
        at, ends = 0, np.cumsum(last - np.arange(len(last)) - 1)
        while at < len(last):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            j, i = ragged(np.arange(at, to) + 1, last[at:to])
            i = i + at
            if mixed:  # the pairs inside a block are seen to where it meets itself
                ok = number[i] // block != number[j] // block
                i, j = i[ok], j[ok]
            v = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
            keys, of = np.unique(number[i] << 32 | number[j], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, of, v)
            for k, x in zip(keys.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + x
            at = to

    def close(lang, sums):
        keys = np.fromiter(sums, np.int64, len(sums))
        return batch_of(SUMS, lang=[lang] * len(keys), a=keys >> 32, b=keys & 0xFFFFFFFF, v=list(sums.values()))

    def run(batches):
        now, sums = None, {}
        for batch in batches:
            bounds = batch.column("cells").offsets.to_numpy()
            bounds = bounds - bounds[0]
            cells = batch.column("cells").flatten()
            number, p, p0 = (cells.field(c).to_numpy() for c in ("number", "p", "p0"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "lo", "hi"))))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if now is not None and keys[a] != now:
                    yield close(now[0], sums)
                    sums = {}
                now = keys[a]
                x, y = bounds[a], bounds[b]
                last = np.repeat(bounds[a + 1:b + 1] - x, np.diff(bounds[a:b + 1]))
                add(sums, now[1] != now[2], number[x:y], p[x:y], p0[x:y], last)
        if sums:
            yield close(now[0], sums)

    return run


def _alone(batches):
    """Corrections of pairs for the distinct counts of one source, against sources that lack the term."""
    for batch in batches:
        sums: dict = {}
        for r in batch.to_pylist():
            number = np.array([x["number"] for x in r["others"]])
            p0 = np.array([x["p0"] for x in r["others"]])
            v = r["terms"] * (_f(np.int64(r["p"]), p0) - _f(np.int64(r["p0"]), p0))
            key = r["lang"], r["number"], r["other"]
            sums[key] = number, sums[key][1] + v if key in sums else v
        if sums:
            yield batch_of(SUMS, lang=[k[0] for k, (n, _) in sums.items() for _ in n], a=[k[1] for k, (n, _) in sums.items() for _ in n],
                           b=np.concatenate([n for n, _ in sums.values()]), v=np.concatenate([v for _, v in sums.values()]))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    Null text, language and source are empty strings, and equal rows count as often as they occur. A table without rows has no
    groups and gives no rows; a language without kept terms has pairs of value 0 and no terms; a source alone in its language has
    no pairs. Ties go to the item that is smaller in UTF-8. Texts are the same if their MD5 is. Sources of one language must be
    few enough for all their pairs to be a result.
    """
    empty = F.lit("")
    carry = F.to_json(F.array(F.coalesce(col(lang_col).cast("string"), empty), F.coalesce(col(source_col).cast("string"), empty)))
    chunks = Chunks(docs, CHUNK_BYTES, id_col, text_col, carry)
    copies = materialize(_collapsed(chunks), "copies")
    texts = copies.groupBy("lang", "digest").agg(F.min("at").alias("at"), F.collect_list(F.struct("source", "n")).alias("weights"))
    place = F.col("at").bitwiseAND(F.lit((1 << 20) - 1))
    answers = texts.select(
        F.shiftright("at", 40).alias("part"), F.shiftright("at", 20).bitwiseAND(F.lit((1 << 20) - 1)).alias("chunk"), place.alias("shard"),
        F.concat(F.lit("["), place.cast("string"), F.lit(","), F.to_json("weights"), F.lit("]")).cast("binary").alias("answer"))
    cells = materialize(_tally(chunks.with_answers(answers)), "cells")

    terms = materialize(cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(
        F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "terms")
    kept = materialize(cells.drop("docs").join(terms, ["lang", "term"]), "kept")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    by_lang = Window.partitionBy("lang")
    sources = copies.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(
        0, ["v", "n_lang", "n_source"])
    sources = sources.withColumn("number", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1).withColumn(
        "blocks", F.ceil(F.count("*").over(by_lang) / BLOCK).cast("long"))
    sources = materialize(sources.withColumn("p0", F.when(F.col("v") > 0, _p("0", "n_source"))), "sources")

    scored = materialize(kept.join(sources, ["lang", "source"]).withColumn("p", _p("n", "n_source")).withColumn("q", _p("total", "n_lang")).select(
        "lang", "term", "source", "number", "blocks", "n", "p", "p0", "q"), "scored")
    by_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    high = high.withColumn("rank", F.row_number().over(by_source)).filter(F.col("rank") <= TERMS)

    block = F.expr(f"number div {BLOCK}")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = scored.repartition("lang", "term").withColumn("block", block).withColumn("other", others)
    met = met.groupBy("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "term").agg(
        F.sort_array(F.collect_list(F.struct("number", "p", "p0"))).alias("cells")).filter(F.size("cells") > 1)
    both = met.drop("term").sortWithinPartitions("lang", "lo", "hi").mapInArrow(_joint(BLOCK, PAIRS), SUMS_DDL)
    floors = sources.filter("v > 0").groupBy("lang", block.alias("other")).agg(F.collect_list(F.struct("number", "p0")).alias("others"))
    alone = scored.groupBy("lang", "number", "blocks", "p", "p0").agg(F.count("*").alias("terms")).withColumn("other", others)
    alone = alone.join(floors, ["lang", "other"]).mapInArrow(_alone, SUMS_DDL)
    sums = both.union(alone).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    sums = materialize(sums, "sums")
    sums = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")).groupBy("lang", "a", "b").agg(F.sum("v").alias("more"))

    left = sources.select("lang", "source", F.col("number").alias("a"), "v", F.col("p0").alias("p"))
    right = sources.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("p0").alias("q"))
    pairs = left.join(right, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") == 0, 0).otherwise(F.col("v") * _apart("p", "q") + F.coalesce("more", F.lit(0))).cast("long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by_source)).unionByName(high)
