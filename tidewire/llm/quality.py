"""Text quality by the perplexity of an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

All counting is by key: an n-gram of bytes is a number, its context is that number without the last byte, and what
it backs off to is the number without the first. Probabilities of the distinct n-grams of the corpus come from joins of
those numbers with the counts of each order; texts then add up the logarithms. A text is kept if its perplexity is not
above the quantile that its language's trusted texts give, each under a model that has not counted it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import exchange, logbloom
from .common import batch_of, col, keyed_text, mix, text_chunks
from .exchange import Chunks

ORDER = 5
#: Parts of the trusted texts; for its threshold, a text is scored by the model of the other parts. Equal texts share one.
FOLDS = 2
#: Byte after the last of a text; the bytes before its first count as 0.
END = 3
#: Probability tables up to this size are broadcast; beyond it the n-grams go to the table.
BROADCAST_BYTES, CHUNK, SHARD = 64 << 20, 2 << 20, 64 << 20
#: What a broadcast mark of a trusted text takes, about.
MARK_BYTES = 32
#: Steps of the logarithm of perplexities, for exact quantiles from counts.
STEPS = 10_000
SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_bytes", pa.int64()), ("log_prob", pa.float64())])
SCORED_DDL = "doc_id long, lang string, trusted boolean, n_bytes long, log_prob double"


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text and at its end, as numbers; and where each text's begin."""
    lead = bytes(order - 1)
    data = np.frombuffer(b"".join(lead + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    key = np.zeros(len(data) - order + 1, np.int64)
    for i in range(order):
        key |= data[i:i + len(key)] << np.int64(8 * (order - 1 - i))
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size + order - 1) - (size + order - 1)
    inside = np.ones(len(key), bool)
    for i in range(1, order):
        inside[(begin[1:] - i)] = False
    return key[inside], np.cumsum(size) - size


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(key, n) of all texts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, own in text_chunks(batches, CHUNK):
            key, n = np.unique(grams(own, order)[0], return_counts=True)
            yield batch_of(schema, key=key, n=n)

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _low(name: str, n: int):
    """The last n bytes of an n-gram's number."""
    return F.col(name).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _discounts(table: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more, by Chen and Goodman's estimate."""
    n = table.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]


def probabilities(events: DataFrame, top: DataFrame, order: int) -> DataFrame:
    """(key, p) for the n-grams ``events`` (key), from the trusted counts ``top`` (key, n) of the highest order.

    Lower orders count in how many different contexts an n-gram ends. An n-gram whose context was never seen has the
    probability that it has without the context's first byte; at the bottom all 256 bytes are alike.
    """
    tables = {order: top}
    for n in range(order - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy(_low("key", n).alias("key")).agg(F.count("*").alias("n"))
    p = None
    for n in range(1, order + 1):
        table = materialize(tables[n], f"order{n}")
        off = _discounts(table)
        discount = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        context = table.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.sum(discount).alias("mass"))
        own = events.select(_low("key", n).alias("key")).distinct() if n < order else events.select("key")
        own = own.withColumn("context", F.shiftright("key", 8)).withColumn("rest", _low("key", n - 1))
        own = own.join(table.select("key", (F.col("n") - discount).alias("left")), "key", "left").join(context, "context", "left")
        own = own.join(p.select(F.col("key").alias("rest"), F.col("p").alias("lower")), "rest") if p is not None else own.withColumn(
            "lower", F.lit(1 / 256))
        blend = (F.coalesce("left", F.lit(0.0)) + F.col("mass") * F.col("lower")) / F.col("total")
        p = materialize(own.select("key", F.coalesce(blend, "lower").alias("p")), f"p{n}")
    return p


def _scored(rows: pa.RecordBatch, begin: np.ndarray, size: list[int], log_p: np.ndarray) -> pa.RecordBatch:
    return batch_of(SCORED, doc_id=rows.column("id"), lang=rows.column("lang"), trusted=rows.column("trusted"),
                    n_bytes=size, log_prob=np.add.reduceat(log_p, begin))


def _near(texts: DataFrame, table: DataFrame, order: int) -> DataFrame:
    rows = table.orderBy("key").toArrow()
    shared = texts.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy(), np.log10(rows.column("p").to_numpy())))

    def run(batches):
        known, log_p = shared.value
        for rows, own in text_chunks(batches, CHUNK):
            key, begin = grams(own, order)
            distinct, at = np.unique(key, return_inverse=True)
            yield _scored(rows, begin, [len(t) for t in own], log_p[np.searchsorted(known, distinct)][at])

    return texts.mapInArrow(run, SCORED_DDL)


def _far(texts: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """The same with the table in shards: n-grams go there, probabilities come back."""
    tagged = texts.withColumn("text", F.concat(F.to_json(F.struct("lang", "trusted")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    chunks = Chunks(tagged, CHUNK, "id", "text")
    shards = chunks.shards(SHARD)
    held_schema = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("p", pa.float64())])

    def place(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            yield batch_of(held_schema, shard=logbloom.segment_of(mix(key.view(np.uint64)), shards), key=key, p=batch.column("p"))

    def parts(row):
        heads, own = zip(*(t.split(b"\n", 1) for t in row["texts"]))
        key, begin = grams(list(own), order)
        distinct, at = np.unique(key, return_inverse=True)
        hashed = mix(distinct.view(np.uint64))
        turn = np.argsort(hashed)
        return heads, own, begin, distinct[turn], hashed[turn], np.argsort(turn)[at]

    def ask(row):
        _, _, _, key, hashed, _ = parts(row)
        yield from exchange.ask(row, ((s, [key[i:j].tobytes()]) for s, i, j in logbloom.slices(hashed, shards)))

    def tell(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("key")
        key, log_p = held.column("key").to_numpy(), np.log10(held.column("p").to_numpy())
        answers = [log_p[np.searchsorted(key, np.frombuffer(b[0], np.int64))].tobytes() for b in asked.column("body").to_pylist()]
        return asked.drop_columns(["body"]).append_column("answer", pa.array(answers, pa.binary()))

    def score(row):
        heads, own, begin, _, _, at = parts(row)
        told = [json.loads(h) for h in heads]
        log_p = np.frombuffer(b"".join(row["answer"]), np.float64)[at]
        yield batch_of(SCORED, doc_id=row["ids"], lang=[t.get("lang") for t in told], trusted=[t["trusted"] for t in told],
                       n_bytes=[len(t) for t in own], log_prob=np.add.reduceat(log_p, begin))

    asked = chunks.map(chunks.table, ask, exchange.ASK_DDL)
    answers = asked.groupBy("shard").cogroup(table.mapInArrow(place, "shard long, key long, p double").groupBy("shard")).applyInArrow(
        tell, exchange.ANSWER_DDL)
    return chunks.map(chunks.with_answers(materialize(answers, "log_p")), score, SCORED_DDL)


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the least step of log10 perplexity that holds ``quantile`` of a language's trusted texts; the row
    with ``whole`` true is for all languages together."""
    trusted = scored.filter("trusted").select("lang", F.ceil(F.col("log_perplexity") * STEPS).alias("step"))
    both = trusted.withColumn("whole", F.lit(False)).union(trusted.select(F.lit(None).cast("string"), "step", F.lit(True)))
    counts = both.groupBy("whole", "lang", "step").agg(F.count("*").alias("n"))
    part = Window.partitionBy("whole", "lang")
    upto = F.sum("n").over(part.orderBy("step"))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(part))
    return ranked.filter(F.col("upto") >= F.col("all") * quantile).groupBy("whole", "lang").agg(
        (F.min("step") / STEPS).alias("threshold"))


def _log_perplexity(texts: DataFrame, table: DataFrame, distinct: int, order: int, broadcast_bytes: int, name: str) -> DataFrame:
    scored = (_near if distinct * 16 <= broadcast_bytes else _far)(texts, table, order)
    return materialize(scored.withColumn("log_perplexity", -F.col("log_prob") / (F.col("n_bytes") + 1)), name)


def unseen(trusted: DataFrame, order: int, broadcast_bytes: int) -> DataFrame:
    """The ``trusted`` texts, each scored by a model of the parts that it is not in."""
    fold = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % FOLDS
    parts = [trusted.filter(fold == k) for k in range(FOLDS)]
    counts = [materialize(gram_counts(own.select("text"), order), f"part{k}") for k, own in enumerate(parts)]
    out = None
    for k, own in enumerate(parts):
        rest = None
        for other in counts[:k] + counts[k + 1:]:
            rest = other if rest is None else rest.union(other)
        top = materialize(rest.groupBy("key").agg(F.sum("n").alias("n")), "rest") if FOLDS > 2 else rest
        table = probabilities(counts[k].select("key"), top, order)
        scored = _log_perplexity(own, table, counts[k].count(), order, broadcast_bytes, "unseen")
        out = scored if out is None else out.union(scored)
    return out


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, order: int = ORDER, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_bytes, perplexity (per byte, end included), threshold, keep.

    ``trusted_ids`` (one id column) names the trusted texts. Thresholds are per language; null is a language of its own, and
    a language without trusted texts takes the threshold of all. Without any trusted text the model is uniform, thresholds
    are null and all is kept. Null and empty texts are their end alone; texts are read whole; repeated rows each count.
    """
    name = trusted_ids.columns[0]
    marks = trusted_ids.select(col(name).cast("long").alias("id"), F.lit(True).alias("trusted")).filter("id IS NOT NULL").distinct()
    if marks.count() * MARK_BYTES <= broadcast_bytes:  # else the texts meet their marks by a shuffle
        marks = F.broadcast(marks)
    texts = keyed_text(docs, id_col, text_col, lang=col(lang_col).cast("string")).join(marks, "id", "left").select(
        "id", "text", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    plain = keyed_text(docs, id_col, text_col)
    top = materialize(gram_counts(texts.filter("trusted").select("text"), order), "trusted")
    events = materialize(gram_counts(plain.select("text"), order), "events")
    table = probabilities(events, top, order)
    scored = _log_perplexity(texts, table, events.count(), order, broadcast_bytes, "perplexity")
    limits = materialize(thresholds(unseen(texts.filter("trusted"), order, broadcast_bytes), quantile), "limits")
    own = limits.filter("NOT whole").select(F.col("lang").alias("l"), "threshold")
    whole = limits.filter("whole").select(F.col("threshold").alias("general"))
    general = whole.first()
    limit = F.coalesce("threshold", F.lit(general[0] if general else None).cast("double"))
    return scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "doc_id", "lang", "n_bytes", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"),
        F.pow(F.lit(10.0), limit).alias("threshold"),
        F.coalesce(F.ceil(F.col("log_perplexity") * STEPS) / STEPS <= limit, F.lit(True)).alias("keep"))
