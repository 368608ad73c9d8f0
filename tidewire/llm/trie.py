"""The prefix trie of conversations, by vertical bitmaps.

Conversations are dealt into blocks by id and cut into bands of depth, so a shard is a bounded rectangle. In a shard every
(position, turn) has the bitset of the conversations that have this turn there. A depth-first walk intersects the bitset
of a node with those of the next turns: each result is a child, its population the members, what is left over ends here.
A node is known by its prefix, the exclusive or of hashes of (position, turn), so a shard that starts deep down needs only that of
its conversations, and the nodes of all shards are added up by it.

Sums over subtrees walk the shards once more: what a node adds is put on the path of its smallest member, summed from the end
of that path upwards, and a node then adds up its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators import ordered
from ..session import materialize
from .common import batch_of, col

#: Positions of a band and conversations of a block.
BAND, BLOCK = 64, 2048
#: Nodes of an answer.
ROWS = 1 << 15
START, TURN, MARK, LATER = range(4)
SHARD = ("block", "band", "kind", "conv", "pos", "a", "b", "w")
PARTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()),
                   ("first", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("block", pa.int64()), ("ends", pa.string())])
PARTS_DDL = "k1 long, k2 long, p1 long, p2 long, depth long, first long, n long, words long, block long, ends string"
SUMS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64())])
ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])


class Shard:
    """The conversations of a block in one band. ``rows``: the columns of ``SHARD``, sorted by kind, conversation, position."""

    def __init__(self, rows: dict[str, np.ndarray], width: int):
        self.width, kind = width, rows["kind"]
        part = {k: {c: rows[c][kind == k] for c in ("conv", "pos", "a", "b", "w")} for k in (START, TURN, MARK, LATER)}
        self.block, self.band = int(rows["block"][0]), int(rows["band"][0])
        self.convs, self.length = part[START]["conv"], part[START]["pos"]
        self.start = list(zip(part[START]["a"].tolist(), part[START]["b"].tolist()))
        turns = part[TURN]
        depth = turns["pos"] - self.band * width - 1
        where = np.searchsorted(self.convs, turns["conv"])
        order = np.lexsort((where, turns["b"], turns["a"], depth))
        same = np.ones(len(order), bool)
        columns = [x[order] for x in (depth, turns["a"], turns["b"])]
        same[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
        number = np.cumsum(same) - 1
        #: Which turn each conversation has at each depth of the band, -1 for none.
        self.turn = np.full((len(self.convs), width), -1, np.int64)
        self.turn[where[order], depth[order]] = number
        firsts = np.flatnonzero(same)
        self.a, self.b, self.words = columns[1][firsts].tolist(), columns[2][firsts].tolist(), turns["w"][order][firsts].tolist()
        self.postings = [self._bits(x) for x in np.split(where[order], firsts[1:])] if len(order) else []
        self.marks, self.later = part[MARK], part[LATER]

    @staticmethod
    def _bits(members: np.ndarray) -> int:
        if len(members) == 1:
            return 1 << int(members[0])
        flags = np.zeros(int(members.max()) + 1, bool)
        flags[members] = True
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    @staticmethod
    def members(bits: int) -> np.ndarray:
        if bits & (bits - 1) == 0:
            return np.array([bits.bit_length() - 1])
        raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def walk(self) -> Iterator[tuple]:
        """(bits, key, parent's key, depth in the band, words, members that end here) of every node, parents first."""
        roots: dict[tuple[int, int], int] = {}
        for i, key in enumerate(self.start):
            roots[key] = roots.get(key, 0) | 1 << i
        top = self.band * self.width
        stack = [(bits, key, None, 0, 0) for key, bits in roots.items()]
        while stack:
            bits, key, parent, depth, words = stack.pop()
            rest, ends = bits, []
            if depth == self.width:
                ends = [i for i in self.members(bits).tolist() if self.length[i] == top + depth]
                rest = 0
            while rest:
                i = (rest & -rest).bit_length() - 1
                t = int(self.turn[i, depth])
                if t < 0:
                    ends.append(i)
                    rest &= rest - 1
                else:
                    child = bits & self.postings[t]
                    rest &= ~child
                    stack.append((child, (key[0] ^ self.a[t], key[1] ^ self.b[t]), key, depth + 1, self.words[t]))
            if depth or not self.band:  # the start of a deeper band is a node of the band above
                yield bits, key, parent, depth, words, ends

    def parts(self) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for bits, key, parent, depth, words, ends in self.walk():
            first = int(self.convs[(bits & -bits).bit_length() - 1])
            held.append((*key, *(parent or (None, None)), self.band * self.width + depth, first, bits.bit_count(), words, self.block,
                         ",".join(map(str, self.convs[ends].tolist())) if ends else None))
            if len(held) == ROWS:
                yield batch_of(PARTS, **dict(zip(PARTS.names, zip(*held))))
                held = []
        if held:
            yield batch_of(PARTS, **dict(zip(PARTS.names, zip(*held))))

    def sums(self) -> Iterator[pa.RecordBatch]:
        below = np.zeros((2, len(self.convs), self.width + 1), np.int64)
        for some, at in ((self.marks, self.marks["pos"] - self.band * self.width), (self.later, np.full(len(self.later["conv"]), self.width))):
            where = np.searchsorted(self.convs, some["conv"])
            np.add.at(below[0], (where, at), some["a"])
            np.add.at(below[1], (where, at), some["b"])
        below = below[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
        held = []
        for bits, key, _, depth, _, _ in self.walk():
            own = below[:, self.members(bits), depth].sum(axis=1)
            held.append((*key, int(own[0]), int(own[1])))
        for at in range(0, len(held), ROWS):
            yield batch_of(SUMS, **dict(zip(SUMS.names, zip(*held[at:at + ROWS]))))


def _shards(what: str, width: int):
    """``Shard.parts`` or ``Shard.sums`` over rows that come sorted by shard."""
    def run(batches):
        held: list[dict] = []

        def done():
            yield from getattr(Shard({c: np.concatenate([x[c] for x in held]) for c in SHARD}, width), what)()

        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in SHARD}
            edges = np.flatnonzero((np.diff(own["block"]) != 0) | (np.diff(own["band"]) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if held and (held[0]["block"][0], held[0]["band"][0]) != (own["block"][a], own["band"][a]):
                    yield from done()
                    held = []
                held.append({c: x[a:b] for c, x in own.items()})
        if held:
            yield from done()

    return run


def _hashed(batches):
    """SHA-256 of the end lists of each node. Pieces come sorted by node and block and pass one at a time."""
    now, state = None, None
    for batch in batches:
        out = []
        for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
            if (k1, k2) == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (k1, k2), sha256()
            state.update(piece.encode())
        if out:
            yield batch_of(ENDS, **dict(zip(ENDS.names, zip(*out))))
    if now is not None:
        yield batch_of(ENDS, k1=[now[0]], k2=[now[1]], sha=[state.hexdigest()])


def _sharded(rows: DataFrame) -> DataFrame:
    return rows.select(*SHARD).repartition("block", "band").sortWithinPartitions("block", "band", "kind", "conv", "pos")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv, len, block of every conversation, and conv, pos, len, block, digest, words of its rebuilt turns."""
    text, role = (F.coalesce(col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(
        col("conv_id").cast("long").alias("conv"), col("turn").alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter("conv IS NOT NULL")
    own = ordered.running(rows, ["conv"], ["turn", "role", "digest"], {"p": ("count", F.lit(1))}).select("conv", "p", "digest", "words")
    own = materialize(own, "turns")
    sizes = own.groupBy("conv").agg(F.count("*").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % 20).withColumn(
        "h", F.crc32(F.col("conv").cast("string")) % 4)
    bases = sizes.filter("conv % 20 = 0").select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    sizes = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    sizes = sizes.withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).withColumn("g", F.lit(0))
    sizes = ordered.running(sizes.select("conv", "base", "h", "taken", "len", "g"), ["g"], ["conv"], {"number": ("count", F.lit(1))})
    sizes = materialize(sizes.withColumn("block", F.expr(f"(number - 1) div {BLOCK}")).drop("number", "g"), "conversations")
    tail = own.join(sizes, "conv").filter("p > h").withColumn("pos", F.col("p") - F.col("h") + F.col("taken"))
    heads = own.filter("conv % 20 = 0 AND p <= 3").select(F.col("conv").alias("base"), F.col("p").alias("pos"), "digest", "words")
    head = sizes.filter("taken > 0").join(heads, "base").filter("pos <= taken")
    names = ["conv", "pos", "len", "block", "digest", "words"]
    return sizes.select("conv", "len", "block"), tail.select(*names).unionByName(head.select(*names))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation are in the order of turn (null first), then role, then the MD5 of role and text; equal rows are turns of
    their own. Null role or text is empty. Rows without conv_id belong to no conversation. A table without conversations
    has no nodes, not even a root. Turns are the same if MD5 is, prefixes if two 64-bit hashes are.
    """
    convs, turns = rebuilt(conversations)
    turns = materialize(turns.select(
        "block", F.expr(f"(pos - 1) div {BAND}").alias("band"), F.lit(TURN).alias("kind"), "conv", "pos", F.xxhash64("digest", "pos").alias("a"),
        F.xxhash64("pos", "digest").alias("b"), F.col("words").alias("w"), "len"), "rebuilt")
    zero = F.lit(0).cast("long")
    bands = turns.filter(f"len > {BAND}").groupBy("block", "band", "conv", "len").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    deep = bands.select("block", "band", "conv", "len", *[F.bit_xor(x).over(before).alias(x) for x in "ab"]).filter("band > 0")
    tops = convs.select("block", zero.alias("band"), "conv", "len", zero.alias("a"), zero.alias("b"))
    starts = tops.unionByName(deep).select("block", "band", F.lit(START).alias("kind"), "conv", F.col("len").alias("pos"), "a", "b", zero.alias("w"))
    starts = materialize(starts, "starts")
    base = starts.unionByName(turns.drop("len"))
    parts = materialize(_sharded(base).mapInArrow(_shards("parts", BAND), PARTS_DDL), "parts")

    key = ["k1", "k2"]
    nodes = materialize(parts.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), *[F.max(c).alias(c) for c in ("depth", "p1", "p2", "words")]), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    nodes = materialize(nodes.join(kids, key, "left").fillna(0, ["children"]), "nodes")

    marks = nodes.select(F.col("first").alias("conv"), F.col("depth").alias("pos"), ((F.col("n") - 1) * F.col("words")).alias("a"),
                         (F.col("children") == 0).cast("long").alias("b")).filter("a > 0 OR b > 0")
    marks = marks.join(convs, "conv").withColumn("band", F.greatest(F.expr(f"(pos - 1) div {BAND}"), zero))
    marks = materialize(marks.select("block", "band", F.lit(MARK).alias("kind"), "conv", "pos", "a", "b", zero.alias("w"), "len"), "marks")
    sums = marks.filter(f"len > {BAND}").groupBy("conv", "band").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    after = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    later = bands.select("block", "band", "conv").join(sums, ["conv", "band"], "left").select(
        "block", "band", F.lit(LATER).alias("kind"), "conv", zero.alias("pos"), *[F.coalesce(F.sum(x).over(after), zero).alias(x) for x in "ab"], zero.alias("w"))
    below = _sharded(base.unionByName(marks.drop("len")).unionByName(later)).mapInArrow(
        _shards("sums", BAND), "k1 long, k2 long, saved long, leaves long")
    below = below.groupBy(*key).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    pieces = parts.filter("ends IS NOT NULL").select(*key, "block", "ends").repartition(*key).sortWithinPartitions(*key, "block")
    ends = pieces.drop("block").mapInArrow(_hashed, "k1 long, k2 long, sha string")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first").alias("parent"))
    out = nodes.join(below, key).join(ends, key, "left").join(above, ["p1", "p2"], "left")
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(sha256().hexdigest())).alias("ends_sha256"))
