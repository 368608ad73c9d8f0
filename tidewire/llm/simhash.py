"""SimHash near duplicates: fingerprints, and all that differ in few bits, by the generalised pigeonhole.

The 64 bits are dealt into ``m`` partitions, correlated bits together. If the thresholds t of the partitions
add up to ``distance - m + 1``, two fingerprints within ``distance`` agree up to t bits in at least one
partition, for any such thresholds (-1: the partition is not looked at). So each fingerprint picks its own, by
dynamic programming over estimated candidate counts, probes those keys, and every candidate is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..operators.cluster import components
from ..session import materialize
from .common import batch_of, keyed_text, mix, ragged, text_chunks

BITS = 64
#: Bits of a value in a count table: 65,536 entries at most.
TABLE_BITS = 16
#: Largest threshold of one partition; 2 needs up to 1 + w + w(w-1)/2 probes.
MOST = 2
#: Fingerprints of a bucket that one task holds; larger buckets are dealt into blocks, each pair of blocks a group.
BLOCK = 4096
#: What a probe costs, in verified candidates.
PROBE_COST = 20.0
#: Shingles, or candidate pairs, looked at together.
SLICE = 1 << 18

FPS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _shingles(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1:].tolist())]


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (64 bits as a long).

    Words end at ASCII white space, A-Z lower-cased. A bit is set if it is set in over half of the XXH64 hashes
    (seed 42) of the ``width``-word shingles, repeats included; fewer words are one shingle. Null and empty
    texts have the fingerprint zero. Long texts are voted on in slices.
    """
    def run(batches):
        for rows, texts in text_chunks(batches):
            hashes = [np.array(_shingles(t, width), np.uint64) for t in texts]
            size = np.array([len(h) for h in hashes])
            every, of = np.concatenate(hashes), np.repeat(np.arange(len(texts)), size)
            votes = np.zeros((len(texts), BITS), np.int64)
            for a in range(0, len(every), SLICE):
                bits = np.unpackbits(every[a:a + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                own, first = np.unique(of[a:a + SLICE], return_index=True)
                votes[own] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            fp = np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
            yield batch_of(FPS, doc_id=rows.column("id"), fp=fp)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def deal_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, correlated bits in the same one. ``together``: counts of two bits both set."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = -(-len(free) // (m - k))
        left = sorted(free)
        part = [left[int(tie[np.ix_(left, left)].sum(axis=1).argmax())]]
        free.remove(part[0])
        while len(part) < width:
            left = sorted(free)
            part.append(left[int(tie[np.ix_(left, part)].sum(axis=1).argmax())])
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def gather_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed together."""
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(bits):
        out |= (fp >> np.int64(b) & 1) << np.int64(i)
    return out


class Plan:
    """Partitions and count tables; which keys a fingerprint is stored under and which it probes."""

    def __init__(self, n: int, parts: list[list[int]], tables: list[list[np.ndarray]], distance: int):
        self.n, self.parts, self.distance = n, parts, distance
        self.cuts = [[p[i:i + TABLE_BITS] for i in range(0, len(p), TABLE_BITS)] for p in parts]
        self.tables = tables
        self.near = [[self._near(t, len(c)) for t, c in zip(ts, cs)] for ts, cs in zip(tables, self.cuts)]
        self.flips = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), k)], np.int64)
                       for k in range(MOST + 1)] for p in parts]

    @staticmethod
    def _near(table: np.ndarray, bits: int) -> np.ndarray:
        """How many fingerprints are 0, 1, .. MOST bits away, for each value of a table."""
        values = np.arange(len(table))
        return np.stack([sum(table[values ^ sum(1 << b for b in c)] for c in combinations(range(bits), k))
                         if k <= bits else np.zeros(len(table)) for k in range(MOST + 1)], 1).astype(float)

    def _within(self, k: int, fp: np.ndarray) -> np.ndarray:
        """Estimated fingerprints within 0 .. MOST bits in partition k; exact for a partition of one table."""
        at = None
        for cut, near in zip(self.cuts[k], self.near[k]):
            own = near[gather_bits(fp, cut)]
            at = own if at is None else np.stack(
                [sum(at[:, i] * own[:, t - i] for i in range(t + 1)) for t in range(MOST + 1)], 1) / self.n
        return np.cumsum(at, axis=1)

    def size_of(self, k: int, keys: np.ndarray) -> np.ndarray:
        """At least how many fingerprints have each key of partition k; exact for a partition of one table."""
        return np.min([t[keys >> (TABLE_BITS * i) & ((1 << len(c)) - 1)] for i, (c, t) in enumerate(
            zip(self.cuts[k], self.tables[k]))], axis=0)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, one per partition."""
        m, total = len(self.parts), self.distance - len(self.parts) + 1
        cost = {0: np.zeros(len(fp))}  # by the sum of the thresholds so far, counted from -1 each
        choice: list[dict[int, np.ndarray]] = []
        for k in range(m):
            within, probes, new, picked = self._within(k, fp), 0, {}, {}
            for t in range(-1, min(MOST, len(self.parts[k])) + 1):
                probes += len(self.flips[k][t]) if t >= 0 else 0
                own = np.zeros(len(fp)) if t < 0 else within[:, t] + PROBE_COST * probes
                for s, c in cost.items():
                    if s + t + 1 > total + m:
                        continue
                    c = c + own
                    if s + t + 1 in new:
                        better = c < new[s + t + 1]
                        new[s + t + 1] = np.where(better, c, new[s + t + 1])
                        picked[s + t + 1] = np.where(better, t, picked[s + t + 1])
                    else:
                        new[s + t + 1], picked[s + t + 1] = c, np.full(len(fp), t)
            cost = new
            choice.append(picked)
        out, s = np.zeros((len(fp), m), np.int64), np.full(len(fp), total + m)
        for k in range(m - 1, -1, -1):
            for at, t in choice[k].items():
                out[s == at, k] = t[s == at]
            s = s - out[:, k] - 1
        return out

    def rows(self, fp: np.ndarray):
        """(partition, key, block pair, role, fp) rows; role 0: stored, 1: stored and probing, 2: probing."""
        thresholds = self.thresholds(fp)
        lot = mix(fp.view(np.uint64))
        for k, part in enumerate(self.parts):
            own, t = gather_bits(fp, part), thresholds[:, k]
            yield from self._dealt(k, own, fp, lot, np.where(t >= 0, 1, 0))
            for j in range(1, MOST + 1):
                who = np.flatnonzero(t >= j)
                for flip in self.flips[k][j]:
                    keys = own[who] ^ flip
                    some = self.size_of(k, keys) > 0
                    yield from self._dealt(k, keys[some], fp[who[some]], lot[who[some]], np.full(int(some.sum()), 2))

    def _dealt(self, k, keys, fp, lot, role):
        """Large buckets are cut into blocks of stored and blocks of probing rows; a row goes to each pair it is in."""
        blocks = -(-self.size_of(k, keys) // BLOCK)
        small = blocks <= 1
        yield k, keys[small], np.zeros(int(small.sum()), np.int64), role[small], fp[small]
        for b in np.unique(blocks[~small]):
            at = blocks == b
            own = (lot[at] % np.uint64(b)).astype(np.int64)
            for other in range(b):
                if (stored := role[at] < 2).any():
                    yield k, keys[at][stored], (own * b + other)[stored], np.zeros(int(stored.sum()), np.int64), fp[at][stored]
                if (probing := role[at] > 0).any():
                    yield k, keys[at][probing], (other * b + own)[probing], np.full(int(probing.sum()), 2), fp[at][probing]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes as the given ones, one per node that is not the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _verify(batches, distance: int):
    """Candidates of each bucket that are within ``distance``, as a forest. Rows come sorted by bucket and role."""
    kept_a, kept_b, n = [], [], 0
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        part, key, pair, role, fp = held
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
        if batch is not None:  # the last group may go on in the next batch
            stop = int(first[-1])
            held = [x[stop:] for x in held]
            part, key, pair, role, fp, first = part[:stop], key[:stop], pair[:stop], role[:stop], fp[:stop], first[:-1]
        if not len(first):
            continue
        size = np.diff(np.append(first, len(fp)))
        stored = np.add.reduceat(role < 2, first, dtype=np.int64)
        group = np.repeat(np.arange(len(first)), size)
        probing = np.flatnonzero(role > 0)
        lo = first[group[probing]]
        hi = lo + stored[group[probing]]
        work = np.cumsum(hi - lo)
        for a, b in zip(*_slices(work)):
            at, of = ragged(lo[a:b], hi[a:b])
            x, y = fp[at], fp[probing[a:b]][of]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= distance) & (x != y)
            kept_a.append(x[near])
            kept_b.append(y[near])
            n += int(near.sum())
            if n > SLICE:
                x, y = forest(np.concatenate(kept_a), np.concatenate(kept_b))
                kept_a, kept_b, n = [x], [y], 0
    if kept_a:
        node, root = forest(np.concatenate(kept_a), np.concatenate(kept_b))
        yield batch_of(EDGES, node=node, root=root)


def _then_none(batches):
    yield from batches
    yield None


def _slices(work: np.ndarray):
    """Ranges of rows whose summed work is about SLICE, at least one row each."""
    if not len(work):
        return [], []
    cuts = np.unique(np.searchsorted(work, np.arange(SLICE, int(work[-1]) + SLICE, SLICE)) + 1)
    cuts = np.minimum(cuts, len(work))
    return np.concatenate([[0], cuts[:-1]]), cuts


def plan_for(fps: DataFrame, distance: int) -> Plan:
    """Partitions and count tables from all distinct fingerprints; sizes are bounded by the number of bits."""
    n = fps.count()
    m = min(distance + 1, max(2, round(BITS / max(np.log2(max(n, 2)), 12))))

    def pairs(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": total.ravel()})

    together = np.zeros((BITS, BITS), np.int64)
    for i, j, c in fps.select("fp").mapInArrow(pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        together[i, j] = c
    parts = deal_bits(together, n, m)
    cuts = [[p[i:i + TABLE_BITS] for i in range(0, len(p), TABLE_BITS)] for p in parts]
    tables = [[np.zeros(1 << len(c), np.int64) for c in cs] for cs in cuts]

    def values(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k, cs in enumerate(cuts):
                for i, c in enumerate(cs):
                    value, count = np.unique(gather_bits(fp, c), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"k": np.full(len(value), k), "i": np.full(len(value), i),
                                                      "value": value, "n": count})

    counted = fps.select("fp").mapInArrow(values, "k long, i long, value long, n long").groupBy("k", "i", "value").agg(
        F.sum("n").alias("n"))
    found = counted.toArrow()
    for k, i, value, c in zip(*(found.column(x).to_numpy() for x in ("k", "i", "value", "n"))):
        tables[k][i][value] = c
    return Plan(n, parts, tables, distance)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (node, root) between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``.

    Each task gives a forest of the pairs it has verified, not the pairs.
    """
    if not 0 <= distance <= 6:
        raise ValueError("distances from 0 to 6 are supported")
    plan = fps.sparkSession.sparkContext.broadcast(plan_for(fps, distance))
    schema = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("pair", pa.int64()), ("role", pa.int64()), ("fp", pa.int64())])

    def probe(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), BLOCK):
                rows = [(np.full(len(keys), k), keys, pair, role, own)
                        for k, keys, pair, role, own in plan.value.rows(fp[a:a + BLOCK]) if len(keys)]
                if rows:
                    yield batch_of(schema, **dict(zip(schema.names, (np.concatenate(x) for x in zip(*rows)))))

    rows = fps.select("fp").mapInArrow(probe, "part long, key long, pair long, role long, fp long")
    dealt = rows.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair", "role")
    return dealt.mapInArrow(lambda batches: _verify(batches, distance), "node long, root long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Fingerprints are linked at ``distance`` or fewer differing bits. Equal fingerprints meet once, as one node,
    however many documents have them. Null ids are passed over when the smallest is taken.
    """
    own = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    cluster = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    root = nodes.join(cluster, "fp", "left").select("fp", "first", F.coalesce("cluster", "fp").alias("root"))
    smallest = root.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(root.join(smallest, "root").select("fp", "component_id"), "labels")
    return own.join(label, "fp").select("doc_id", "fp", "component_id")
