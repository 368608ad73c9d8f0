"""Exact nearest vectors by integer inner product: ball trees, branch and bound, one tree per shard.

A node's ball (centre c, radius r) bounds the score of a query q by q.c + |q| r. Nodes are taken in the order of
that bound and the search of a shard ends when the best bound is below the k-th score found so far. Queries first search
one shard; the k-th score from there is where every other shard starts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import batch_of, col

#: Vectors of a shard, queries of a block, and vectors of a tree's leaf; fewer vectors if they are long.
SHARD, BLOCK, LEAF = 4096, 512, 64
SHARD_NUMBERS = 1 << 20
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max

PACKED = pa.schema([("dim", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())])
PACKED_DDL = "dim long, ids binary, rows binary, vectors binary"
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_row long, query_id long, id long, row long, score long"


class BallTree:
    """Vectors in leaves that halve them along their widest direction."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        x = vectors.astype(float)
        self.centre, self.radius, self.children, self.members = [], [], [], []
        waiting = [(np.arange(len(x)), -1)]
        while waiting:
            own, parent = waiting.pop()
            node = len(self.centre)
            centre = x[own].mean(axis=0)
            apart = np.sqrt(np.square(x[own] - centre).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(apart.max())
            self.children.append([])
            self.members.append(own if len(own) <= LEAF else None)
            if parent >= 0:
                self.children[parent].append(node)
            if len(own) > LEAF:
                one = x[own[apart.argmax()]]
                other = x[own[np.square(x[own] - one).sum(axis=1).argmax()]]
                order = np.argsort(x[own] @ (other - one), kind="stable")
                half = len(own) // 2
                waiting += [(own[order[:half]], node), (own[order[half:]], node)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.leaves = [None if m is None else x[m] for m in self.members]
        self.largest = float(np.abs(x).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score in each node, for each query; a little above, against rounding."""
        q = queries.astype(float)
        length = np.sqrt(np.square(q).sum(axis=1))
        top = q @ self.centre.T + length[:, None] * self.radius
        return top + 1e-9 * (np.abs(top) + length[:, None] * (self.radius + 1)) + 1e-6

    def scores(self, node: int, q: np.ndarray) -> list[int]:
        if self.largest * float(np.abs(q.astype(float)).max(initial=0)) * max(len(q), 1) < EXACT:
            return (self.leaves[node] @ q.astype(float)).astype(np.int64).tolist()
        most = np.iinfo(np.int64)
        own = self.vectors[self.members[node]]
        return [min(max(sum(a * b for a, b in zip(v, q.tolist())), most.min), most.max) for v in own.tolist()]

    def search(self, q: np.ndarray, bounds: np.ndarray, k: int, ids: list[int], rows: list[int], own: int, start: int | None):
        """The ``k`` best (score, -id, row) other than row ``own``; of scores below ``start`` none is needed."""
        best: list[tuple[int, int, int]] = []
        bar = -np.inf if start is None else start
        open_ = [(-bounds[0], 0)]
        while open_ and -open_[0][0] >= bar:
            node = heapq.heappop(open_)[1]
            for child in self.children[node]:
                if bounds[child] >= bar:
                    heapq.heappush(open_, (-bounds[child], child))
            if self.members[node] is not None:
                for i, score in zip(self.members[node].tolist(), self.scores(node, q)):
                    if score >= bar and rows[i] != own:
                        heapq.heappush(best, (score, -ids[i], rows[i]))
                        if len(best) > k:
                            heapq.heappop(best)
                        if len(best) == k:
                            bar = max(bar, best[0][0])
        return best


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Vectors of one length together, up to ``most``, as one row."""
    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            size = vectors.value_lengths().to_numpy()
            ids = np.array([NO_ID if i is None else i for i in batch.column("id").to_pylist()], np.int64)
            row = batch.column("row").to_numpy()
            flat, begin = vectors.flatten().to_numpy(), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                step = max(1, min(most, SHARD_NUMBERS // max(dim, 1)))
                for a in range(0, len(own), step):
                    part = own[a:a + step]
                    matrix = flat[begin[part][:, None] + np.arange(dim)]
                    yield batch_of(PACKED, dim=[dim], ids=[ids[part].tobytes()], rows=[row[part].tobytes()],
                                   vectors=[matrix.astype(np.int64).tobytes()])

    return rows.mapInArrow(run, PACKED_DDL)


def _unpack(row: dict):
    ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
    return ids.tolist(), rows.tolist(), np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"])


def _searched(work: DataFrame, k: int) -> DataFrame:
    """Rows come sorted: each shard, then the query blocks that search it."""
    def run(batches):
        shard = tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] < 0:
                    shard, tree = _unpack(row), None
                    continue
                ids, rows, vectors = shard
                tree = tree or BallTree(vectors)
                q_ids, q_rows, queries = _unpack(row)
                start = row["start"] or [None] * len(q_ids)
                bounds = tree.bounds(queries)
                out = [(q_rows[j], q_ids[j], -i, r, s) for j in range(len(q_ids))
                       for s, i, r in tree.search(queries[j], bounds[j], k, ids, rows, q_rows[j], start[j])]
                if out:
                    yield batch_of(FOUND, **dict(zip(FOUND.names, zip(*out))))

    return work.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, FOUND_DDL)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows with the highest scores for each row that ``is_query``.

    Components x count as floor(256 * x); the score is their inner product, exact (at the ends of the 64-bit range it
    stays there). Candidates are all other rows of the same length, also such with an equal id; ties go to the smaller
    id, null ids last. Vectors that are null or hold a null or non-finite component take no part; no queries or no
    candidates give no rows.
    """
    x = col(vector_col)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(x.isNotNull() & fit).select(
        col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("v"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = materialize(_pack(rows, SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asking = rows.filter("asks").repartition(F.floor(F.col("row") / BLOCK))
    blocks = materialize(_pack(asking, BLOCK).withColumn("block", F.monotonically_increasing_id()), "queries")
    own = shards.select("shard", F.lit(-1).cast("long").alias("block"), *PACKED.names, F.lit(None).cast("array<long>").alias("start"))

    def work(targets: DataFrame, starts: DataFrame | None) -> DataFrame:
        asked = blocks.join(targets, "dim")
        asked = asked.join(starts, "block", "left") if starts is not None else asked.withColumn("start", F.lit(None).cast("array<long>"))
        return own.join(targets.select("shard"), "shard", "left_semi").unionByName(asked.select(own.columns))

    first = shards.groupBy("dim").agg(F.min("shard").alias("shard"))
    pilot = _best(_searched(work(first, None), k), k).groupBy("query_row").agg(
        F.when(F.count("*") == k, F.min("score")).alias("bar"))

    def places(batches):
        for batch in batches:
            for row in batch.to_pylist():
                r = np.frombuffer(row["rows"], np.int64)
                yield pa.RecordBatch.from_pydict({"block": [row["block"]] * len(r), "at": np.arange(len(r)), "query_row": r})

    order = blocks.select("block", "rows").mapInArrow(places, "block long, at long, query_row long")
    starts = order.join(pilot, "query_row", "left").groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "bar"))), lambda s: s["bar"]).alias("start"))
    found = _best(_searched(work(shards.select("dim", "shard"), materialize(starts, "bars")), k), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"),
                        F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), "score")
