"""Exact search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import same
from tidewire.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, row int, block string"


def brute(rows, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, q) in enumerate(good):
        if i is not None and i % 50 == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(q, v)), -1 << 63), (1 << 63) - 1), j is None, j or 0) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
            for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1):
                yield i, rank, None if none else j, -s


@pytest.mark.parametrize("shard,leaf", [(4096, 64), (40, 3)])
def test_top_k(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(0)
    rows = [(i, [round(float(x), 1) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(8)]  # ties
    rows += [(400, None), (450, [1.0, None, 2.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, []), (650, []),
             (None, rows[0][1]), (700, [1.0, 2.0]), (750, [3e9, 1.0]), (801, [-2e9, 1.0]), (0, rows[7][1])]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], SCHEMA)
    same(topk.top_k(df, F.col("vec_id") % 50 == 0).collect(), brute(rows, 5))


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 1, "")], SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
