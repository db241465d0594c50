import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import block_topk as bt


def brute(rows, k, every):
    """rows: (vec_id, vector or None) -> sorted (query_id, rank, vec_id, score)."""
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(sound):
        if i % every == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, v string").repartition(3)
    return sorted(tuple(r) for r in bt.top_k(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("chunk,block,queries", [(8192, 64, 4096), (50, 4, 7)])
def test_equals_brute_force(spark, monkeypatch, chunk, block, queries):
    monkeypatch.setattr(bt, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(bt, "BLOCK", block)
    monkeypatch.setattr(bt, "QUERY_ROWS", queries)
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # ties
    assert run(spark, rows) == brute(rows, 20, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [0.5, -0.5, 3.0]), (8, [-1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (20, []), (40, [-0.001, 0.001])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, rows, k=2) == brute(rows, 2, 20)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_repeated_queries_and_wide_weights(spark):
    rng = random.Random(1)
    rows = [(0, [1.0, 2.0]), (0, [0.5, 1.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]
    assert run(spark, rows) == brute(rows, 20, 20)
    wide = [(i, [rng.uniform(-1, 1) * 2.0 ** 22, rng.uniform(-1, 1) * 2.0 ** 22]) for i in range(30)]
    assert run(spark, wide) == brute(wide, 20, 20)


def test_pruning_leaves_blocks_out(monkeypatch):
    rng = np.random.default_rng(0)
    rows = np.concatenate([np.eye(8)[i % 8] * 50 + rng.integers(0, 3, 8) for i in range(2048)]).reshape(-1, 8)
    q = np.eye(8)[:4] * 10.0
    scored = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda a, k, axis: scored.append(len(a)) or real(a, k, axis=axis))
    who, where, score = bt._chunk_top(np.arange(-4, 0), q, np.arange(2048), rows, 5)
    assert sum(scored) < 4 * 2048 / bt.BLOCK / 2  # less than half of all query and block pairs
    for i in range(4):
        best = sorted((-int(s), j) for j, s in enumerate(rows @ q[i]))[:5]
        assert sorted(zip((-score[who == i]).tolist(), where[who == i].tolist())) == best
