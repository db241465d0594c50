"""Exact top-k inner products with block-at-a-time pruning.

Rows are dealt into chunks; a task holds one chunk and a set of queries. The chunk's rows are ordered so that
similar ones stand together and cut into ranges of BLOCK rows, each with the largest and smallest weight per
term (component) and a forward index (its rows). A query's bound for a block is the sum over its terms of
query weight times the extreme weight of the right sign. Blocks are scored from the highest bound down,
until the bound falls below the query's k-th score. The best of all chunks are merged by a ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

BLOCK = 64
CHUNK_ROWS = 8192
QUERY_ROWS = 4096
K = 20


def quantised(vector, scale: int = 64):
    """floor(scale * x) of every component as a double; null for vectors null or with a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _clustered(rows: np.ndarray) -> np.ndarray:
    """An order of the rows that puts those near the same pivot together; the pivots are evenly spaced rows."""
    pivots = rows[:: max(1, len(rows) // max(1, int(len(rows) ** 0.5)))]
    return np.argsort((rows @ pivots.T - 0.5 * (pivots ** 2).sum(1)).argmax(1), kind="stable")


def _chunk_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of each query's best k rows of the chunk, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    rank = np.arange(len(ids))  # ranks by id
    turn = _clustered(rows)
    bits = int(len(ids)).bit_length()
    starts = np.arange(0, len(turn), BLOCK)
    high = np.maximum.reduceat(rows[turn], starts)
    low = np.minimum.reduceat(rows[turn], starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    none = np.int64(-1) << np.int64(62)
    best = np.full((len(q), k), none)  # score and rank in one integer: higher is better
    live = np.arange(len(q))
    for step in range(len(starts)):
        at = visit[live, step]
        kth = best[live, k - 1]
        open_ = (kth == none) | (bounds[live, at] >= (kth >> bits))
        live, at = live[open_], at[open_]
        if not len(live):
            break
        for block in np.unique(at):
            who = live[at == block]
            members = turn[starts[block]:starts[block] + BLOCK]
            score = (q[who] @ rows[members].T).astype(np.int64)
            mixed = (score << bits) + ((1 << bits) - 1 - rank[members])
            mixed[q_ids[who][:, None] == ids[members][None, :]] = none
            pool = np.concatenate([best[who], mixed], axis=1)
            pool = np.partition(pool, pool.shape[1] - k, axis=1)[:, -k:]
            best[who] = -np.sort(-pool, axis=1)
    who, place = np.nonzero(best != none)
    mixed = best[who, place]
    return who, order[(1 << bits) - 1 - (mixed & ((1 << bits) - 1))], mixed >> bits


def _chunk_top_wide(q_ids, q, ids, rows, k):
    """The same for weights whose scores do not fit beside a rank in 62 bits: integers of any size, no blocks."""
    out = []
    big = [[int(x) for x in r] for r in rows]
    for i, v in enumerate(q):
        v = [int(x) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(v, r)), ids[j], j) for j, r in enumerate(big) if ids[j] != q_ids[i])
        out += [(i, j, -s) for s, _, j in scored[:k]]
    a = np.array(out, dtype=object).reshape(-1, 3)
    if any(abs(s) >= 1 << 63 for s in a[:, 2]):
        raise OverflowError("an inner product does not fit into 64 bits")
    return a[:, 0].astype(np.int64), a[:, 1].astype(np.int64), a[:, 2].astype(np.int64)


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query with the other rows.

    ``is_query`` is a condition on the internal column ``vec_id``. Vectors that are null or hold null or
    non-finite components, and rows without id, take no part; missing trailing components count as zero. A
    query is an id (of repeated rows with that id, the smallest vector), and rows of the query's own id are
    no candidates; other repeated rows are candidates each. Ties go to the smaller id. Empty tables give no row.
    """
    rows = written(
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col)).alias("v"))
        .filter("vec_id is not null and v is not null")
        .select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, = rows.agg(F.count("*")).first()
    n_queries, = queries.agg(F.count("*")).first()
    chunks, sets = max(1, -(-n // CHUNK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("set"), every(chunks).alias("chunk"))
    right = rows.select("vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), every(sets).alias("set"))

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(q["v"].map(len).max(), d["v"].map(len).max(), 1)
        a, b = _matrix(q["v"], width), _matrix(d["v"], width)
        fits = np.abs(a).max() * np.abs(b).max() * width * 2.0 ** int(len(d)).bit_length() < 2.0 ** 61 and \
            np.abs(a).max() * np.abs(b).max() * width < 2.0 ** 53
        q_ids, ids = q["vec_id"].to_numpy(), d["vec_id"].to_numpy()
        who, where, score = (_chunk_top if fits else _chunk_top_wide)(q_ids, a, ids, b, k)
        return pd.DataFrame({"query_id": q_ids[who], "vec_id": ids[where], "score": score})

    found = left.groupBy("set", "chunk").cogroup(right.groupBy("set", "chunk")).applyInPandas(
        best, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
