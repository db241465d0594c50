"""Near duplicates by SimHash fingerprints and the pigeonring principle.

A fingerprint is cut into ``radius + 1`` segments on a ring. If two fingerprints differ in at most
``radius`` bits, then from some segment on every chain of l consecutive segments differs in at most
l * radius / segments bits. The chain of length one has a budget below one bit, so that segment is equal:
fingerprints meet in buckets by one equal segment, and the longer chains prune the pairs before the full
Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, shuffle_partitions, whole_groups, written
from tickloom.llm.components import components

BITS = 64
SEED = 42
RADIUS = 3
SHINGLE_WORDS = 3
BLOCK_ROWS = 2048  # larger buckets are compared in pairs of blocks of about this size
SHINGLES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of one text: bit set if set in over half the XXH64 of its word shingles; no word: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > words_each:
        begins, ends = begins[:len(words) - words_each + 1], ends[words_each - 1:]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(begins), SHINGLES_AT_ONCE):
        b, e = begins[at:at + SHINGLES_AT_ONCE].tolist(), ends[at:at + SHINGLES_AT_ONCE].tolist()
        hashes = np.array([digest(line[x:y], seed) for x, y in zip(b, e)], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(begins)).tobytes(), "big")


def fingerprint(text: Column, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Column of fingerprints, as signed 64-bit integers."""
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([fingerprint_of(t, words_each, seed) for t in batch], "<u8")
            yield pd.Series(found.astype("<u8").view("<i8"))

    prints.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(prints, "long")(text)


def _segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments, from the lowest bit up."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _link(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the rows i and j under the smallest label."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _within(x: np.ndarray, seg: np.ndarray, parts: list[tuple[int, int]], radius: int) -> np.ndarray:
    """Rows of ``x`` (differing bits) whose chains from segment ``seg`` keep to their budgets, the last being all bits."""
    m = len(parts)
    masks = np.array([((1 << w) - 1) << a for a, w in parts], np.uint64)
    live = np.arange(len(x))
    seen = np.zeros(len(x), np.int64)
    for length in range(1, m + 1):
        at = (seg[live] + length - 1) % m
        seen = seen + np.bitwise_count(x[live] & masks[at])
        ok = seen * m <= length * radius
        live, seen = live[ok], seen[ok]
    return live


def _pairs_in_groups(group: np.ndarray, side: np.ndarray, cross: np.ndarray, seg: np.ndarray, fp: np.ndarray,
                     parts: list[tuple[int, int]], radius: int) -> np.ndarray:
    """Labels after linking all pairs of a group (of different sides only, where ``cross``)."""
    labels = np.arange(len(fp))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.repeat(np.append(first[1:], len(fp)), np.diff(np.append(first, len(fp)))) - 1
    here = np.arange(len(fp))
    lag = 0
    while True:
        lag += 1
        here = here[here + lag <= last[here]]
        if not len(here):
            return labels
        i = here[~cross[here] | (side[here] != side[here + lag])]
        keep = _within(fp[i] ^ fp[i + lag], seg[i], parts, radius)
        if len(keep):
            labels = _link(labels, i[keep], i[keep] + lag)


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) at most ``radius`` bits apart.

    The edges have the components of all links, as a spanning forest per compared block: a bucket with n
    fingerprints gives below n edges a block pair, not all its pairs. A bucket above BLOCK_ROWS is cut into
    blocks by a hash; every pair of blocks is compared in a task of its own, so no bucket is capped.
    """
    spark = prints.sparkSession
    parts = _segments(radius)
    value = lambda a, w: F.shiftrightunsigned(F.shiftleft("fp", BITS - a - w), BITS - w)
    keyed = prints.select("fp", F.posexplode(F.array(*[value(a, w) for a, w in parts])).alias("seg", "value"))
    large = keyed.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, ["seg", "value"], "left")
        .select("seg", "value", "fp", blocks.alias("k"), F.pmod(F.xxhash64("fp", "seg"), blocks).cast("int").alias("own"))
        .select("seg", "value", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select("seg", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
        .repartition(shuffle_partitions(spark), "seg", "value", "p", "q")
        .sortWithinPartitions("seg", "value", "p", "q", "fp"))  # a group's smallest fingerprint becomes its root

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[["seg", "value", "p", "q"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            fp = rows["fp"].to_numpy().view(np.uint64)
            labels = _pairs_in_groups(group, rows["own"].to_numpy(), keys[:, 2] != keys[:, 3], keys[:, 0], fp, parts, radius)
            ours = np.flatnonzero(labels != np.arange(len(labels)))
            signed = fp.view(np.int64)
            return pd.DataFrame({"a": signed[ours], "b": signed[labels[ours]]})

        for rows in whole_groups(batches, ["seg", "value", "p", "q"]):
            yield links(rows)

    return dealt.mapInPandas(compare, "a long, b long")


def fingerprint_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp).

    root is the smallest fingerprint of the component, component_id the smallest doc_id that links reach
    (null if all of them are null).
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(near_links(distinct.select("fp"), radius), "a", "b")
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "root", "component_id")
    # written, so that both sides of a join with documents are dealt anew and a fingerprint of many can be split
    return written(distinct.join(named, "fp", "left")
                   .select("fp", F.coalesce("root", "fp").alias("root"),
                           F.coalesce("component_id", "first_id").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE_WORDS, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp is the signed fingerprint.

    A null, empty or blank text has fingerprint zero and is linked like any other. Repeated rows keep their
    rows; a null doc_id never names a component unless all its members are null. Other columns are not read.
    """
    prints = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                                 fingerprint(F.col(text_col), words_each, seed).alias("fp")), "prints")
    return prints.join(fingerprint_components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE_WORDS, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. All columns stay.

    Rows that agree in id and fingerprint are one document, of which any copy stays. A row without id stays
    only if its whole component has none and its fingerprint is the component's smallest.
    """
    fp, lost = free_name(docs, "fp"), free_name(docs, "lost")
    marked = docs.withColumn(fp, fingerprint(F.col(text_col), words_each, seed))
    prints = written(marked.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(fp).alias("fp")), "prints")
    named = prints.join(fingerprint_components(prints, radius), "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("component_id").isNotNull() | (F.col("fp") == F.col("root")))
    losers = named.filter(~stays).select("doc_id", F.col("fp").alias(lost)).distinct()
    same = marked[id_col].cast("bigint").eqNullSafe(losers["doc_id"]) & (marked[fp] == losers[lost])
    kept = marked.join(losers, same, "left_anti")
    return kept.dropDuplicates([id_col, fp]).drop(fp)
