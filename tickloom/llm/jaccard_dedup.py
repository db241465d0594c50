"""Near duplicates of texts: SimHash and pigeonring first, then MinHash bands, all verified by exact Jaccard.

Fingerprints of the five-word shingles are linked by the pigeonring filter within its three bits, which joins
close copies at little cost. No fixed radius of fingerprints covers a similarity of 0.8 (measured: up to 17 of 64
bits), and buckets of the few equal bits that a wide radius leaves would hold most of a large corpus. The other
candidates therefore come from bands of MinHash values: two texts of similarity s share no band of 4 with
probability (1 - s^4)^40, below 10^-9 at 0.8. Candidates not linked already are checked on their whole shingle
sets; a fingerprint alone links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, shuffle_partitions, whole_groups, written
from tickloom.llm.components import components
from tickloom.llm.simhash_dedup import near_links

SEED = 42
SHINGLE_WORDS = 5
LEAST = (4, 5)  # similarity as a fraction, so that 0.8 is compared without rounding
BANDS, BAND_ROWS = 40, 4
BLOCK_ROWS = 512  # larger open buckets are compared in pairs of blocks of about this size
SHINGLES_AT_ONCE = 1024


def shingles_of(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of the word shingles of one text, sorted; a shorter text is one shingle, no word none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - words_each, 0) + 1
    begins, ends = begins[:last].tolist(), ends[-last:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[x:y], seed) for x, y in zip(begins, ends)), np.uint64, last))


def print_of(shingles: np.ndarray) -> int:
    """The SimHash of distinct shingles: a bit is set if it is in over half of them; signed."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at:at + SHINGLES_AT_ONCE].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<i8")[0])


def bands_of(shingles: np.ndarray) -> list[int]:
    """One number a band: the hash of its MinHash values and its place."""
    import xxhash

    if not len(shingles):
        return []
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        x = shingles[None, at:at + SHINGLES_AT_ONCE] * factors
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(1))
    values = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(values)], np.uint64).view(np.int64).tolist()


def _numbers(text: Column, of) -> Column:
    def rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([of(t) for t in batch], dtype=object)

    rows.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(rows, "array<long>")(text)


def node_of(text: Column) -> Column:
    """A 64-bit hash of the words of a text, as shingles see them: texts of equal words are one node."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[ \\t\\n\\x0B\\f\\r]+", " ")
    return F.xxhash64(F.trim(flat))


def _linked(sets: list[np.ndarray], labels: np.ndarray, crossing: np.ndarray | None, least: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the similar pairs (of different sides only, if given) that ``labels`` do not connect yet."""
    p, q = least
    sizes = np.array([len(s) for s in sets])
    labels, found = labels.copy(), []
    for i in range(1, len(sets)):
        near = (labels[:i] != labels[i]) & (q * np.minimum(sizes[:i], sizes[i]) >= p * np.maximum(sizes[:i], sizes[i]))
        if crossing is not None:
            near &= crossing[:i] != crossing[i]
        for j in np.flatnonzero(near).tolist():
            if labels[i] != labels[j] and (p + q) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= p * (sizes[i] + sizes[j]):
                found.append((i, j))
                labels[labels == labels[i]] = labels[j]
    return found


def _open_links(members: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) inside the buckets of ``members`` (band, node, root) that still hold several roots."""
    spark = members.sparkSession
    sums = members.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"),
                                       F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    sums = sums.groupBy("n", "all").agg(F.min("band").alias("band"))  # bands of the same nodes count once
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = written(
        members.join(sums, "band").select("band", "node", "root", blocks.alias("k"))
        .withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("k")).cast("int"))
        .select("band", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "root"), "contested")
    ready = (dealt.join(sets, "node").repartition(shuffle_partitions(spark), "band", "p", "q")
             .sortWithinPartitions("band", "p", "q", "node"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["band", "p", "q"]):
            for (_, p, q), group in rows.groupby(["band", "p", "q"], sort=False):
                node = group["node"].to_numpy()
                found = _linked(group["shingles"].tolist(), group["root"].to_numpy(), group["own"].to_numpy() if p != q else None, least)
                yield pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    return ready.mapInPandas(compare, "a long, b long")


def _checked(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (low, node) whose sets have the similarity ``least``, as links (a, b).

    The set of every node travels once a pair, that of ``low`` once for every BLOCK_ROWS of its pairs or so; a task
    reads them one after another and holds two at a time.
    """
    spark = pairs.sparkSession
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    many = pairs.groupBy("low").agg(F.count("*").alias("n"))
    dealt = written(pairs.join(many, "low").select("low", "node", F.pmod(F.xxhash64("node", "low"), parts).cast("int").alias("part")), "pairs")
    heads = dealt.select("low", "part").distinct().select("low", "part", F.col("low").alias("node"), F.lit(0).alias("kind"))
    ready = (heads.unionByName(dealt.withColumn("kind", F.lit(1))).join(sets, "node")
             .repartition(shuffle_partitions(spark), "low", "part").sortWithinPartitions("low", "part", "kind"))
    p, q = least

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.zeros(0, np.int64)
        for rows in batches:
            a, b = [], []
            for low, node, kind, shingles in zip(rows["low"], rows["node"], rows["kind"], rows["shingles"]):
                if kind == 0:
                    head = np.asarray(shingles)
                    continue
                x, y = len(head), len(shingles)
                if q * min(x, y) >= p * max(x, y) and (p + q) * len(np.intersect1d(head, shingles, assume_unique=True)) >= p * (x + y):
                    a.append(low)
                    b.append(node)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return ready.mapInPandas(check, "a long, b long")


def similar_components(docs: DataFrame, node: str, text_col: str, words_each: int = SHINGLE_WORDS,
                       least: tuple[int, int] = LEAST, seed: int = SEED) -> DataFrame:
    """(node, root) of every node of ``docs`` that is linked to another one by similarity ``least`` or more."""
    def sketch_of(text: str | None) -> list[int]:
        shingles = shingles_of(text, words_each, seed)
        return [print_of(shingles), *bands_of(shingles)]

    sketches = written(docs.select(F.col(node).alias("node"), _numbers(F.col(text_col), sketch_of).alias("sketch"))
                       .groupBy("node").agg(F.first("sketch").alias("sketch"))
                       .select("node", F.col("sketch")[0].alias("fp"), F.slice("sketch", 2, BANDS).alias("bands")), "sketches")
    # candidates of the fingerprints: equal ones with the smallest node, and the pigeonring's links of different ones
    prints = written(sketches.filter(F.size("bands") > 0).groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n")), "prints")
    near = near_links(prints.select("fp"))
    name = lambda side: prints.select(F.col("fp").alias(side), F.col("low").alias(f"{side}_node"))
    close = (near.join(name("a"), "a").join(name("b"), "b")
             .select(F.least("a_node", "b_node").alias("low"), F.greatest("a_node", "b_node").alias("node")))
    same = sketches.join(prints.filter("n > 1"), "fp").filter("node <> low").select("low", "node")
    by_print = written(close.unionByName(same).filter("low <> node").distinct(), "near")
    # candidates of the bands
    banded = sketches.select("node", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1").drop("n"), "shared")
    members = written(banded.join(shared, "band"), "members")
    by_band = written(members.filter("node <> low").select("low", "node").distinct(), "pairs")

    wanted = members.select(F.col("node").alias("wanted")).union(by_print.select("low")).union(by_print.select("node")).distinct()
    texts = docs.join(wanted, F.col(node) == F.col("wanted"), "left_semi").select(F.col(node).alias("node"), F.col(text_col).alias("text"))
    shingles = _numbers(F.col("text"), lambda t: shingles_of(t, words_each, seed).view(np.int64))
    sets = written(texts.dropDuplicates(["node"]).select("node", shingles.alias("shingles")), "shingles")

    links = written(_checked(by_print, sets, least), "links")
    named = lambda roots, side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    roots = written(components(links, "a", "b"), "roots")
    # then every node with the smallest one of its buckets, where fingerprints have not linked them already
    apart = (by_band.join(named(roots, "low"), "low", "left").join(named(roots, "node"), "node", "left")
             .filter(F.coalesce("low_root", "low") != F.coalesce("node_root", "node")).select("low", "node"))
    links = links.unionByName(written(_checked(apart, sets, least), "links"))
    roots = written(components(links, "a", "b"), "roots")
    left = written(members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "named")
    more = written(_open_links(left, sets, least), "links")
    return components(links.unionByName(more), "a", "b")


def one_of_each(docs: DataFrame, words_each: int = SHINGLE_WORDS, least: tuple[int, int] = LEAST, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of similar texts: the one with the smallest id. All columns stay.

    Texts without words are equal. Rows that agree in id and words are one document, of which any copy stays.
    A row without id stays only if its whole component has none and its node is the component's smallest.
    """
    node, lost = free_name(docs, "node"), free_name(docs, "lost")
    marked = docs.withColumn(node, node_of(F.col(text_col)))
    nodes = written(marked.select(F.col(id_col).cast("bigint").alias("id"), F.col(node).alias("node")), "nodes")
    distinct = written(nodes.groupBy("node").agg(F.min("id").alias("first_id")), "distinct")
    roots = written(similar_components(marked, node, text_col, words_each, least, seed), "roots")
    joined = written(distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id"), "joined")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(joined.join(smallest, "root").select("node", "root", "component_id"), "components")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("component_id").isNotNull() | (F.col("node") == F.col("root")))
    losers = nodes.join(named, "node").filter(~stays).select("id", F.col("node").alias(lost)).distinct()
    same = marked[id_col].cast("bigint").eqNullSafe(losers["id"]) & (marked[node] == losers[lost])
    return marked.join(losers, same, "left_anti").dropDuplicates([id_col, node]).drop(node)
