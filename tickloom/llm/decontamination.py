"""Benchmark decontamination: SimHash windows of each item's size, multi-index Hamming blocks, exact check.

For every benchmark item, windows of its number of words slide over a document. A window's fingerprint is
the SimHash of its word counts. Fingerprints are cut into BLOCKS blocks; within RADIUS differing bits some
block differs in at most RADIUS // BLOCKS bits, so looking up every block with that tolerance finds all
fingerprints within the radius. Candidates are verified by the weighted Jaccard similarity of their
five-word shingles (weights: occurrences in the item and in the window).

A window that passes the check holds at least the share SIMILARITY of the item's shingles, so it holds one of any
(1 - SIMILARITY) of them and one more. The rarest of an item are its marks; only windows around a mark are formed,
and compared with the items of that mark alone. This leaves out no window that could pass the check, and a passage
that all items share brings no item into the comparison of another's windows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, worker_object

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
BITS = 64
SLICE_BYTES = 16 << 20  # benchmark text that travels to the tasks at once; a larger benchmark takes several passes
FILTER_BITS = 22

words = re.compile(r"\w+").findall


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` word hashes: a bit is set if set in over half the words."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
    votes = total[size:] - total[:-size]
    return np.packbits(2 * votes > size, axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A rolling combination of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (hashes[i:i + len(out)] ^ np.uint64(0x5851F42D4C957F2D))
    return out


def similarity(a: list[str], b: list[str], k: int) -> float:
    """Weighted Jaccard similarity of the k-word shingles of two word lists."""
    x, y = (Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def near_block(blocks: int = BLOCKS, radius: int = RADIUS) -> np.ndarray:
    """(values, values): whether two block values differ in at most radius // blocks bits."""
    value = np.arange(1 << (BITS // blocks), dtype=np.uint64)
    return np.bitwise_count(value[:, None] ^ value[None, :]) <= radius // blocks


@dataclass
class Item:
    """An item's words, shingle length and fingerprint."""

    name: int | str
    words: list[str]
    k: int
    print: np.uint64


class Benchmark:
    """A slice of the benchmark, indexed for the search of documents."""

    def __init__(self, rows: list[tuple[int | str, str]], shingle: int = SHINGLE_WORDS, at_least: float = SIMILARITY,
                 radius: int = RADIUS, blocks: int = BLOCKS):
        self.at_least, self.radius, self.blocks = at_least, radius, blocks
        self.near = near_block(blocks, radius)
        self.items: list[Item] = []
        self.known: dict[str, int] = {}
        shingles = []
        for item, text in rows:
            w = words((text or "").lower())
            if w:
                for x in w:
                    if x not in self.known:
                        self.known[x] = word_hash(x)
                hashed, k = np.array([self.known[x] for x in w], np.uint64), min(shingle, len(w))
                self.items.append(Item(item, w, k, window_prints(hashed, len(w))[0]))
                shingles.append(shingle_hashes(hashed, k).tolist())
        shared = Counter(s for each in shingles for s in set(each))
        # shingle length -> shingle -> items that have it among their marks
        self.where: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, each in enumerate(shingles):
            marks = len(each) - math.ceil(at_least * len(each) - 1e-9) + 1
            for s in set(sorted(each, key=lambda s: (shared[s], s))[:marks]):
                self.where[self.items[i].k][s].append(i)
        self.filters = {}
        for k, found in self.where.items():
            flags = np.zeros(1 << FILTER_BITS, bool)
            flags[(np.array(list(found), np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters[k] = flags

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        width = BITS // self.blocks
        return ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def find(self, text: str | None) -> list[tuple[int | str, int, int, float]]:
        """(name, first word, words, similarity) of the best window of every item that the text contains."""
        w = words((text or "").lower())
        if not w or not self.items:
            return []
        get = self.known.get
        hashes = np.array([get(x, 0) for x in w], np.uint64)
        marked: dict[int, list[int]] = defaultdict(list)
        for k, found in self.where.items():
            if k > len(w):
                continue
            shingles = shingle_hashes(hashes, k)
            for at in np.flatnonzero(self.filters[k][(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]):
                for i in found.get(int(shingles[at]), ()):
                    marked[i].append(int(at))
        sizes: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, places in marked.items():
            item = self.items[i]
            span = min(len(item.words), len(w))
            sizes[span].append((i, self._starts(np.array(places), span, item.k, len(w) - span)))
        best: dict[int | str, tuple[float, int, int]] = {}
        for span, wanted in sizes.items():
            prints = self._prints(w, hashes, span, np.unique(np.concatenate([starts for _, starts in wanted])))
            for i, starts in wanted:
                self._check(w, span, prints, self.items[i], starts, best)
        return [(item, at, n, s) for item, (s, at, n) in sorted(best.items())]

    @staticmethod
    def _starts(places: np.ndarray, span: int, k: int, last: int) -> np.ndarray:
        """First words of all windows that hold one of the places, ascending."""
        edge = np.zeros(last + 2, np.int32)
        np.add.at(edge, np.minimum(np.maximum(places - span + k, 0), last), 1)
        np.add.at(edge, np.minimum(places, last) + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    @staticmethod
    def _prints(w: list[str], hashes: np.ndarray, span: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows that begin at ``starts`` (zero elsewhere)."""
        out = np.zeros(len(w) - span + 1, np.uint64)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            a, b = int(run[0]), int(run[-1])
            part = hashes[a:b + span].copy()
            for i in np.flatnonzero(part == 0):  # words that no item has
                part[i] = word_hash(w[a + int(i)])
            out[a:b + 1] = window_prints(part, span)
        return out

    def within(self, prints: np.ndarray, one: np.uint64) -> np.ndarray:
        """Which fingerprints lie within the radius of ``one``: some block is near, then all bits are counted."""
        possible = np.zeros(len(prints), bool)
        for b in range(self.blocks):
            possible |= self.near[self.block(one, b)][self.block(prints, b)]
        found = np.flatnonzero(possible)
        return found[np.bitwise_count(prints[found] ^ one) <= self.radius]

    def _check(self, w: list[str], span: int, prints: np.ndarray, item: Item, starts: np.ndarray, best: dict) -> None:
        for at in starts[self.within(prints[starts], item.print)].tolist():
            s = similarity(item.words, w[at:at + span], item.k)
            if s >= self.at_least and (item.name not in best or (s, -at) > (best[item.name][0], -best[item.name][1])):
                best[item.name] = (s, at, span)


def item_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, text, name of the distinct items that have an id and a text; equal texts have the same name."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).filter(
        "text is not null and item_id is not null")
    return rows.distinct().withColumn("name", F.sha2("text", 256))


def slices(rows: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(name, text) of the distinct texts, in lists of at most about ``slice_bytes``: copies of an item travel once."""
    texts = rows.select("name", "text").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // slice_bytes))
    for i in range(count):
        yield [tuple(r) for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == i).collect()]


def indexed(rows: list[tuple[int | str, str]], at_least: float) -> Callable[[], Benchmark]:
    """The index of a slice, for its tasks: a worker makes it once."""
    key = ("benchmark", zlib.crc32("\0".join(str(name) for name, _ in rows).encode()), len(rows), at_least)
    return lambda: worker_object(key, lambda: Benchmark(rows, at_least=at_least))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", at_least: float = SIMILARITY,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of every item in every document.

    Words are runs of letters, digits and underscores, in lower case. Items and documents that are null or
    have no word match nothing; items without id are left out; an item shorter than a shingle is one shingle.
    Ties go to the first window. Repeated documents give repeated results; equal texts under several ids match under
    each, an id with several texts once for each of them, and an item that is repeated under its id counts once. Other
    columns are not read.
    """
    def searcher(rows: list[tuple[int | str, str]]):
        made = indexed(rows, at_least)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = made()
            for batch in batches:
                found = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"]) for hit in index.find(text)]
                yield pd.DataFrame(found, columns=["doc_id", "name", "start_word", "n_words", "similarity"])

        return search

    out = None
    slim = docs.select(id_text(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    rows = item_rows(benchmark, item_col, item_text_col)
    for some in slices(rows, slice_bytes):
        part = slim.mapInPandas(searcher(some), "doc_id string, name string, start_word long, n_words long, similarity double")
        part = part.withColumn("doc_id", F.col("doc_id").cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out.join(rows.select("name", "item_id"), "name").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def is_clean(benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text_col: str = "text",
             at_least: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> Column:
    """Boolean column: the text holds no benchmark item (null and empty texts are clean)."""
    def checker(rows: list[tuple[int | str, str]]):
        made = indexed(rows, at_least)

        def check(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = made()
            for batch in texts:
                yield pd.Series([not index.find(t) for t in batch], dtype=bool)

        check.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(check, "boolean")

    clean = F.lit(True)
    for some in slices(item_rows(benchmark, item_col, item_text_col), slice_bytes):
        clean = clean & checker(some)(text)
    return clean
