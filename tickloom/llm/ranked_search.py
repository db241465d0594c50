"""Ranked lexical search: term-at-a-time scoring with a limited set of accumulators.

One pass turns documents into rows of (term number, frequency) for the terms of the queries, whose counts give
the document frequencies. A second pass scores them: a task builds the postings of a block of documents and
takes the terms of a query from the rarest to the most frequent. Every document that a posting names gets an
accumulator, until the largest sums that the remaining terms can add fall below the k-th partial score (of this
block, or of the task's earlier blocks): a document not met so far cannot reach the best k any more. From then
on only the accumulators at hand are updated, with all their remaining postings, so scores are exact.

Queries travel to the tasks in slices of at most ``SLICE_BYTES`` of text; a larger set takes several turns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

K = 20
SLICE_BYTES = 16 << 20
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
# A term is a run of ASCII digits and letters and of all characters beyond ASCII (fixed by the definition of the score).
_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_GAPS = bytes(b if b in _TERM_BYTES else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A to Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_GAPS).split() if text else []


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def length_norm(n: int, documents: int, all_terms: int) -> int:
    return 100 - 25 + 25 * n * documents // all_terms


class Best:
    """The k best (score, document) pairs of a query so far; equal scores by document, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def kth(self) -> int:
        """The score that a document must reach to matter; 1 as long as there is room."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if len(score) > self.k:
            worth = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, null = score[worth], doc[worth], null[worth]
        score, doc, null = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Block:
    """Postings of a block of documents: per term its documents in order, and what each adds per unit of weight."""

    def __init__(self, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray, norm: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order].astype(np.int64), doc[order]
        self.gain = 1_000_000_000 * tf // (1000 * tf + 12 * norm[self.doc])
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        present = np.flatnonzero(np.diff(self.begin))
        self.most = np.zeros(n_terms, np.int64)
        if len(present):
            self.most[present] = np.maximum.reduceat(self.gain, self.begin[present])
        self.docs = len(sizes)

    def search(self, query: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that can be among the best k or reach ``least``.

        ``query`` holds term numbers, the rarest first, ``weights`` their weights times repeats.
        """
        at_most = weights * self.most[query]
        here = np.flatnonzero(at_most)
        query, weights, at_most = query[here], weights[here], at_most[here]
        rest = np.append(np.cumsum(at_most[::-1])[::-1], 0)  # what the terms from here on can add
        total, met = np.zeros(self.docs, np.int64), np.zeros(self.docs, bool)
        so_far, kept = 0, None
        for i, t in enumerate(query):
            docs, gain = self.doc[self.begin[t]:self.begin[t + 1]], self.gain[self.begin[t]:self.begin[t + 1]]
            if kept is None and rest[i] < max(least, so_far):
                # a document without an accumulator gets at most rest[i]
                partial = total[met]
                kth = int(np.partition(partial, len(partial) - k)[len(partial) - k]) if len(partial) >= k else 0
                if rest[i] < max(least, kth):
                    kept = np.flatnonzero(met)
                    if not len(kept):
                        break
            if kept is None:
                total[docs] += weights[i] * gain
                met[docs] = True
                so_far += int(at_most[i])
            elif len(kept) < len(docs):
                place = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
                hit = docs[place] == kept
                total[kept[hit]] += weights[i] * gain[place[hit]]
            else:
                hit = met[docs]
                total[docs[hit]] += weights[i] * gain[hit]
        found = np.flatnonzero(met) if kept is None else kept
        found = found[total[found] >= max(least, 1)]
        return found, total[found]


def _query_slices(queries: DataFrame) -> Iterator[list]:
    """(key, text) rows of distinct texts, in slices of about SLICE_BYTES at most."""
    texts = queries.filter("key is not null").groupBy("key").agg(F.min("text").alias("text"))
    texts = written(texts, "query-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-int(size) // SLICE_BYTES)
    for i in range(slices):
        mine = texts if slices == 1 else texts.filter(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(slices)) == i)
        yield mine.collect()


def _search_slice(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """key, doc_id, score: the best documents of every task for each of the query texts ``rows``."""
    spark = docs.sparkSession
    counts = {r.key: Counter(terms(r.text)) for r in rows}
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts.values())))}
    if not vocabulary:
        return None
    sent_terms = spark.sparkContext.broadcast(vocabulary)  # no larger than the texts of a slice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_terms.value
        for batch in batches:
            length, number, often, kept = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                hits = {known[t]: n for t, n in Counter(found).items() if t in known}
                kept.append(i)
                length.append(len(found))
                number.append(np.fromiter(hits.keys(), "<i4", len(hits)).tobytes())
                often.append(np.fromiter(hits.values(), "<i4", len(hits)).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(length, pa.int64()),
                pa.array(number, pa.binary()), pa.array(often, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    counted = written(docs.mapInArrow(count, "doc_id long, n long, terms binary, tfs binary"), "term-counts")
    n_docs, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    n_terms = len(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            total += np.bincount(ids, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "df": total[some]})

    df = np.zeros(n_terms, np.int64)
    for r in (counted.select("terms").mapInArrow(frequencies, "term int, df long").groupBy("term")
              .agg(F.sum("df").alias("df")).collect()):
        df[r.term] = r.df
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    plan = []
    for key, found in counts.items():
        ids = np.array([vocabulary[t] for t in found], np.int64)
        order = np.lexsort((ids, df[ids]))  # rarest first
        ids, repeats = ids[order], np.array(list(found.values()), np.int64)[order]
        some = df[ids] > 0
        if some.any():
            plan.append((key, ids[some], (weights[ids] * repeats)[some]))
    sent_plan = spark.sparkContext.broadcast(plan)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent_plan.value
        best = [Best(k) for _ in queries]

        def settle(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            ids = table.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            norm = np.array([length_norm(n, n_docs, all_terms) for n in table.column("n").to_pylist()], np.int64)
            number = table.column("terms").to_pylist()
            sizes = np.array([len(x) // 4 for x in number], np.int64)
            block = Block(np.frombuffer(b"".join(number), "<i4"),
                          np.frombuffer(b"".join(table.column("tfs").to_pylist()), "<i4"), sizes, norm, n_terms)
            for (_, query, weight_of), top in zip(queries, best):
                place, points = block.search(query, weight_of, k, top.kth())
                if len(place):
                    top.add(points, doc[place], null[place])

        waiting, rows_in, postings = [], 0, 0
        for batch in batches:
            at = 0
            sizes = np.cumsum([len(x.as_py()) // 4 for x in batch.column("terms")])
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                room = int(np.searchsorted(sizes, before + BLOCK_POSTINGS - postings, "right"))
                upto = max(min(room, at + BLOCK_DOCS - rows_in, batch.num_rows), at + (not waiting))
                if upto > at:
                    waiting.append(batch.slice(at, upto - at))
                    rows_in += upto - at
                    postings += int(sizes[upto - 1]) - before
                    at = upto
                if at < batch.num_rows or rows_in >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    settle(waiting)
                    waiting, rows_in, postings = [], 0, 0
        if waiting:
            settle(waiting)
        for (key, _, _), top in zip(queries, best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(top.score)), pa.array(top.doc, pa.int64(), mask=top.null),
                    pa.array(top.score)], names=["key", "doc_id", "score"])

    return counted.mapInArrow(score, "key string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for every item.

    Equal scores go by ascending document id (null ids last). Every row of ``docs`` with a term is a document,
    repeated rows and null ids included. An item is an id (of repeated rows with that id, null included, the smallest
    text counts); equal texts are searched once. Null texts and texts without a term find and are found by
    nothing, empty tables give no row, and other columns are not read, whatever they are called.
    """
    spark = docs.sparkSession
    queries = written(
        items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
        .groupBy("item_id").agg(F.min("text").alias("text"))
        .withColumn("key", F.sha2("text", 256)), "queries")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [f for f in (_search_slice(rows, part, k) for part in _query_slices(queries)) if f is not None]
    if not found:
        return spark.createDataFrame([], queries.schema["item_id"].simpleString().replace(":", " ") + ", rank int, doc_id long, score long")
    by = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return queries.select("item_id", "key").join(best, "key").select("item_id", "rank", "doc_id", "score")
