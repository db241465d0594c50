import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import context_tree as ct
from tickloom.llm.common import crc_class
from tickloom.llm.queries import QUERIES


class BruteTree:
    """Context-tree weighting by its recursion, over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, path, bit in self.events(t):
                for d in range(depth + 1):
                    near = context[depth - d:]
                    self.count[near, path][bit] += 1
                    if d:
                        self.children[near[1:], path].add(near)
        self.known = {}

    def events(self, text):
        raw = bytes(self.depth) + text + b"\xff"
        for i in range(self.depth, len(raw)):
            for b in range(8):
                yield raw[i - self.depth:i], format(raw[i], "08b")[:b], raw[i] >> (7 - b) & 1

    def pw(self, near, path):
        if (near, path) not in self.known:
            a, b = self.count.get((near, path), (0, 0))
            own = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
            whole = own
            if len(near) < self.depth:
                below = sum(self.pw(c, path)[0] for c in self.children.get((near, path), ()))
                top = max(own, below)
                whole = math.log(.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            self.known[near, path] = (whole, own)
        return self.known[near, path]

    def score(self, text):
        total = 0.0
        for context, path, bit in self.events(text):
            p = None
            for d in range(self.depth, -1, -1):
                near = context[self.depth - d:]
                n = self.count.get((near, path), (0, 0))
                kt = (n[bit] + .5) / (n[0] + n[1] + 1)
                whole, own = self.pw(near, path)
                w = 1.0 if d == self.depth else math.exp(math.log(.5) + own - whole)
                p = kt if p is None else w * kt + (1 - w) * p
            total += math.log10(p)
        return total


def brute(rows, depth):
    train = [(t or "").encode() for d, t, out in rows if not out]
    counts = Counter(w for t in train for w in t.lower().split())
    counts[None] = len(train)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    tree = BruteTree(train, depth)
    result = []
    for d, t, out in rows:
        raw = (t or "").encode()
        c = [counts[w] for w in raw.lower().split()] + [counts[None]]
        result.append((d, out, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + .5) / (n + .5 * (v + 1))) for x in c), tree.score(raw)))
    return result


ROWS = [(1, "the cat sat on the mat", False), (2, "The Cat sat\x0b here", False), (3, None, False), (4, "", True), (5, "the dog sat", True),
        (6, "漢字 é ü", True), (7, "é été", False), (None, "no id", True), (8, "same", False), (8, "same", False), (9, "\x00\x00 nul", True)]


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_equals_the_recursion(spark, monkeypatch, depth):
    monkeypatch.setattr(ct, "CHUNK_CHARS", 20)  # several chunks
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, out boolean, n int, chunk string").repartition(2)
    got = ct.score_documents(docs, F.col("out"), depth).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(got, sorted(brute(ROWS, depth), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab", True)], "doc_id long, text string, out boolean")
    row = ct.score_documents(docs, F.col("out")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert row.score == pytest.approx(24 * math.log10(0.5))
    assert ct.score_documents(docs.filter("false"), F.col("out")).count() == 0


def test_probabilities_of_a_byte_sum_to_one():
    texts = [b"abracadabra", b"abba", "çé".encode()]
    keys, counts = ct.summed(*zip(*[ct.grams(t, 2) for t in texts]))
    context = (97 << 16) | (98 << 8)
    import numpy as np
    import pandas as pd

    every = np.union1d(keys, context + np.arange(256))
    n = np.zeros(len(every))
    n[np.searchsorted(every, keys)] = counts
    contexts, *_, logp = ct.subtree(every, n, 2, 2)[-1]
    at, node = np.nonzero(logp)
    near = pd.DataFrame({"nearest": (every >> 8) & 255, "byte": every & 255, "n": n}).groupby(["nearest", "byte"], as_index=False).sum()
    upper = ct.upper_levels(near, pd.DataFrame({"nearest": contexts[at] & 255, "node": node, "logp": logp[at, node]}))
    p = ct.gram_scores(every, n, 2, 2, upper)
    assert (10 ** p[np.searchsorted(every, context + np.arange(256))]).sum() == pytest.approx(1)


def test_long_text_in_pieces(monkeypatch):
    text = bytes(itertools.islice(itertools.cycle(b"some words and more of them "), 5000))
    whole = ct.grams(text)
    monkeypatch.setattr(ct, "PIECE", 333)
    assert all((a == b).all() for a, b in zip(whole, ct.grams(text)))


def test_query_has_every_document_and_beats_chance(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op9_context_tree"](spark, folder)
    n, held, bits = got.agg(F.count("*"), F.sum(F.col("held_out").cast("int")),
                            F.sum(F.when(F.col("held_out"), -F.col("score") / math.log10(2))) / F.sum(F.when(F.col("held_out"), F.col("n_bytes")))).first()
    assert n == docs.count() and held == docs.filter(crc_class(F.col("doc_id"), 5) == 1).count()
    assert bits < 3.5  # bits a byte of unseen text


def test_large_ids_beside_nulls_and_repeated_rows(spark):
    big = 2 ** 53
    rows = [(big + 1, "a b"), (None, "c"), (None, "c"), (big + 3, "d"), (big + 3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ct.score_documents(docs, F.col("text") == "d", depth=2).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert {r.doc_id for r in got if r.held_out} == {big + 3}
