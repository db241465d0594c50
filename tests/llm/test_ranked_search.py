import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import compare, connect
from tickloom.llm import ranked_search as rs
from tickloom.llm.queries import QUERIES, SQL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """{(item, rank): (doc, score)} by the definition."""
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in brute_terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def found(df):
    rows = df.collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("text", ["", "A-B c_d", "É ÄÖ Ünï", "x1Y2\x00z~\x7f", "İstanbul ǅ K", "漢字、かな 🙂"])
def test_terms(text):
    assert [t.decode() for t in rs.terms(text)] == brute_terms(text)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert not compare(spark, connect(folder), QUERIES["op13_ranked_search"], SQL["op13_ranked_search"], folder)


words = st.lists(st.sampled_from(["a", "b", "c", "d", "e", "rare", "odd"]), max_size=12).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=25), words, st.integers(1, 4), st.integers(1, 9))
def test_accumulators_lose_no_result(texts, query, k, block):
    want = brute(list(enumerate(texts)), [(0, query)], k)
    counted = [(i, Counter(rs.terms(t))) for i, t in enumerate(texts)]
    counted = [(i, c) for i, c in counted if c]
    if not counted:
        return
    vocabulary = sorted({t for _, c in counted for t in c})
    total = sum(sum(c.values()) for _, c in counted)
    df = np.array([sum(t in c for _, c in counted) for t in vocabulary])
    mine = Counter(t for t in rs.terms(query) if t in vocabulary)
    ids = np.array([vocabulary.index(t) for t in mine], np.int64)
    order = np.argsort(df[ids], kind="stable") if len(ids) else np.empty(0, int)
    weights = np.array([rs.weight(len(counted), int(df[i])) * n for i, n in zip(ids, mine.values())], np.int64)
    top = rs.Best(k)
    for at in range(0, len(counted), block):
        part = counted[at:at + block]
        flat = [(vocabulary.index(t), n) for _, c in part for t, n in c.items()]
        norm = np.array([rs.length_norm(sum(c.values()), len(counted), total) for _, c in part])
        b = rs.Block(np.array([t for t, _ in flat]), np.array([n for _, n in flat]), np.array([len(c) for _, c in part]), norm, len(vocabulary))
        place, score = b.search(ids[order], weights[order], k, top.kth())
        top.add(score, np.array([part[p][0] for p in place], np.int64), np.zeros(len(place), bool))
    assert {(0, r + 1): (int(d), int(s)) for r, (d, s) in enumerate(zip(top.doc, top.score))} == want


def test_new_accumulators_stop(monkeypatch):
    """Documents that only frequent terms name get no accumulator once k others lead."""
    texts = ["rare word word"] * 3 + ["word"] * 50
    counted = [Counter(rs.terms(t)) for t in texts]
    flat = [(0 if t == b"rare" else 1, n) for c in counted for t, n in c.items()]
    b = rs.Block(np.array([t for t, _ in flat]), np.array([n for _, n in flat]), np.array([len(c) for c in counted]), np.full(53, 100), 2)
    place, _ = b.search(np.array([0, 1]), np.array([rs.weight(53, 3), rs.weight(53, 53)]), 2, 1)
    assert place.tolist() == [0, 1, 2]


def test_nulls_ties_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 4)
    monkeypatch.setattr(rs, "BLOCK_POSTINGS", 9)
    big = 2 ** 53
    docs = [(big + 1, "Alpha beta"), (None, "alpha beta"), (big + 3, "alpha beta"), (3, None), (None, None), (4, ""), (5, "-- !!"),
            (6, "gamma " * 3000 + "alpha"), (7, "gamma delta"), (7, "gamma delta"), (8, "other words here")]
    items = [(1, "alpha"), (2, "ALPHA gamma gamma"), (3, None), (4, ""), (5, "unseen"), (None, "delta other"), (6, "alpha")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, score string").coalesce(2)
    queries = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert found(rs.search(df, queries)) == want
    assert found(rs.search(df, queries, k=2)) == brute(docs, items, 2)
    monkeypatch.setattr(rs, "SLICE_BYTES", 8)  # several turns
    assert found(rs.search(df, queries)) == want
    assert rs.search(df.filter("false"), queries).count() == rs.search(df, queries.filter("false")).count() == 0
    assert rs.search(df, queries).columns == ["item_id", "rank", "doc_id", "score"]
