import random

import pytest

import corpus_pipeline as cp
from tickloom.llm import jaccard_dedup as jd


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """rows: (doc_id, text) with distinct ids -> ids of the smallest document of every component."""
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(d, best.get(root(i), d))
    return set(best.values())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stage_equals_brute_force_jaccard(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in cp.near_duplicates(spark, docs, folder).collect()}
    assert set(got) == brute_kept([(d, r.text) for d, r in rows.items()])
    assert all(got[d] == rows[d] for d in got)


@pytest.mark.parametrize("block", [512, 8])
def test_groups_with_far_ends(spark, monkeypatch, block):
    """Edits around a centre and chains of edits: ends below 0.8 meet through others only."""
    monkeypatch.setattr(jd, "BLOCK_ROWS", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(6):
        words = [word() for _ in range(rng.randint(90, 200))]
        texts.append(" ".join(words))
        for _ in range(12):  # around the centre, each with one or two other words
            other = list(words)
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
        for _ in range(6):  # away from it, step by step
            words = list(words)
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += ["", None, " \n", "one", "ONE", "one two", "x " * 500, "X " * 9]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    kept = jd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept(rows)
    assert jd.one_of_each(docs.filter("false")).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, "a b c d e"), (2, "A b  c d e"), (3, "other words stand here now"), (3, "other words stand here now"), (None, "a b c d e"), (None, "alone"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in jd.one_of_each(docs).collect()], key=str)
    assert got == sorted([(1, "a b c d e"), (3, "other words stand here now"), (None, "alone"), (4, None)], key=str)


def test_fingerprints_of_distinct_shingles():
    text = "a b c d e f g h " * 40
    shingles = jd.shingles_of(text).tolist()
    want = sum(1 << b for b in range(64) if 2 * sum(s >> b & 1 for s in shingles) > len(shingles))
    assert jd.print_of(jd.shingles_of(text)) & (1 << 64) - 1 == want and jd.print_of(jd.shingles_of("")) == 0
