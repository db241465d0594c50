import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import simhash_dedup as sd
from tickloom.llm.components import components
from tickloom.llm.queries import QUERIES


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """rows: (doc_id, fingerprint) -> component of each row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [best.get(root(i)) for i in range(len(rows))]


TEXTS = [None, "", " \t\n", "one", "One TWO", "a b c d", "É à b c D", "x\u0085y z w", "w " * 150_000, "İ K ſ"]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string")
    got = {r.i: r.fp % (1 << 64) for r in docs.select("i", sd.fingerprint(F.col("text")).alias("fp")).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(TEXTS)}


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block,radius", [(2048, 3), (16, 3), (16, 5), (2048, 0)])
def test_links_find_all_components(spark, monkeypatch, block, radius):
    monkeypatch.setattr(sd, "BLOCK_ROWS", block)
    rng = random.Random(block + radius)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for p in prints[:30]:  # chains of near prints, whose ends are far apart
        for _ in range(4):
            p = near(rng, p, rng.randint(1, radius + 1))
            prints.append(p)
    centre = rng.getrandbits(64)
    prints += [near(rng, centre, rng.randint(0, 2)) for _ in range(150)]  # a bucket above the smaller block
    rows = [(i, p) for i, p in enumerate(dict.fromkeys(prints))]
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, fp long").repartition(4)
    got = {r.fp % (1 << 64): r.component_id for r in sd.fingerprint_components(df, radius).collect()}
    assert got == {p: c for (_, p), c in zip(rows, brute_components(rows, radius))}


def test_edges_stay_below_the_rows_of_a_bucket(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = list({signed(near(rng, centre, rng.randint(0, 2))) for _ in range(1500)})
    edges = sd.near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).count()
    assert edges < 4 * len(prints)


def test_documents_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (None, "only without id"), (3, "one"), (3, "one"), (-5, "ONE")]
    docs = spark.createDataFrame([(*r, 9, 1) for r in rows], "doc_id long, text string, fp int, component_id int")
    expected = brute_components([(d, brute_print(t)) for d, t in rows])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in sd.near_duplicates(docs).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted([(d, brute_print(t), c) for (d, t), c in zip(rows, expected)], key=key)
    assert sd.near_duplicates(docs.filter("false")).count() == 0


def test_one_of_each_keeps_columns_and_whole_groups(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "other words stand here now"), (3, "other words stand here now"), (None, "a b c d e"), (None, "alone"), (None, "apart from all"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, fp string")
    kept = sd.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    assert got == sorted([(1, "a b c d e"), (3, "other words stand here now"), (None, "alone"), (None, "apart from all"), (4, None)], key=str)
    assert sd.one_of_each(docs.filter("false")).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_simhash_dedup"](spark, folder).collect())
    assert got == sorted((d, f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows)))


def test_components_of_long_paths_and_hubs(spark):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, int(x)) for x in range(1001, 1400)] + [(5000, 5000), (1400, 1399), (1400, 1399)]
    noise = [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (150, 2))]
    edges = path + hub + noise + [(None, 3), (4, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
