import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontamination as dc
from tickloom.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def brute(docs, items):
    """Every window of every item's size, by exact similarity (of pairs that have a word in common)."""
    out = []
    split = [(item, re.findall(r"\w+", (text or "").lower())) for item, text in items]
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        here = Counter(w)
        for item, x in split:
            if not w or not x or item is None or sum((here & Counter(x)).values()) < len(x) / 2:
                continue
            span, best = min(len(x), len(w)), None
            for at in range(len(w) - span + 1):
                s = dc.similarity(x, w[at:at + span], min(5, len(x)))
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, at)
            if best:
                out.append((d, item, best[1], len(x), best[0]))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(40)]
    docs = []
    for d in range(120):
        w = rng.choices(WORDS, k=rng.randint(0, 120))
        if d % 2:
            x = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):  # changed, dropped or doubled words
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice([[], ["changed"], [x[at]] * 2]) + x[at + 1:] or x
            at = rng.randint(0, len(w))
            w = w[:at] + [y.upper() if d % 3 else y + "," for y in x] + w[at:]
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = made(seed)
    docs += [(None, items[3][1]), (1000, None), (1001, ""), (1002, items[4][1] + " x" * 3_000), (1003, items[5][1]), (1003, items[5][1]), (1004, "?!")]
    items += [(7, items[9][1]), (110, items[9][1]), (100, None), (101, ""), (None, "no id"), (102, items[7][1]), (103, "!!")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, similarity int")
    b = spark.createDataFrame([(*r, 3) for r in items + items[5:8]], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert sorted([tuple(r) for r in dc.contaminated(d, b).collect()], key=str) == expected
    # a benchmark that travels in several slices gives the same
    assert sorted([tuple(r) for r in dc.contaminated(d, b, slice_bytes=2000).collect()], key=str) == expected
    dirty = {r[0] for r in expected}
    clean = d.filter(dc.is_clean(b, F.col("text"), slice_bytes=4000))
    assert clean.columns == d.columns
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([r[0] for r in docs if r[0] not in dirty], key=str)


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = dc.Benchmark([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(20)])
    items = np.array([i.print for i in index.items], np.uint64)
    near = items.copy()
    for i, bits in enumerate(rng.permuted(np.tile(np.arange(64), (20, 1)), axis=1)):
        for b in bits[:dc.RADIUS]:
            near[i] ^= np.uint64(1) << np.uint64(b)
    for prints in (a, near, items):
        for one in items:
            assert np.flatnonzero(np.bitwise_count(prints ^ one) <= dc.RADIUS).tolist() == index.within(prints, one).tolist()


def test_items_that_share_most_of_their_words():
    """A template of all items, copies of an item, items that differ in one word; texts that hold some of them."""
    rng = random.Random(9)
    frame = rng.choices(WORDS, k=24)
    items = [(i, " ".join(frame[:12] + [f"x{i}", f"y{i % 7}"] + frame[12:] + rng.choices(WORDS, k=i % 5))) for i in range(60)]
    items += [(100 + i, items[i % 3][1]) for i in range(20)]
    docs = []
    for d in range(30):
        w = rng.choices(WORDS, k=30)
        for i in rng.sample(range(60), 3):
            x = items[i][1].split()
            if d % 3 == 0:
                x[rng.randrange(len(x))] = "other"
            w += x + rng.choices(WORDS, k=d)
        docs.append((d, " ".join(w)))
    index = dc.Benchmark(items)
    assert sorted([(d, *hit) for d, text in docs for hit in index.find(text)], key=str) == brute(docs, items)


def test_many_items_of_one_length_and_a_long_text():
    """Comparisons follow the marks found, not texts times items."""
    rng = random.Random(10)
    items = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(6_000)]
    index, w = dc.Benchmark(items), rng.choices(WORDS, k=20_000)
    w[5_000:5_020], w[19_980:] = items[17][1].split(), items[4_321][1].split()
    compared = []
    within, index.within = index.within, lambda prints, one: compared.append(len(prints)) or within(prints, one)
    assert [hit[:2] for hit in index.find(" ".join(w))] == [(17, 5_000), (4_321, 19_980)]
    assert sum(compared) < 2_000


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words of a document here")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(d, b).count() == 0 and d.filter(dc.is_clean(b, F.col("text"))).count() == 1
    assert dc.contaminated(d.filter("false"), d.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()]
    docs = [(r[0], r[1]) for r in read("documents")]
    got = sorted([tuple(r) for r in QUERIES["op4_decontamination"](spark, folder).collect()], key=str)
    assert got == brute(docs, read("benchmark"))


def test_large_ids_beside_nulls(spark):
    big = 2 ** 53
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(big + 1, text), (None, text), (big + 3, "other")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(big + 5, text), (7, "not in there at all, no")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()} == {(big + 1, big + 5), (None, big + 5)}
