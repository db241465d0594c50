"""Overlapping windows: points meet them in blocks, each result once, whatever plan and however crowded a moment is."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import reconstruct as rc
from tests.test_scale_paths import rows_of

POINT, WINDOW = "k string, id long, x double, note string", "k string, w long, s double, e double"


def crowded():
    """Points and windows with ties, a moment that holds many of both, NULLs, repeated rows, and ends that never come."""
    rng = random.Random(4)
    points = [(rng.choice("aab"), i, 5.0 if i % 3 == 0 else float(rng.randrange(-40, 40)) / 2, None if i % 7 == 0 else f"n{i}") for i in range(400)]
    points += points[:5] + [(None, 900, 1.0, "n"), ("a", 901, None, "n"), ("c", 902, 1.0, "n"), ("a", 903, math.inf, "n"), ("a", None, 5.0, None)]
    windows = []
    for i in range(90):
        s = 5.0 if i % 2 else float(rng.randrange(-50, 45)) / 2
        windows.append((rng.choice("aab"), i, s, s + rng.choice([0.0, -1.0, 0.5, 1.0, 3.5, 16.0, 70.0])))
    windows += windows[:3] + [("a", 95, 3.0, math.inf), ("b", 96, -math.inf, 2.0), ("a", 97, 0.0, None), ("b", 98, None, 3.0), (None, 99, 0.0, 9.0), ("d", 100, 0.0, 9.0)]
    hit = lambda k, x, g, s, e: None not in (k, x, g, s, e) and k == g and s <= x < e
    return points, windows, [(k, i, x, n, w) for k, i, x, n in points for g, w, s, e in windows if hit(k, x, g, s, e)]


@pytest.mark.parametrize("path", ["single", "chunked"])
def test_each_overlap_once(spark, monkeypatch, path):
    monkeypatch.setattr(rc, "BLOCK_ROWS", 7)
    monkeypatch.setattr(rc, "PART_WINDOWS", 5)
    points, windows, want = crowded()
    spark.conf.set("spark.tickloom.path", path)
    try:
        p, w = spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame(windows, WINDOW).repartition(3)
        hit = rc.overlap_join(p, w, ["k"], "x", "s", "e", ["w"])
        assert hit.columns == ["k", "id", "x", "note", "w"]
        assert sorted(map(tuple, hit.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.tickloom.path", "auto")


def test_names_of_both_sides_and_whole_numbers(spark):
    points = spark.createDataFrame([(1, t) for t in range(30)], "k int, t long")
    windows = spark.createDataFrame([(1, 3, 9), (1, 3, 4), (1, 29, 99), (2, 0, 9)], "k long, t long, u long")
    hit = rc.overlap_join(points.withColumnRenamed("t", "at"), windows, ["k"], "at", "t", "u", ["t"])
    assert hit.schema["k"].dataType.simpleString() == "int" and hit.schema["at"].dataType.simpleString() == "bigint"
    assert rows_of(hit) == sorted([(t, 1, 3) for t in range(3, 9)] + [(3, 1, 3), (29, 1, 29)])


def test_a_point_moves_with_its_block(spark, monkeypatch):
    """A point had been moved once for each length of window; now rows are moved for blocks, and for the blocks of a window."""
    rng = random.Random(6)
    points = spark.createDataFrame([("a", i, rng.uniform(0, 1000)) for i in range(20000)], "k string, id long, x double")
    windows = spark.createDataFrame([("a", i, s, s + 2.0 ** (i % 13 - 3)) for i in range(65) for s in [rng.uniform(0, 900)]], WINDOW)
    moved, plain = [], type(points).repartition
    monkeypatch.setattr(type(points), "repartition", lambda df, *a: moved.append(df.count()) or plain(df, *a))
    found = rc.overlap_join(points, windows, ["k"], "x", "s", "e", ["w"]).count()
    assert len(moved) == 2
    assert sum(moved) <= math.ceil(20000 / rc.BLOCK_ROWS) + found / rc.BLOCK_ROWS + 2 * 65


def test_tasks_follow_the_results(spark, monkeypatch):
    monkeypatch.setattr(rc, "TASK_ROWS", 1 << 14)
    spark.conf.set("spark.tickloom.path", "chunked")
    try:
        points = spark.range(8192).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"))
        windows = points.where("x < 100").select("k", F.col("x").alias("w"), F.col("x").alias("s"), (F.col("x") + 8000).alias("e"))
        hit = rc.overlap_join(points, windows, ["k"], "x", "s", "e", ["w"])
        assert f"{100 * 8 * 1024 >> 14}), REPARTITION_BY_NUM" in hit._jdf.queryExecution().executedPlan().toString()
        assert hit.count() == 100 * 8000
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
