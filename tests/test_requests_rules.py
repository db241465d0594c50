"""Comparison of seconds, p values, blocked pairs and overlapping windows against brute force."""

import math
import random

import numpy as np
import pytest

from tickloom.operators import requests as rq
from tickloom.operators.reconstruct import overlap_join


def test_p_values_of_few_and_many_degrees_of_freedom():
    t = np.array([0.0, 0.3, 1.0, 2.5, 7.0, 40.0, 1e6])
    one = 1 - 2 / math.pi * np.arctan(t)
    assert rq.two_sided_p(t, np.ones(7)) == pytest.approx(one, rel=1e-9, abs=1e-15)
    assert rq.two_sided_p(t, np.full(7, 2)) == pytest.approx([2 / (2 + x * x + x * math.sqrt(2 + x * x)) for x in t], rel=1e-9)
    three = [1 - 2 / math.pi * (math.atan(x / math.sqrt(3)) + x * math.sqrt(3) / (3 + x * x)) for x in t]
    assert rq.two_sided_p(t, np.full(7, 3)) == pytest.approx(three, rel=1e-7, abs=1e-14)
    many = rq.two_sided_p(t[:5], np.full(5, 1e9))
    assert many == pytest.approx([math.erfc(x / math.sqrt(2)) for x in t[:5]], rel=1e-6)
    # the two sides of the change of formula for the constant
    assert rq.two_sided_p(np.array([2.0, 2.0]), np.array([20_000, 20_001])) == pytest.approx([0.0455123] * 2, rel=1e-4)
    assert rq.two_sided_p(np.array([np.inf]), np.array([5])).tolist() == [0.0]


@pytest.mark.parametrize("n_types,slow,within", [(1, 1, True), (2, 2, True), (3, 3, False), (1001, 500, True), (1001, 501, False)])
def test_a_second_against_its_reference(n_types, slow, within):
    reference = {str(i): [5, 100.0, 10.0] for i in range(n_types)} | {"rare": [2, 100.0, 0.0], "gone": [9, 1.0, 1.0]}
    current = {str(i): [4, 120.0 if i < slow else 80.0, 1.0] for i in range(n_types)} | {"rare": [9, 500.0, 0.0]}
    assert rq.against(reference, current) == (within, 0.25 if slow < n_types else 0.0)
    assert rq.against({}, current) == (True, 0.0)


def test_every_pair_of_runs_once(spark):
    runs = [(b, r) for b in ("x", "y") for r in range(40)]
    frame = spark.createDataFrame(runs, "bench string, run long")
    pairs = rq.run_pairs(frame, "run", ["bench"])
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == 2 * 40 * 39 // 2 and all(a < b for _, a, b in got)


def test_all_overlapping_windows(spark):
    rng = random.Random(8)
    points = [(rng.choice("ab"), i, rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9))])) for i in range(300)] + [("c", 900, 1.0), ("a", 901, None)]
    windows = []
    for i in range(80):
        s = rng.choice([rng.uniform(-60, 50), float(rng.randrange(-9, 9))])
        windows.append((rng.choice("ab"), i, s, s + rng.choice([0.0, -1.0, 1e-9, 0.5, 1.0, 3.7, 16.0, 90.0])))
    windows.append(("a", 99, 0.0, None))
    p = spark.createDataFrame(points, "k string, id long, x double")
    w = spark.createDataFrame(windows, "k string, w long, s double, e double")
    want = sorted((k, i, v) for k, i, x in points for g, v, s, e in windows if k == g and x is not None and e is not None and s <= x < e)
    inner = overlap_join(p, w, ["k"], "x", "s", "e", ["w"])
    assert sorted((r.k, r.id, r.w) for r in inner.collect()) == want
    left = overlap_join(p, w, ["k"], "x", "s", "e", ["w"], how="left").collect()
    assert sorted((r.k, r.id, r.w) for r in left if r.w is not None) == want
    assert {r.id for r in left if r.w is None} == {i for _, i, _ in points} - {i for _, i, _ in want}
    assert overlap_join(p, w.where("false"), ["k"], "x", "s", "e", ["w"]).count() == 0
