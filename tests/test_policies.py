"""Policies against slow, direct computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.mapping import MAPPINGS, canonical, interval_function, interval_of_config
from tickloom.operators.masks import shortest_period
from tickloom.operators.policies import block_budget, haar_sparsity, spaced_positions
from tickloom.operators.requests import guarded_rates, monitoring_cycles, uniform_selection
from tickloom.params import config_label, grid, is_valid, make_config, with_configs


def haar_matrix(n):
    if n == 1:
        return np.array([[1.0]])
    h = haar_matrix(n // 2)
    return np.vstack([np.kron(h, [1, 1]), np.kron(np.eye(n // 2), [1, -1])]) / math.sqrt(2)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13, 64])
def test_haar_sparsity_against_the_matrix(n):
    x = np.random.default_rng(n).normal(size=n)
    size = 1 << (n - 1).bit_length()
    padded = np.concatenate([x, np.full(size - n, x[-1])])
    energy = np.sort((haar_matrix(size) @ padded) ** 2)[::-1]
    want = next(k for k in range(1, size + 1) if energy[:k].sum() >= 0.995 * energy.sum() - 1e-12)
    assert haar_sparsity(x, 0.995) == want
    assert haar_sparsity(np.zeros(4), 0.995) == 1


def test_spaced_positions():
    assert spaced_positions(0, 10, 1).tolist() == [0]
    assert spaced_positions(0, 10, 3).tolist() == [0, 4, 9]
    assert len(spaced_positions(0, 5, 5)) == 5


def test_block_budget_clamps():
    cfg = {"measurements_per_coefficient": 5.0, "min_samples": 4}
    assert block_budget(0.1, 64, cfg) == 32 and block_budget(0.0001, 64, cfg) == 4 and block_budget(1.0, 64, cfg) == 64
    assert block_budget(1.0, 64, {**cfg, "envelope_min": 5, "envelope_max": 20}) == 13


def test_mapping_columns_agree_with_the_loop(spark):
    configs = [make_config(interval_mapping=m, max_interval=h) for m in (*MAPPINGS, "linear_rate") for h in (1, 20)]
    u = spark.range(101).select((F.col("id") / 100).alias("u"))
    rows = with_configs(u, configs).select("u", "config_id", interval_of_config(F.col("u")).alias("i")).collect()
    for r in rows:
        assert r.i == interval_function(configs[r.config_id])(r.u), r


def test_mapping_names():
    assert canonical("linear_rate") == canonical("linear_interval") == "original_interval"
    with pytest.raises(ValueError):
        canonical("nope")


def test_shortest_period(spark):
    ratios = [0.5, 1.0, 0.3333, 0.2365, 0.07, 0.001]
    got = {r.ratio: (r.n, r.m) for r in shortest_period(
        spark.createDataFrame([(x,) for x in ratios], "ratio double"), "ratio").collect()}
    for x in ratios:
        want = (None, None)
        for m in range(1, 129):
            n = min(m, max(1, math.floor(x * m + 0.5)))
            if abs(n / m - x) <= 0.001 + 1e-12:
                want = (n // math.gcd(n, m), m // math.gcd(n, m))
                break
        assert got[x] == want


def test_labels_and_validity(spark):
    configs = [make_config(), make_config(interval_mapping="power_rate", power=0.5), make_config(alpha_base=1.0)]
    df = with_configs(spark.createDataFrame([(10,)], "n long"), configs)
    labels = [r[0] for r in df.select(config_label(["max_interval", "power"])).collect()]
    assert labels == ["max_interval=20", "max_interval=20, power=0.5", "max_interval=20"]
    assert df.where(is_valid(F.col("n"))).count() == 0  # max_interval is above n
    assert df.where(is_valid(F.lit(50))).count() == 2
    with pytest.raises(ValueError):
        make_config(nope=1)
    assert len(grid({"beta": [0.1, 0.2], "warmup": [1, 2, 3]})) == 6


def requests(spark, seconds=40):
    rng = random.Random(1)
    rows, i = [], 0
    for s in range(seconds):
        for kind in ("a", "b", "c"):
            for _ in range(rng.randint(3, 6)):
                slow = 5 if 20 <= s < 30 else 1
                rows.append((0, i, s, kind, rng.uniform(-5, 5), int(rng.uniform(90, 110) * slow)))
                i += 1
    return spark.createDataFrame(rows, "run long, event_index long, second long, request_type string, delta double, execution long")


def test_guarded_rates(spark):
    out = guarded_rates(requests(spark)).orderBy("second").collect()
    assert out[0].rate == 0.5 and all(0.01 <= r.next_rate <= 0.5 for r in out)
    for a, b in zip(out, out[1:]):
        assert b.rate == a.next_rate
        if a.status == "ENABLE_BASELINE":
            assert b.baseline
    assert any(r.baseline for r in out)


def test_guarded_rates_in_pieces(spark):
    one = [tuple(r) for r in guarded_rates(requests(spark)).orderBy("second").collect()]
    spark.conf.set("spark.tickloom.path", "chunked")
    spark.conf.set("spark.tickloom.chunkTicks", "7")
    try:
        many = [tuple(r) for r in guarded_rates(requests(spark)).orderBy("second").collect()]
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
        spark.conf.unset("spark.tickloom.chunkTicks")
    assert one == many


def test_cycles_close_when_ready(spark):
    chosen = uniform_selection(requests(spark, 120), 0.5)
    out = monitoring_cycles(chosen, cycle_ms=20000.0).orderBy("second").collect()
    for a, b in zip(out, out[1:]):
        assert b.cycle_index == a.cycle_index + (1 if a.ready else 0)
        if a.ready:
            assert b.elapsed_ms == 1000
        assert a.ready == (a.size_ok and a.proportion_ok and a.mean_ok)
    assert any(r.ready for r in out)
