"""Long series in pieces: start maps settle every piece, and no series runs through one task."""

import json
import random

import pytest

from tickloom.operators import replay as rp
from tickloom.operators import starts as st
from tickloom.operators.policies import POLICIES, policy_config
from tickloom.params import make_config

SCHEMA = "series_id string, tick long, value double"
PIECES, TICKS = 40, 6_000


def steady(spark, pieces=PIECES, ticks=TICKS):
    """A calm series whose sampler stays at its largest interval, so that its phase is never forgotten."""
    rng = random.Random(7)
    rows = [("hot", i, 100.0 + rng.gauss(0, 1)) for i in range(pieces * ticks)] + [("short", i, rng.random()) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


@pytest.fixture(scope="module")
def calm(spark):
    return steady(spark)


def rows_of(df):
    return sorted(map(tuple, df.select("series_id", "config_id", "tick", "sampled", "interval", "urgency", "status", "mean", "std").collect()), key=str)


QUICK = {"alpha_base": 0.2, "max_interval": 4, "drift_decay": 0.5, "outlier_decay": 0.5}  # a past is forgotten within the short pieces of a test


@pytest.mark.parametrize("policy,given", [
    ("urgency_adaptive", {"outlier_threshold": 6.0, "sigma_ref_adapt": 0.0}),
    ("urgency_adaptive", {"outlier_threshold": 6.0, "sigma_ref_adapt": 0.1}),
    ("live_counter", {"outlier_threshold": 6.0, "sigma_ref_adapt": 0.0}),
    ("predictive_frequency", {"intervals": [1, 2, 4]}),
    ("robust_exponential", {}),
    ("time_or_variation", {}),
])
def test_pieces_settle_by_maps(spark, calm, policy, given):
    config = {**make_config(), **QUICK, **given}
    spark.conf.set("spark.tickloom.path", "chunked")
    spark.conf.set("spark.tickloom.chunkTicks", str(TICKS))
    try:
        got = rp.replay(calm, [config], policy)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, "a series was handed on in one task"
        many = rows_of(got)
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
        spark.conf.unset("spark.tickloom.chunkTicks")
    assert many == rows_of(rp.replay(calm, [config], policy, small=True))


@pytest.mark.parametrize("policy", sorted(st.STARTS))
def test_the_true_end_is_among_the_ends(policy):
    """A past that is forgotten leaves few states; the one of the sequential run is one of them."""
    rng = random.Random(3)
    cfg = policy_config(policy, make_config(outlier_threshold=6.0, max_interval=5))
    n = 90_000
    values = [50.0 + rng.gauss(0, 1) for _ in range(n)]
    aux = {"urgency": [0.05] * n} if policy == "scheduled_urgency" else {}
    cut = lambda a, b: (values[a:b], {k: v[a:b] for k, v in aux.items()})
    run = lambda a, b, state: POLICIES[policy](*cut(a, b), cfg, json.loads(json.dumps(state)) if state else None, st.Nothing())
    first, other = run(0, 4_001, None), run(3_000, 4_001, None)  # the other saw less of the past
    starts = [st.written_state(s) for s in st.guesses(policy, cfg, other, first, values[4_001 - st.TAIL:4_001])]
    found = st.ends(POLICIES[policy], *cut(4_001, n), cfg, starts)
    assert set(found) == set(starts) and st.written_state(run(4_001, n, first)) in found.values()
    assert found[starts[0]] == st.written_state(run(4_001, n, json.loads(starts[0])))


def test_maps_that_do_not_hold_leave_the_result(spark, chunked):
    """Pieces too short to forget anything: the ordered pass takes over, with equal rows."""
    rng = random.Random(9)
    trace = spark.createDataFrame([("a", i, 10.0 + rng.gauss(0, 1)) for i in range(900)], SCHEMA)
    configs = [make_config(outlier_threshold=5.0), make_config(max_interval=3)]
    assert rows_of(rp.replay(trace, configs)) == rows_of(rp.replay(trace, configs, small=True))
