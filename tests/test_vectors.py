"""Small literal inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import experiments as ex
from tickloom.operators import fidelity as fd
from tickloom.operators import windows as wn
from tickloom.operators.counters import interval_accounting
from tickloom.operators.reconstruct import hold_last
from tickloom.operators.replay import n_of_m_replay, replay
from tickloom.operators.requests import two_sided_p
from tickloom.operators.sweep import budget_match
from tickloom.params import make_config
from tickloom.sources import schedules as sc
from tickloom.sources.records import cpu_quantity


def test_zero_order_hold(trace):
    held = hold_last(trace([1, 2, 8, 4, 5], [0, 2, 4])).orderBy("tick").collect()
    assert [r.held for r in held] == [1, 1, 8, 8, 5]


def test_hold_before_first_read_uses_first(trace):
    held = hold_last(trace([1, 2, 8], [1])).orderBy("tick").collect()
    assert [r.held for r in held] == [2, 2, 2]


def test_peak_recall(trace):
    r = fd.peak_recall(trace(range(1, 101), range(95, 100))).first()
    assert (r.recall_top5, r.recall_top10) == (1.0, 0.5)
    r = fd.peak_recall(trace(range(1, 101), range(90, 100))).first()
    assert [r.recall_top1, r.recall_top2, r.recall_top5, r.recall_top10, r.recall_top20] == [1, 1, 1, 1, 0.5]


def test_top_events(trace):
    values = [0.0] * 20
    values[2:5], values[12:14] = [10, 11, 12], [13, 14]
    r = fd.event_recall(trace(values, [3, 12]), share=0.25).first()
    assert (r.n_events, r.n_hit, r.event_recall, r.mean_delay) == (2, 2, 1.0, 0.5)
    assert math.isclose(r.p95_delay, 0.95)


def test_gaps_with_one_read(trace):
    r = fd.sampling_efficiency(trace(range(10), [4])).first()
    assert (r.n_sampled, r.max_gap, r.mean_gap, r.p95_gap) == (1, 10, 10.0, 10.0)


def test_warmup_on_a_flat_signal(trace):
    cfg = make_config(warmup=3)
    u = [r.urgency for r in replay(trace([0.0] * 5), [cfg], "always_sample").orderBy("tick").collect()]
    assert u[:4] == [1, 1, 1, 1] and u[4] < 1


def test_variance_floor(trace):
    for floor, std in ((0.0, 0.0), (1.0, 1.0)):
        r = replay(trace([0.0]), [make_config(initial_variance_floor=floor)], "dense").first()
        assert (r.status, r.std) == ("INIT", std)


def test_positive_std_warmup_waits(trace):
    strict = make_config(warmup=1, warmup_positive_std_only=True)
    loose = make_config(warmup=1)
    last = lambda cfg: replay(trace([0.0, 0.0, 0.0]), [cfg], "always_sample").orderBy("tick").collect()[-1].urgency
    assert last(strict) == 1.0 and last(loose) < 1.0


def test_budget_match(spark):
    def run(ratios):
        c = spark.createDataFrame([("a", i, r) for i, r in enumerate(ratios)], "k string, sweep_index long, sample_ratio double")
        return budget_match(c, spark.createDataFrame([("a", 0.40)], "k string, target double"), ["k"], 0.05).first()

    r = run([0.41, 0.43, 0.38])
    assert (r.selected_index, r.n_in_band) == (0, 2)
    r = run([0.39, 0.47])
    assert r.selected_index is None and (r.nearest_below, r.nearest_above) == (0.39, 0.47)
    with pytest.raises(ValueError):
        budget_match(None, None, [], -0.1)


def test_block_envelope(trace):
    values = [math.sin(i / 5.0) for i in range(128)]
    cfg = {**make_config(), "envelope_min": 5, "envelope_max": 20}
    kept = replay(trace(values), [cfg], "wavelet_rate").withColumn("b", F.floor(F.col("tick") / 64))
    for r in kept.groupBy("b").agg(F.sum(F.col("sampled").cast("int")).alias("n")).collect():
        assert 4 <= r.n <= 13
    fixed = {**make_config(), "envelope_min": 10, "envelope_max": 10}
    kept = replay(trace(range(128)), [fixed], "wavelet_rate").withColumn("b", F.floor(F.col("tick") / 64))
    assert {r.n for r in kept.groupBy("b").agg(F.sum(F.col("sampled").cast("int")).alias("n")).collect()} == {7}


def test_urgency_counts_every_tick(trace):
    kept = replay(trace([10.0] * 100), [make_config(max_interval=10)])
    assert kept.where("urgency is not null").count() == 100 and kept.where("sampled").count() < 100


def test_n_of_m_bounds(trace):
    with pytest.raises(ValueError):
        n_of_m_replay(trace([1.0]), make_config(), 3, 2)
    r = n_of_m_replay(trace(range(10)), make_config(), 2, 5).collect()
    assert sum(x.sampled for x in r) == 4 and {x.urgency for x in r} == {0.4} and {x.interval for x in r} == {3}


def test_schedule_durations(spark):
    phases = [("a", 0, "calm", 30), ("a", 1, "rush", 90), ("a", 2, "calm", 15), ("b", 0, "rush", 7)]
    bounds = sc.phase_bounds(spark.createDataFrame(phases, "shape string, seq int, name string, duration_s int"))
    assert [(r.shape, r.start_s, r.end_s) for r in bounds.orderBy("shape", "seq").collect()] == [
        ("a", 0, 30), ("a", 30, 120), ("a", 120, 135), ("b", 0, 7)]


PHASES = [("r", "up1", 0.0, 10.0, "up"), ("r", "hold", 10.0, 20.0, "stable"), ("r", "down1", 20.0, 30.0, "down"),
          ("r", "rest", 30.0, 40.0, "stable"), ("r", "up2", 40.0, 50.0, "up")]
SCHEMA = "run string, name string, start_s double, end_s double, direction string"


def test_transition_windows(spark):
    w = sc.transition_windows(spark.createDataFrame(PHASES, SCHEMA), ["run"]).collect()
    assert {r.name: r.window_end_s for r in w} == {"up1": 40, "down1": 50, "up2": 50}


def timeline(spark, rows):
    return spark.createDataFrame([("r", float(t), a, b) for t, a, b in rows], "run string, elapsed_s double, ready int, desired int")


def test_scaling_accuracy(spark):
    phases = spark.createDataFrame(PHASES, SCHEMA)
    t = timeline(spark, [(0, 1, 1), (15, 2, 2), (35, 1, 1), (45, 2, 2)])
    out = {r.direction: r for r in ex.scaling_accuracy(t, phases, ["run"]).collect()}
    assert out["up"].latency_s == 10.0 and out["up"].detected_count == 2 and out["up"].detection_rate == 1.0
    assert out["down"].latency_s == 15.0 and out["down"].detection_rate == 1.0
    cpu = spark.createDataFrame([("r", s, 0.04 if s in (5, 45) else 0.01) for s in range(50)], "run string, elapsed_s long, mean_cpu double")
    p = ex.provisioning(cpu, t, phases, ["run"], 0.03).first()
    assert (p.under_provisioned_s, p.cpu_telemetry_coverage) == (2, 1.0)


def test_coverage_gate(spark):
    phases = spark.createDataFrame([("r", "up", 0.0, 100.0, "up")], SCHEMA)
    cpu = spark.createDataFrame([("r", s, 0.04) for s in range(90)], "run string, elapsed_s long, mean_cpu double")
    p = ex.provisioning(cpu, timeline(spark, [(0, 1, 1)]), phases, ["run"], 0.03).first()
    assert p.cpu_telemetry_coverage == 0.9 and p.under_provisioned_s is None


def test_eligibility(spark):
    phases = spark.createDataFrame([("r", "a", 0.0, 10.0, "up"), ("r", "b", 10.0, 20.0, "down")], SCHEMA)
    def counts(ready):
        t = timeline(spark, [(0, ready, ready), (20, ready, ready)])
        return {r.direction: r.transition_count for r in ex.scaling_accuracy(t, phases, ["run"], 1, 5).collect()}
    assert counts(5) == {"up": 0, "down": 1} and counts(1) == {"up": 1, "down": 0}


def test_decision_eligibility(spark):
    phases = spark.createDataFrame([("r", "a", 0.0, 10.0, "up"), ("r", "b", 10.0, 20.0, "down")], SCHEMA)
    t = timeline(spark, [(0, 1, 5), (10, 5, 1), (20, 1, 1)])
    out = {r.direction: r for r in ex.scaling_accuracy(t, phases, ["run"], 1, 5).collect()}
    assert (out["up"].transition_count, out["up"].decision_transition_count, out["down"].transition_count) == (1, 0, 1)


def test_repeat_means(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 5.0), (2, 100.0), (3, None)], "repeat int, v double")
    r = ex.repeat_means_summary(rows, [], "repeat", "v").first()
    assert (r["mean"], r.n) == (51.5, 2)


def test_interval_accounting(spark):
    rows = [("h", 0, 200, 110, 300, 1), ("h", 1, 400, 240, 410, 1), ("h", 2, 300, 250, 420, 1), ("h", 3, 500, 300, 430, 2)]
    df = spark.createDataFrame(rows, "host string, t long, total long, busy long, own long, identity int")
    good, bad = interval_accounting(df, ["host"], "t")
    g = good.collect()
    assert len(g) == 1 and (g[0].busy_ticks, g[0].own_ticks, g[0].foreign_ticks, g[0].foreign_fraction) == (130, 110, 20.0, 0.1)
    assert sorted(r.t for r in bad.collect()) == [2, 3]


def test_cpu_quantity(spark):
    rows = spark.createDataFrame([("30m",), ("0.5",), ("x",)], "q string").select(cpu_quantity(F.col("q")).alias("c")).collect()
    assert [r.c for r in rows] == [0.03, 0.5, None]


def test_student_t():
    for t, df in ((2.228138852, 10), (12.70620474, 1), (4.30265273, 2), (1.959966, 10 ** 6)):
        assert abs(two_sided_p([t], [df])[0] - 0.05) < 1e-6


def test_flapping(spark):
    t = timeline(spark, [(0, 1, 1), (10, 2, 2), (50, 1, 1), (100, 3, 3), (200, 1, 1)])
    assert wn.flapping(t, ["run"], "elapsed_s", "ready").first().flapping_events == 1
