"""The plans for large inputs give the results of the plans for small ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fidelity as fd
from tickloom.operators import intervals as iv
from tickloom.operators import scans as sc
from tickloom.operators.masks import n_of_m
from tickloom.operators.replay import masked_replay, replay
from tickloom.params import make_config


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if isinstance(p, float) and isinstance(q, float):
                assert math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9), (x, y)
            else:
                assert p == q, (x, y)


@pytest.fixture
def skewed(spark):
    """One series with almost all rows, NULL values, and repeated order values."""
    rng = random.Random(3)
    rows = [("hot" if i % 20 else f"k{i}", i // 2, i, None if i % 7 == 0 else rng.gauss(50, 20)) for i in range(3000)]
    return spark.createDataFrame(rows, "series_id string, ts long, id long, v double").repartition(7)


@pytest.fixture
def noisy(spark):
    rng = random.Random(5)
    rows = [(s, i, 40 + 10 * math.sin(i / 30) + rng.expovariate(0.1)) for s, n in (("hot", 240), ("b", 60), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, tick long, value double")


def test_numbering(skewed):
    one = sc.number_rows(skewed, ["series_id"], ["ts", "id"], small=True)
    many = sc.number_rows(skewed, ["series_id"], ["ts", "id"], small=False)
    assert rows_of(one.na.fill(-1.0)) == rows_of(many.na.fill(-1.0))


@pytest.mark.parametrize("position", [None, "tick"])
def test_scans(chunked, skewed, position):
    df = sc.number_rows(skewed, ["series_id"], ["ts", "id"], small=True)
    v = F.col("v")
    out = {"a": sc.last_known(v), "b": sc.last_known(v, False), "c": sc.next_known(v), "d": sc.next_known(v, False),
           "e": sc.running_sum(F.col("id")), "f": sc.running_sum(F.col("id"), False), "g": sc.running_min(v),
           "h": sc.running_max(v), "i": sc.previous(v), "j": sc.following(v), "k": sc.suffix_min(v)}
    order = ["ts", "id"] if position is None else ["tick"]
    one = sc.scan(df, ["series_id"], order, out, position, small=True)
    many = sc.scan(df, ["series_id"], order, out, position, small=False)
    close(rows_of(one.na.fill(-1.0)), rows_of(many.na.fill(-1.0)))


def test_percentiles(skewed):
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    # a NULL key and a key without values keep their rows in both plans
    odd = skewed.unionByName(skewed.limit(9).withColumn("series_id", F.lit(None).cast("string"))).unionByName(
        skewed.limit(3).withColumn("series_id", F.lit("empty")).withColumn("v", F.lit(None).cast("double")))
    for by in (["series_id"], []):
        one = sc.percentiles(odd, by, F.col("v"), points, small=True)
        many = sc.percentiles(odd, by, F.col("v"), points, small=False)
        close(rows_of(one.na.fill(-1.0).na.fill("null")), rows_of(many.na.fill(-1.0).na.fill("null")))
    assert sc.percentiles(odd.where("false"), [], F.col("v"), points, small=False).count() == 1


def test_group_stats_without_keys(skewed):
    stats, points = [F.count(F.lit(1)).alias("n")], {"p": (F.col("v"), 0.25)}
    close(rows_of(sc.group_stats(skewed, [], stats, points, small=True)), rows_of(sc.group_stats(skewed, [], stats, points, small=False)))


def test_halo_windows(chunked, noisy):
    out = {"s": F.sum("value"), "m": (F.max("value"), 0, 3), "n": F.count(F.lit(1))}
    one = sc.halo_windows(noisy, ["series_id"], "tick", 9, 4, out, small=True)
    many = sc.halo_windows(noisy, ["series_id"], "tick", 9, 4, out, small=False)
    close(rows_of(one), rows_of(many))


@pytest.mark.parametrize("policy", ["dense", "urgency_adaptive", "always_sample", "live_counter", "wavelet_rate",
                                    "predictive_frequency", "robust_exponential", "time_or_variation"])
def test_replay_in_pieces(chunked, noisy, policy):
    configs = [make_config(outlier_threshold=t) for t in (1.0, 3.0)]
    one = replay(noisy, configs, policy, small=True)
    many = replay(noisy, configs, policy, small=False)
    fill = lambda df: rows_of(df.na.fill(-1.0).na.fill("-"))
    assert fill(one) == fill(many)


def test_more_configurations_than_one_task(noisy):
    configs = [make_config(max_interval=h) for h in range(5, 25)]
    assert replay(noisy, configs).select("config_id").distinct().count() == 20


def test_reports(spark, noisy):
    kept = noisy.withColumn("sampled", n_of_m(F.col("tick"), 2, 5))
    calls = [lambda: fd.sampling_quality(kept), lambda: fd.sampling_efficiency(kept), lambda: fd.linear_error(kept),
             lambda: iv.bursts(kept, percentile=0.6, min_length=3), lambda: iv.anomaly_windows(kept, z=1.0, min_consecutive=2)]
    one = [rows_of(c()) for c in calls]
    spark.conf.set("spark.tickloom.path", "chunked")
    spark.conf.set("spark.tickloom.chunkTicks", "50")
    try:
        many = [rows_of(c()) for c in calls]
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
    for a, b in zip(one, many):
        close(a, b)


@pytest.mark.parametrize("urgency", [None, "u"])
def test_masked_replay_leaves_unread_ticks_out(chunked, noisy, urgency):
    """Long gaps, a mask of NULLs and a series that is never read; equal to a kernel that steps over every tick."""
    tick = F.col("tick")
    mask = F.when(F.col("series_id") == "b", False).when((tick < 20) | (tick > 190), tick % 3 == 0)
    rows = noisy.withColumn("sampled", mask).withColumn("interval", (tick % 5 + 1).cast("int")).withColumn("u", tick / 240)
    sides = [F.col("sampled").alias("mask"), "interval", *([F.col("u").alias("urgency")] if urgency else [])]
    every = replay(rows.select("series_id", "tick", "value", *sides), [make_config()], "masked",
                   aux=("mask", "interval", "urgency")[:len(sides)], small=True)
    for small in (True, False):
        got = masked_replay(rows, make_config(), urgency=urgency, small=small)
        assert got.columns == every.columns and [t for _, t in got.dtypes] == [t for _, t in every.dtypes]
        close(rows_of(got.na.fill(-1.0).na.fill("-")), rows_of(every.na.fill(-1.0).na.fill("-")))


@pytest.fixture
def event_folder(spark, tmp_path):
    """Events of a few types and users, written as a table."""
    rng = random.Random(7)
    rows = [(i, i // 3, i % 5, rng.choice(["click", "view", "error"]), rng.uniform(1, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value").write.parquet(
        str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["ctr01_busy_percent", "ctr05_cgroup_cpu_fraction", "ctr09_interval_accounting",
                                  "ctr09_rejected_intervals", "ctr11_process_cpu"])
def test_only_the_numbering_of_counters_samples_ranges(spark, event_folder, monkeypatch, name):
    """Differences of numbered snapshots are cut by tick: no second range sample, and equal rows."""
    from tickloom.plans import load_all
    from tickloom.plans.registry import QUERIES

    load_all()
    run = lambda: sorted(map(tuple, QUERIES[name](spark, event_folder).collect()), key=lambda r: r[:2])
    one = run()
    calls, plain = [], sc.range_chunks
    monkeypatch.setattr(sc, "range_chunks", lambda *a: calls.append(a) or plain(*a))
    spark.conf.set("spark.tickloom.path", "chunked")
    spark.conf.set("spark.tickloom.chunkTicks", "50")
    try:
        many = run()
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
        spark.conf.unset("spark.tickloom.chunkTicks")
    assert len(calls) == 1
    close(one, many)


def test_renamed_short_series_stay_short(spark, event_folder):
    """Counters of many short control groups are scanned by one window per group, whatever their number."""
    from tickloom.plans.counters import cgroups
    from tickloom.session import is_short

    spark.conf.set("spark.tickloom.smallInputBytes", "1")
    try:
        assert is_short(cgroups(spark, event_folder), ["cgroup"])
    finally:
        spark.conf.unset("spark.tickloom.smallInputBytes")


@pytest.mark.parametrize("path", ["single", "chunked"])
def test_phases_share_a_scan(spark, path):
    """Phases of a budget, eight masks to a row, are reported as one by one; values may be NULL."""
    from tickloom.operators.sweep import phase_masks

    rng = random.Random(5)
    rows = [(s, t, None if t % 5 == 3 or s == "b" and t < 9 else rng.gauss(0, 9)) for s in "abc" for t in range(90)]
    trace = spark.createDataFrame(rows, "series_id string, tick long, value double").repartition(5)
    budgets = spark.createDataFrame([("a", 3, 19), ("b", 1, 8), ("c", None, None)], "series_id string, n int, m int")
    keys = ["series_id", "variant"]
    spark.conf.set("spark.tickloom.path", path)
    spark.conf.set("spark.tickloom.chunkTicks", "20")
    try:
        alone = phase_masks(trace, budgets, ["series_id"]).withColumn("variant", F.col("phase")).drop("n", "m", "phase")
        blocks = phase_masks(fd.peak_ranks(trace, ["series_id"]), budgets, ["series_id"], 8).withColumn("variant", F.col("phase"))
        one, many = rows_of(fd.mask_report(alone, keys)), rows_of(fd.mask_report(blocks, keys, 8))
    finally:
        spark.conf.set("spark.tickloom.path", "auto")
        spark.conf.unset("spark.tickloom.chunkTicks")
    assert len(one) == 27
    close(one, many)


def test_two_pass_scans_no_row_per_phase(spark, monkeypatch):
    """A budget of many phases multiplies the scanned rows by an eighth of their number only."""
    from tickloom.operators import sweep as sw

    rng = random.Random(8)
    trace = spark.createDataFrame([("s", t, rng.gauss(50, 4)) for t in range(600)], "series_id string, tick long, value double")
    scanned, plain = [], fd.scan
    monkeypatch.setattr(fd, "scan", lambda df, *a, **k: scanned.append(df.count()) or plain(df, *a, **k))
    report = sw.two_pass(trace, make_config(), policies=("time_or_variation",), tolerance=0.0005).collect()
    phases = sum(r["method"] == "budget_matched" for r in report)
    assert phases > 24 and len(report) == phases + 3
    assert sum(scanned) <= 600 * (3 + math.ceil(phases / 8))


def test_ranges_do_not_follow_the_shuffle_partitions(spark, tmp_path):
    """A large input is cut by its bytes and the cores: each range sends sampled keys and task results to the driver."""
    from tickloom.session import range_count

    spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "900")
    try:
        ranges = range_count(df)
        many = rows_of(sc.number_rows(df, ["k"], ["t"], "n", small=False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ranges == 4 * spark.sparkContext.defaultParallelism
    assert many == rows_of(sc.number_rows(df, ["k"], ["t"], "n", small=True))


@pytest.fixture
def schedules(spark, tmp_path):
    """Events of five schedules, one of them far longer than the others."""
    rng = random.Random(11)
    rows = [(i, i % 5 if i % 3 else 0, rng.choice(["click", "signup", "purchase", "view", "error"]), rng.uniform(0, 9)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["win14_crossed_schedule_events", "win15_directional_windows", "joi09_points_in_phase", "joi21_stage_at_time"])
def test_short_schedules_are_not_cut(spark, schedules, name):
    """Large tables of short schedules take one window per schedule: nothing is sampled for ranges or written."""
    from __spark_entry__ import QUERIES

    found, plans = [], []
    for path, limit in (("single", "65536"), ("auto", "65536"), ("auto", "9")):
        spark.conf.set("spark.tickloom.path", path)
        spark.conf.set("spark.tickloom.smallInputBytes", "1")
        spark.conf.set("spark.tickloom.shortRows", limit)
        try:
            result = QUERIES[name](spark, schedules)
            plans.append(result._jdf.queryExecution().executedPlan().toString())
            found.append(rows_of(result.na.fill("-").na.fill(-1)))
        finally:
            spark.conf.set("spark.tickloom.path", "auto")
            spark.conf.unset("spark.tickloom.smallInputBytes")
            spark.conf.unset("spark.tickloom.shortRows")
    assert "ExistingRDD" not in plans[1]
    assert "ExistingRDD" in plans[2]  # schedules above the limit are still cut
    close(found[0], found[1])
    close(found[0], found[2])


def test_both_sides_of_a_look_up_must_be_short(spark):
    """A side without a note may hold a long key, so the union is cut as before."""
    from tickloom.operators.reconstruct import asof_backward
    from tickloom.session import mark_short

    rng = random.Random(3)
    points = spark.createDataFrame([("a", rng.random(), i) for i in range(50)], "k string, t double, i long")
    marks = spark.createDataFrame([("a", rng.random(), i) for i in range(50)], "k string, t double, m long")
    spark.conf.set("spark.tickloom.smallInputBytes", "1")
    try:
        short = mark_short(points, ["k"], "k")
        plan = lambda right: asof_backward(short, right, ["k"], "t", ["m"])._jdf.queryExecution().executedPlan().toString()
        assert sc.CHUNK in plan(marks)
        assert sc.CHUNK not in plan(mark_short(marks, ["k"], "k"))
    finally:
        spark.conf.unset("spark.tickloom.smallInputBytes")
