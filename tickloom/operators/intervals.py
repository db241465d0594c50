"""Anomaly windows, bursts and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import descending, safe_div
from tickloom.operators.fidelity import KEYS, runs
from tickloom.operators.reconstruct import asof_forward, interval_join
from tickloom.operators.scans import group_stats, number_rows, percentiles, previous, running_sum, scan
from tickloom.session import short_as


def anomaly_windows(df: DataFrame, by: Sequence[str] = KEYS, z: float = 3.0, min_consecutive: int = 3,
                    warmup: int = 50) -> DataFrame:
    """Runs of at least k ticks further than z deviations from the warm-up mean (ends inclusive)."""
    by = list(by)
    base = df.where(F.col("tick") < warmup).groupBy(*by).agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("__sd"))
    sigma = F.when(F.col("__sd") < 1e-8, F.lit(1.0)).otherwise(F.col("__sd"))
    scored = df.join(base, by)
    far = F.abs(F.col("value") - F.col("mu")) > F.lit(z) * sigma
    return runs(scored, by, far).where(F.col("length") >= min_consecutive).select(
        *by, "start_tick", "end_tick", "length")


def match_windows(truth: DataFrame, found: DataFrame, by: Sequence[str] = KEYS, tolerance: int = 5) -> DataFrame:
    """Each reference window with its first overlapping (± tolerance) detected window.

    The windows of one side are disjoint, so the first candidate is the earliest one
    ending at or after ``start - tolerance``: an as-of look-up instead of a theta join.
    """
    by = list(by)
    probe = truth.withColumn("__at", F.col("start_tick") - tolerance)
    ends = found.select(*by, F.col("end_tick").alias("__at"), F.col("start_tick").alias("det_start"),
                        F.col("end_tick").alias("det_end"))
    hit = asof_forward(probe, ends, by, "__at", ["det_start", "det_end"])
    near = F.col("det_start") <= F.col("end_tick") + tolerance
    return hit.select(
        *by, "start_tick", "end_tick",
        F.when(near, F.col("det_start")).alias("det_start"), F.when(near, F.col("det_end")).alias("det_end"),
        F.when(near, F.greatest(F.lit(0), F.col("det_start") - F.col("start_tick"))).alias("latency"))


def compare_windows(truth: DataFrame, found: DataFrame, by: Sequence[str] = KEYS, tolerance: int = 5) -> DataFrame:
    """Detected, missed and false-positive counts, recall and mean latency per key."""
    by = list(by)
    matched = match_windows(truth, found, by, tolerance)
    left = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__gt"), F.count("det_start").alias("__hit"),
        F.avg("latency").alias("__lat"), F.count_distinct("det_start").alias("__used"))
    right = found.groupBy(*by).agg(F.count(F.lit(1)).alias("__det"))
    both = left.join(right, by, "full")
    n_gt, hit = F.coalesce("__gt", F.lit(0)), F.coalesce("__hit", F.lit(0))
    n_det = F.coalesce("__det", F.lit(0))
    return both.select(
        *by, n_gt.alias("ground_truth_count"), n_det.alias("detected_count"), hit.alias("detected"),
        (n_gt - hit).alias("missed"), (n_det - F.coalesce("__used", F.lit(0))).alias("false_positives"),
        F.coalesce(safe_div(hit, n_gt), F.lit(1.0)).alias("recall"),
        F.coalesce("__lat", F.lit(0.0)).alias("mean_latency_ticks"))


def bursts(df: DataFrame, by: Sequence[str] = KEYS, percentile: float = 0.92, min_length: int = 10,
           merge_gap: int = 20) -> DataFrame:
    """Merged runs above a percentile: ``burst, start, end`` (half-open) and ``peak``."""
    by = list(by)
    limits = percentiles(df, by, F.col("value"), {"__limit": percentile})
    high = runs(df.join(limits, by), by, F.col("value") > F.col("__limit")).where(
        F.col("length") >= min_length).select(*by, "start_tick", (F.col("end_tick") + 1).alias("__end"))
    gap = scan(high, by, ["start_tick"], {"__pe": previous(F.col("__end"))})
    fresh = F.col("__pe").isNull() | (F.col("start_tick") - F.col("__pe") > merge_gap)
    grouped = scan(gap.withColumn("__new", F.when(fresh, 1).otherwise(0)), by, ["start_tick"],
                   {"burst": running_sum(F.col("__new"))})
    merged = grouped.groupBy(*by, "burst").agg(F.min("start_tick").alias("start"), F.max("__end").alias("end"))
    inside = interval_join(df.select(*by, "tick", "value"), short_as(merged, df, by), by, "tick", "start", "end", ["burst", "start", "end"])
    peaks = inside.groupBy(*by, "burst", "start", "end").agg(F.max("value").alias("peak"))
    return peaks.select(*by, F.col("burst").cast("long").alias("burst"), "start", "end", "peak")


def burst_peak_recall(df: DataFrame, found: DataFrame, by: Sequence[str] = KEYS, share: float = 0.10) -> DataFrame:
    """Kept share of the largest ceil(share * length) values inside each burst."""
    by = list(by)
    keys = by + ["burst"]
    inside = interval_join(df.select(*by, "tick", "value", "sampled"), short_as(found, df, by), by, "tick", "start", "end",
                           ["burst", "start", "end"], how="left").where(F.col("burst").isNotNull())
    ranked = number_rows(inside, keys, [descending("value"), descending("tick")], "__rank")
    k = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) * F.lit(share)))
    top = ranked.where(F.col("__rank") < k)
    return top.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_top"), F.sum(F.when(F.col("sampled"), 1).otherwise(0)).alias("n_captured"),
        F.avg(F.when(F.col("sampled"), 1.0).otherwise(0.0)).alias("peak_recall"))


def live_summary(rows: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Sampling summary of sparse live rows ``t, value, sampled`` over their own tick range."""
    by = list(by)
    read = F.col("sampled") & F.col("value").isNotNull()
    totals = rows.groupBy(*by).agg(
        F.min("t").alias("start_tick"), F.max("t").alias("end_tick"), F.count(F.when(read, 1)).alias("n_sampled"))
    gap = scan(rows.where(read), by, ["t"], {"__p": previous(F.col("t"))}, "t")
    step = (F.col("t") - F.col("__p")).cast("double")
    gaps = group_stats(gap, by, [F.max(step).alias("__max"), F.avg(step).alias("__mean")], {"__p95": (step, 0.95)})
    n = F.col("end_tick") - F.col("start_tick") + 1
    few = F.when(F.col("n_sampled") == 1, 1.0).otherwise(0.0)
    return totals.join(gaps, by, "left").select(
        *by, "start_tick", "end_tick", n.alias("n_total"), "n_sampled",
        (F.col("n_sampled") / n).alias("sample_ratio"), F.coalesce("__max", few).cast("long").alias("max_gap"),
        F.coalesce("__mean", few).alias("mean_gap"), F.coalesce("__p95", few).alias("p95_gap"))


def top_spikes(df: DataFrame, by: Sequence[str], value: str, limit: int = 12) -> DataFrame:
    """Rows at or above the 99th percentile, at most ``limit`` largest per key."""
    by = list(by)
    cut_at = percentiles(df, by, F.col(value), {"__p99": 0.99})
    high = df.join(cut_at, by).where(F.col(value) >= F.col("__p99")).drop("__p99")
    ranked = number_rows(high, by, [descending(value), descending("tick")], "__rank")
    return ranked.where(F.col("__rank") < limit).drop("__rank")
