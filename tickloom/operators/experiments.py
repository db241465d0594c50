"""Repeated experiments: alignment, scaling accuracy, repeats and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_corr, safe_div
from tickloom.operators.reconstruct import asof_backward, asof_forward, interpolate, interval_join
from tickloom.operators.scans import group_stats, number_rows, previous, scan
from tickloom.operators.windows import change_points
from tickloom.sources.schedules import directional_windows, transition_windows

# Lags tried, rows needed per lag, coverage needed for CPU metrics.
LAGS = range(-12, 13)
MIN_OVERLAP = 30
MIN_COVERAGE = 0.95


def value_at(points: DataFrame, timeline: DataFrame, by: Sequence[str], on: str, value: str,
             name: str, default: int = 1) -> DataFrame:
    """State of a timeline at each point in time; ``default`` before its first row."""
    known = timeline.select(*by, on, F.col(value).alias(name))
    hit = asof_backward(points, known, by, on, [name])
    return hit.withColumn(name, F.coalesce(name, F.lit(default)))


def decision_points(timeline: DataFrame, signal: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows where ``desired`` changes, with the signal interpolated at that time.

    timeline: by…, t, desired; signal: by…, t, value (uneven times).
    """
    by = list(by)
    changes = scan(timeline, by, ["t"], {"__p": previous(F.col("desired"))})
    points = changes.where((F.col("desired") > 0) & (F.col("__p").isNull() | (F.col("desired") != F.col("__p"))))
    both = points.select(*by, "t", "desired").unionByName(
        signal.select(*by, "t", F.col("value").alias("__v")), allowMissingColumns=True)
    filled = interpolate(both, by, {"signal": F.col("__v")}, x="t", position=None)
    return filled.where(F.col("desired").isNotNull()).select(*by, "t", "desired", "signal")


def per_second_fleet_mean(readings: DataFrame, by: Sequence[str], member: str, second: str, value: str,
                          order: str) -> DataFrame:
    """Mean over members per second; a member's last reading in a second wins."""
    last = readings.groupBy(*by, second, member).agg(F.max_by(value, order).alias("__v"))
    return last.groupBy(*by, second).agg(F.avg("__v").alias("mean_cpu"), F.count(F.lit(1)).alias("n_pods"))


def first_change(windows: DataFrame, changes: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """First change of the window's direction inside [start_s, window_end_s)."""
    keys = [*by, "direction"]
    probe = windows.withColumn("__at", F.col("start_s"))
    hits = changes.select(*keys, F.col("elapsed_s").alias("__at"), F.col("elapsed_s").alias(name))
    found = asof_forward(probe, hits, keys, "__at", [name])
    return found.withColumn(name, F.when(F.col(name) < F.col("window_end_s"), F.col(name))).drop("__at")


def scaling_accuracy(timeline: DataFrame, phases: DataFrame, by: Sequence[str], min_replicas: int = 1,
                     max_replicas: int | None = None) -> DataFrame:
    """Transitions, detections and latencies per direction, for readiness and decisions.

    timeline: by…, elapsed_s, ready, desired (already forward filled);
    phases: by…, name, start_s, end_s, direction.
    """
    by = list(by)
    horizon = timeline.groupBy(*by).agg((F.max("elapsed_s") + 1e-6).alias("__horizon"))
    windows = transition_windows(phases.join(horizon, by), by, "__horizon").select(
        *by, "name", "direction", "start_s", "window_end_s")
    starts = windows.withColumn("elapsed_s", F.col("start_s"))
    for state in ("ready", "desired"):
        starts = value_at(starts, timeline, by, "elapsed_s", state, f"__{state}")
        hits = change_points(timeline, by, "elapsed_s", state)
        starts = first_change(starts, hits, by, f"__{state}_at")
    cols = []
    for state, label in (("ready", ""), ("desired", "decision_")):
        at = F.col(f"__{state}")
        blocked = (F.col("direction") == "down") & (at <= min_replicas)
        if max_replicas is not None:
            blocked = blocked | ((F.col("direction") == "up") & (at >= max_replicas))
        seen = F.when(~blocked, F.col(f"__{state}_at") - F.col("start_s"))
        transitions = F.count(F.when(~blocked, 1))
        cols += [transitions.alias(f"{label}transition_count"), F.count(seen).alias(f"{label}detected_count"),
                 safe_div(F.count(seen), F.when(transitions > 0, transitions)).alias(f"{label}detection_rate"),
                 F.avg(seen).alias(f"{label}latency_s")]
    return starts.groupBy(*by, "direction").agg(*cols)


def scaling_events(timeline: DataFrame, by: Sequence[str]) -> DataFrame:
    """Peak replicas and number of changes per run."""
    wide = scan(timeline, by, ["elapsed_s"], {"__r": previous(F.col("ready")), "__d": previous(F.col("desired"))})
    count = lambda c: F.count(F.when(c, 1))
    return wide.groupBy(*by).agg(
        F.max("ready").alias("peak_replicas"), F.count(F.lit(1)).alias("timeline_points"),
        count(F.col("ready") > F.col("__r")).alias("scale_up_events"), count(F.col("ready") < F.col("__r")).alias("scale_down_events"),
        count(F.col("desired") > F.col("__d")).alias("hpa_scale_up_events"),
        count(F.col("desired") < F.col("__d")).alias("hpa_scale_down_events"))


def provisioning(cpu: DataFrame, timeline: DataFrame, phases: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """Under-provisioned seconds and excess core-seconds in rising phases, if telemetry covers them."""
    by = list(by)
    up = directional_windows(phases, by, "up").select(*by, "name", "start_s", "window_end_s")
    expected = up.groupBy(*by).agg(F.sum(F.ceil("window_end_s") - F.ceil("start_s")).alias("cpu_expected_seconds"))
    points = cpu.withColumn("elapsed_s", F.col("elapsed_s").cast("double"))
    inside = interval_join(points, up, by, "elapsed_s", "start_s", "window_end_s", ["name"])
    loaded = value_at(inside, timeline, by, "elapsed_s", "ready", "__ready")
    over = F.greatest(F.lit(0.0), F.col("mean_cpu") - target)
    seen = loaded.groupBy(*by).agg(
        F.count_distinct(F.floor("elapsed_s")).alias("cpu_observed_seconds"),
        F.count(F.when(F.col("mean_cpu") > target, 1)).alias("__under"), F.sum(over * F.col("__ready")).alias("__excess"))
    both = expected.join(seen, by, "left")
    observed = F.coalesce("cpu_observed_seconds", F.lit(0))
    coverage = safe_div(observed, F.when(F.col("cpu_expected_seconds") > 0, F.col("cpu_expected_seconds")))
    covered = coverage >= MIN_COVERAGE
    return both.select(
        *by, "cpu_expected_seconds", observed.alias("cpu_observed_seconds"), coverage.alias("cpu_telemetry_coverage"),
        F.when(covered, F.coalesce("__under", F.lit(0))).alias("under_provisioned_s"),
        F.when(covered, F.coalesce("__excess", F.lit(0.0))).alias("cpu_target_excess_core_seconds"))


# --- repeats and pairs ---------------------------------------------------------------------

def repeat_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, standard error, 95 % half width, median and n over repeats."""
    v = F.col(value)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    sem = F.when(F.count(v) > 1, sd / F.sqrt(F.count(v))).otherwise(0.0)
    return group_stats(rows, by, [
        F.avg(v).alias("mean"), sd.alias("stdev"), sem.alias("sem"), (sem * 1.96).alias("ci95_half_width"),
        F.count(v).alias("n")], {"median": (v, 0.5)})


def repeat_means_summary(rows: DataFrame, by: Sequence[str], repeat: str, value: str) -> DataFrame:
    """One mean per repeat (empty repeats skipped), then the summary over repeats."""
    means = rows.groupBy(*by, repeat).agg(F.avg(value).alias("__m")).where(F.col("__m").isNotNull())
    return repeat_summary(means, by, "__m")


def paired_deltas(rows: DataFrame, by: Sequence[str], arm: str, left: str, right: str, value: str) -> DataFrame:
    """``right - left`` for every key measured in both arms."""
    a = rows.where(F.col(arm) == left).select(*by, F.col(value).alias("__l"))
    b = rows.where(F.col(arm) == right).select(*by, F.col(value).alias("__r"))
    return a.join(b, list(by)).select(*by, (F.col("__r") - F.col("__l")).alias("delta"))


def pair_by_position(left: DataFrame, right: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of two lists paired by their position."""
    by = list(by)
    a = number_rows(left, by, list(order), "position")
    b = number_rows(right, by, list(order), "position")
    rename = lambda df, p: df.select(*by, "position", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (*by, "position")])
    return rename(a, "left").join(rename(b, "right"), [*by, "position"])


# --- comparability of live runs ---------------------------------------------------------------

def lag_scores(full: DataFrame, adaptive: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation and p95-scaled RMSE of two runs at every lag with enough overlap.

    Only the ticks the adaptive run read are moved, once per lag, to the tick they
    would match.
    """
    by = list(by)
    read = adaptive.where(F.col("sampled") & F.col("value").isNotNull()).select(
        *by, "tick", F.col("value").alias("y"), F.explode(F.array(*[F.lit(k) for k in LAGS])).alias("lag"))
    moved = read.select(*by, "lag", (F.col("tick") + F.col("lag")).alias("tick"), "y")
    pairs = full.where(F.col("value").isNotNull()).select(*by, "tick", F.col("value").alias("x")).join(moved, [*by, "tick"])
    d = F.col("x") - F.col("y")
    scored = group_stats(pairs, [*by, "lag"], [
        F.count(F.lit(1)).alias("overlap_count"), safe_corr(F.col("x"), F.col("y")).alias("corr"),
        F.sqrt(F.avg(d * d)).alias("__rmse")], {"__scale": (F.abs("x"), 0.95)})
    return scored.where(F.col("overlap_count") >= MIN_OVERLAP).withColumn(
        "nrmse_p95", F.when(F.col("__scale") > 0, F.col("__rmse") / F.col("__scale"))).drop("__rmse", "__scale")


def comparability(full: DataFrame, adaptive: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best lag by correlation minus error, and whether the runs can be compared."""
    by = list(by)
    score = F.rint((F.col("corr") - F.col("nrmse_p95")) * 1e9)
    best = lag_scores(full, adaptive, by).where(score.isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct("lag", "overlap_count", "corr", "nrmse_p95"), F.struct(score, -F.col("lag"))).alias("b"))
    kept = adaptive.groupBy(*by).agg(F.count(F.when(F.col("sampled") & F.col("value").isNotNull(), 1)).alias("__kept"))
    corr, err = F.col("b.corr"), F.col("b.nrmse_p95")
    status = (F.when(F.col("b").isNull(), "unknown").when((corr >= 0.75) & (err <= 0.35), "comparable")
              .when((corr >= 0.55) & (err <= 0.60), "suspect").otherwise("non-comparable"))
    notes = F.array_compact(F.array(
        F.when(F.abs("b.lag") >= 6, F.lit("large_shift")), F.when(corr < 0.75, F.lit("modest_correlation")),
        F.when(err > 0.35, F.lit("elevated_error"))))
    return kept.join(best, by, "left").select(
        *by, status.alias("status"), F.col("b.lag").alias("best_lag_ticks"),
        F.coalesce("b.overlap_count", F.lit(0)).alias("overlap_count"),
        (safe_div(F.col("b.overlap_count"), F.col("__kept")) * 100.0).alias("overlap_pct"),
        corr.alias("corr"), err.alias("nrmse_p95"), F.array_join(notes, ",").alias("notes"))


# --- freshness ---------------------------------------------------------------------------------

def freshness(ready: DataFrame, baseline: DataFrame, current: DataFrame, by: Sequence[str], name: str,
              version: str) -> DataFrame:
    """Whether every ready member has a version newer than its baseline, with the reason if not."""
    by = list(by)
    rows = (
        ready.select(*by, name, F.lit(True).alias("__r"))
        .join(current.select(*by, name, F.col(version).alias("__c"), F.lit(True).alias("__has")), [*by, name], "full")
        .join(baseline.select(*by, name, F.col(version).alias("__b")), [*by, name], "left")
    )
    count = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy(*by).agg(
        count(F.col("__r").isNull() | F.col("__has").isNull()).alias("n_unmatched"),
        count(F.col("__r").isNotNull() & F.col("__b").isNull()).alias("n_no_baseline"),
        count(F.col("__r").isNotNull() & F.coalesce(F.col("__c") <= F.col("__b"), F.lit(False))).alias("n_stale"))
    reason = (F.when(F.col("n_unmatched") > 0, "members_differ").when(F.col("n_no_baseline") > 0, "baseline_missing")
              .when(F.col("n_stale") > 0, "stale").otherwise("fresh"))
    return out.withColumn("reason", reason).withColumn("fresh", F.col("reason") == "fresh")


def published_after_samples(metrics: DataFrame, samples: DataFrame, by: Sequence[str], name: str, delay_s: float) -> DataFrame:
    """Members whose metric (seconds) was not published ``delay_s`` after their last sample."""
    both = metrics.join(samples, [*by, name])
    late = F.col("last_sample_wall").isNull() | (F.col("metric_wall") < F.col("last_sample_wall") + delay_s)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_members"), F.count(F.when(late, 1)).alias("n_stale"))
