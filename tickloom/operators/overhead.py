"""Monitoring cost: summaries, accounting, stability and arm comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import finite, pct_saved, relative_pct, pct_change, safe_div
from tickloom.operators.intervals import top_spikes
from tickloom.operators.scans import group_stats

# The timed parts of one monitoring loop.
COMPONENTS = ("read_overhead_us", "tracker_overhead_us", "adaptive_overhead_us", "metrics_overhead_us", "emit_overhead_us")
PUBLISH = ("metrics_overhead_us", "emit_overhead_us")


def unpivot(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by…, metric, value`` with one row per listed column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")


def overhead_summary(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, p95, p99 and max of the finite values of every cost column."""
    v = F.col("value")
    long = unpivot(rows, by, columns).withColumn("value", finite(v)).where(v.isNotNull())
    return group_stats(long.where(F.col("value").isNotNull()), [*by, "metric"],
                       [F.avg(v).alias("mean"), F.max(v).alias("max")], {"p95": (v, 0.95), "p99": (v, 0.99)})


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Mean weighted by the ticks a reading stands for (1 where unknown)."""
    w = F.when(F.col(value).isNotNull(), F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("double"))
    return rows.groupBy(*by).agg(safe_div(F.sum(F.col(value) * w), F.sum(w)).alias(name))


def workload_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return group_stats(rows, by, [F.count(v).alias("count"), F.avg(v).alias("mean"), F.max(v).alias("max")],
                       {"p50": (v, 0.5), "p95": (v, 0.95)})


def arm_changes(summary: DataFrame, by: Sequence[str], arm: str, value: str, baseline: str) -> DataFrame:
    """Every arm against the baseline arm: change and share in percent."""
    base = summary.where(F.col(arm) == baseline).select(*by, F.col(value).alias("__ref"))
    rows = summary.join(base, list(by)) if by else summary.withColumn("__one", F.lit(1)).join(
        base.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return rows.select(*by, arm, F.col(value).alias("mean"), pct_change(F.col("__ref"), F.col(value)).alias("change_pct"),
                       relative_pct(F.col("__ref"), F.col(value)).alias("relative_pct"))


def cpu_normalisation(rows: DataFrame, by: Sequence[str], seconds_per_row: float) -> DataFrame:
    """CPU over wall time: the cumulative total, or user + system where it is missing."""
    split = F.when(F.coalesce(F.max("user_cpu_s"), F.max("system_cpu_s")).isNotNull(),
                   F.coalesce(F.max("user_cpu_s"), F.lit(0.0)) + F.coalesce(F.max("system_cpu_s"), F.lit(0.0)))
    total = F.coalesce(F.max("total_cpu_s"), split)
    wall = F.count(F.lit(1)) * F.lit(seconds_per_row)
    return rows.groupBy(*by).agg(
        wall.alias("wall_time_s"), total.alias("total_cpu_s"), (total / wall * 100.0).alias("mean_cpu_pct_over_wall"),
        F.avg("monitor_cpu_pct").alias("snapshot_mean_cpu_pct"))


def _sum_known(*parts: Column) -> Column:
    """Sum of the known parts, NULL when none is."""
    known = F.coalesce(*parts)
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(known.isNotNull(), total)


def cost_accounting(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seconds spent per part = mean cost x number of events, and shares of the active loop."""
    by = list(by)
    sampled = F.count(F.when(F.col("sampled"), 1)).alias("sampled_events")
    means = [F.avg(c).alias(f"__{c}") for c in (*COMPONENTS, "active_loop_us")]
    agg = rows.groupBy(*by).agg(sampled, F.count(F.lit(1)).alias("emitted_events"),
                                F.count(F.when(F.col("updated"), 1)).alias("updates"), *means)
    spent = lambda c, n: F.col(f"__{c}") * F.col(n) / 1e6
    out = agg.select(
        *by, "sampled_events", "emitted_events", "updates", F.col("__read_overhead_us").alias("probe_fetch_mean_us"),
        spent("read_overhead_us", "sampled_events").alias("probe_fetch_total_s"),
        spent("tracker_overhead_us", "sampled_events").alias("tracker_total_s"),
        spent("adaptive_overhead_us", "sampled_events").alias("adaptive_total_s"),
        spent("metrics_overhead_us", "updates").alias("metrics_total_s"),
        spent("emit_overhead_us", "emitted_events").alias("emit_total_s"),
        spent("active_loop_us", "sampled_events").alias("active_loop_total_s"))
    post = _sum_known(*[F.col(f"{p}_total_s") for p in ("tracker", "adaptive", "metrics", "emit")])
    share = lambda c: safe_div(c, F.when(F.col("active_loop_total_s") != 0, F.col("active_loop_total_s"))) * 100.0
    return out.withColumns({
        "publish_path_total_s": _sum_known(F.col("metrics_total_s"), F.col("emit_total_s")),
        "post_fetch_control_total_s": post, "probe_fetch_share_pct": share(F.col("probe_fetch_total_s")),
        "post_fetch_control_share_pct": share(post)})


def run_stability(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stability score and status of a run, with reason and hint codes and spike composition.

    rows: by…, tick, sampled, interval, urgency, active_loop_us, monitor_cpu_pct and the cost columns.
    """
    by = list(by)
    a, c = F.col("active_loop_us"), F.col("monitor_cpu_pct")
    tails = group_stats(rows, by, [
        F.max(a).alias("amax"), F.max(c).alias("cmax"),
        F.greatest(*[F.coalesce(F.max(p), F.lit(0.0)) for p in PUBLISH]).alias("pmax"),
        F.greatest(*[F.coalesce(F.max(p), F.lit(0.0)) for p in COMPONENTS if p not in PUBLISH]).alias("kmax")],
        {"a95": (a, 0.95), "a99": (a, 0.99), "c95": (c, 0.95), "c99": (c, 0.99)})
    col = F.col
    rules = [  # (points, condition, code)
        (2, col("amax") >= 100000.0, "active_loop_max_extreme"),
        (1, col("a99") >= F.greatest(F.lit(10000.0), col("a95") * 5.0), "active_loop_p99_inflated"),
        (2, col("cmax") >= 5.0, "cpu_large_spike"),
        (1, (col("cmax") >= 2.0) & (col("cmax") < 5.0), "cpu_moderate_spike"),
        (1, col("c99") >= F.greatest(F.lit(1.0), col("c95") * 3.0), "cpu_p99_inflated"),
        (1, col("pmax") >= 20000.0, "publish_spike"),
        (1, col("kmax") >= 10000.0, "core_loop_spike"),
    ]
    score = F.lit(0)
    for points, cond, _ in rules:
        score = score + F.when(cond, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for _, cond, code in rules]))
    spikes = top_spikes(rows.where(a.isNotNull()), by, "active_loop_us", 12)
    parts = spikes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("spike_window_count"), F.avg(F.when(col("sampled"), 1.0).otherwise(0.0)).alias("spike_sampled_fraction"),
        F.avg("interval").alias("spike_interval_mean"), F.avg("urgency").alias("spike_urgency_mean"),
        *[F.sum(F.abs(p)).alias(f"__{p}") for p in COMPONENTS])
    total = sum((F.coalesce(F.col(f"__{p}"), F.lit(0.0)) for p in COMPONENTS), F.lit(0.0))
    share = {p: safe_div(F.coalesce(F.col(f"__{p}"), F.lit(0.0)), F.when(total > 0, total)) * 100.0 for p in COMPONENTS}
    shared = parts.withColumns({f"{p}_share_pct": s for p, s in share.items()}).drop(*[f"__{p}" for p in COMPONENTS])
    publish = sum((F.col(f"{p}_share_pct") for p in PUBLISH), F.lit(0.0))
    core = sum((F.col(f"{p}_share_pct") for p in COMPONENTS if p not in PUBLISH), F.lit(0.0))
    hints = F.array_compact(F.array(
        F.when(publish >= 50.0, F.lit("publish_path_dominates")).when(core >= 50.0, F.lit("core_loop_dominates")),
        F.when(col("spike_sampled_fraction") <= 0.4, F.lit("spikes_on_unsampled_ticks")).when(
            (col("spike_sampled_fraction") >= 0.6) & (col("spike_interval_mean") <= 2.0) & (col("spike_urgency_mean") >= 0.85),
            F.lit("spikes_at_high_urgency"))))
    status = F.when(col("score") >= 4, "unstable").when(col("score") >= 2, "suspect").otherwise("stable")
    scored = tails.select(*by, score.alias("score"), F.array_join(reasons, ",").alias("reasons"))
    return scored.withColumn("status", status).join(
        shared.withColumn("hints", F.array_join(hints, ",")), by, "left")


def metric_summary(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation, min and max per metric (missing values left out)."""
    v = F.col("value")
    return long.where(v.isNotNull()).groupBy(*by, "metric").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def subset_summary(long: DataFrame, arm: str) -> DataFrame:
    """Metric summaries over all runs and over the stable, non-unstable and comparable ones.

    long: arm, metric, value, status, comparable, warned; runs with warnings are left out.
    """
    subsets = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("status") == "stable", F.lit("stable_only")),
        F.when(F.col("status") != "unstable", F.lit("non_unstable")),
        F.when(F.col("comparable") == "comparable", F.lit("comparable_only"))))
    rows = long.where(~F.col("warned")).withColumn("subset", F.explode(subsets))
    return metric_summary(rows, [arm, "subset"])


def arm_savings(summary: DataFrame, by: Sequence[str], arm: str, full: str, adaptive: str) -> DataFrame:
    """Adaptive against full, per metric: both means and the saving in percent."""
    mean = lambda a: F.max(F.when(F.col(arm) == a, F.col("mean")))
    out = summary.groupBy(*by, "metric").agg(mean(full).alias("full_mean"), mean(adaptive).alias("adaptive_mean"))
    return out.withColumn("saved_pct", pct_saved(F.col("full_mean"), F.col("adaptive_mean")))


def confidence_warnings(summary: DataFrame, by: Sequence[str], kind: str = "latency", minimum: int = 8) -> DataFrame:
    """Warning codes from the arms' sample counts and trim points (``count``, ``trim_start``)."""
    lo, hi = F.min("count"), F.max("count")
    spread = F.max("trim_start") - F.min("trim_start")
    latency = F.lit(kind == "latency")
    warnings = F.array_compact(F.array(
        F.when(lo < minimum, F.lit("low_confidence")),
        F.when(latency & (lo > 0) & (hi >= 2 * lo), F.lit("count_mismatch")),
        F.when(latency & (hi != lo), F.lit("unequal_counts")),
        F.when(latency & (spread > 1.0), F.lit("trim_misaligned"))))
    return summary.groupBy(*by).agg(lo.alias("min_count"), hi.alias("max_count"), F.array_join(warnings, ",").alias("warnings"))


def phase_deltas(phases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every phase against the first baseline phase of its run."""
    by = list(by)
    measures = ("monitor_cpu_s", "workload_cpu_s", "wall_s", "throughput_hz", "probe_reads", "mean_read_ns")
    rows = phases.withColumn("throughput_hz", F.when(F.col("wall_s") > 0, F.col("operations") / F.col("wall_s")))
    base = rows.where(F.col("monitoring_mode") == "baseline").groupBy(*by).agg(
        F.min_by(F.struct(*measures), "phase_index").alias("b"))
    d = lambda m: (F.col(m) - F.col(f"b.{m}")).alias(f"{m}_delta")
    return rows.join(base, by).select(
        *by, "label", "repeat_index", d("monitor_cpu_s"), d("workload_cpu_s"), d("wall_s"),
        pct_change(F.col("b.throughput_hz"), F.col("throughput_hz")).alias("throughput_delta_pct"), d("probe_reads"), d("mean_read_ns"))


def sweep_cost(sweeps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and p99 sweep time in microseconds, CPU share of wall time."""
    t = F.col("sweep_ns").cast("double")
    return group_stats(sweeps, by, [
        (F.avg(t) / 1000.0).alias("mean_sweep_us"),
        F.when(F.max("wall_s") > 0, (F.max("user_cpu_s") + F.max("system_cpu_s")) / F.max("wall_s") * 100.0).otherwise(0.0).alias("monitoring_cpu_pct")],
        {"__p99": (t, 0.99)}).withColumn("p99_sweep_us", F.col("__p99") / 1000.0).drop("__p99")


def numeric_leaves(kind: T.StructType, prefix: str = "") -> list[str]:
    out: list[str] = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += numeric_leaves(f.dataType, f"{prefix}{f.name}.")
        elif isinstance(f.dataType, T.NumericType):
            out.append(prefix + f.name)
    return out


def flatten_report(reports: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``by…, metric, value``: every numeric leaf of a nested report under its dotted path."""
    leaves = numeric_leaves(reports.schema[column].dataType)
    pairs = F.array(*[F.struct(F.lit(p).alias("metric"), F.col(f"{column}.{p}").cast("double").alias("value")) for p in leaves])
    return reports.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")


def evaluation_row(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """One wide metric row per run report, with the documented fallback chains.

    A missing loop mean is the sum of its parts (all of them known), a missing CPU total is the
    cumulative maximum or user + system, urgency prefers the scheduler's value. Only NULL counts as missing.
    """
    mean = lambda c: F.col(f"overhead_summary.{c}.mean")
    top = lambda c: F.col(f"overhead_summary.{c}.max")
    needed = [mean(c) for c in COMPONENTS[:4]]
    parts = sum(needed[1:], needed[0]) + F.coalesce(mean("emit_overhead_us"), F.lit(0.0))
    split = F.when(F.coalesce(top("user_cpu_s"), top("system_cpu_s")).isNotNull(),
                   F.coalesce(top("user_cpu_s"), F.lit(0.0)) + F.coalesce(top("system_cpu_s"), F.lit(0.0)))
    return reports.select(
        *by, F.coalesce("sampling_summary.sample_ratio", F.lit(1.0)).alias("live_sample_ratio"),
        F.coalesce("sampling_summary.max_gap", F.lit(1.0)).alias("live_max_gap"),
        F.coalesce(F.col("cpu_normalization.mean_cpu_pct_over_wall"), mean("monitor_cpu_pct")).alias("mean_cpu_pct"),
        F.coalesce(F.col("cpu_normalization.total_cpu_s"), top("total_cpu_s"), split).alias("total_cpu_s"),
        F.coalesce("scheduler_summary.mean_urgency", "sampling_summary.mean_urgency").alias("mean_urgency"),
        F.coalesce(mean("active_loop_us"), parts).alias("active_mean_us"),
        F.coalesce(F.col("cost_accounting.probe_fetch_mean_us"), mean("read_overhead_us")).alias("probe_fetch_mean_us"))
