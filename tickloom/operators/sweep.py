"""Sweeps: many configurations or policies over many traces, and their analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import descending
from tickloom.operators.fidelity import info_loss, mask_report, peak_ranks, running_ratio
from tickloom.operators.masks import fixed_interval, n_of_m, shortest_period, thin_evenly
from tickloom.operators.replay import replay
from tickloom.operators.scans import group_stats, percentiles, running_max, running_min, scan, with_size
from tickloom.params import MAPPING_ABLATION, config_frame, config_label, make_config
from tickloom.session import cut, is_small

# Parameters that change the dense tracker itself.
TRACKER_PARAMS = ("alpha_base", "beta", "outlier_threshold", "drift_tolerance", "initial_variance_floor")
PHASES_TOGETHER = 8  # phases of a budget that one row of a scan holds
# Sweep metrics for which more is better.
HIGHER_IS_BETTER = ("peak_recall_top5", "correlation", "coverage_3sigma", "recall_top5")


def dense_references(trace: DataFrame, configs: Sequence[dict], by: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Dense tracks of the distinct tracker settings, and each configuration's setting."""
    distinct: dict[tuple, int] = {}
    owner = [distinct.setdefault(tuple(c[p] for p in TRACKER_PARAMS), len(distinct)) for c in configs]
    settings = [make_config(**dict(zip(TRACKER_PARAMS, key))) for key in distinct]
    dense = replay(trace, settings, "dense", by).withColumnRenamed("config_id", "dense_id")
    return dense, owner


def evaluate(trace: DataFrame, configs: Sequence[dict], policy: str = "urgency_adaptive",
             by: Sequence[str] = ("series_id",), aux: Sequence[str] = ()) -> DataFrame:
    """Information-loss report of every (series, configuration)."""
    by = list(by)
    dense, owner = dense_references(trace, configs, by)
    kept = replay(trace, configs, policy, by, aux)
    dense_id = F.element_at(F.array(*[F.lit(i) for i in owner]), F.col("config_id") + 1)
    return info_loss(dense, kept.withColumn("dense_id", dense_id), by + ["dense_id"], by + ["config_id"])


def describe(reports: DataFrame, configs: Sequence[dict], params: Sequence[str]) -> DataFrame:
    """Report rows with their parameter values and a compact label."""
    table = config_frame(reports.sparkSession, list(configs))
    shown = table.select("config_id", *params, config_label(params).alias("config_label"))
    return reports.join(F.broadcast(shown), "config_id")  # one row per configuration of the driver's list


def mapping_ablation(trace: DataFrame, config: dict, by: Sequence[str] = ("series_id",)) -> tuple[DataFrame, list[dict]]:
    """Fixed-urgency replays of the eight mappings over one shared urgency trace."""
    shared = replay(trace, [config], "always_sample", by).select(*by, "tick", "value", "urgency")
    configs = [{**config, **m} for m in MAPPING_ABLATION]
    return replay(shared, configs, "scheduled_urgency", by, ("urgency",)), configs


def interval_profiles(played: DataFrame, by: Sequence[str], points: int) -> DataFrame:
    """Interval and cumulative ratio over time, thinned evenly."""
    wide = with_size(running_ratio(played, by), by, "__n")
    return thin_evenly(wide, F.col("__n"), points, F.col("tick")).select(*by, "tick", "interval", "ratio_so_far")


def phase_masks(trace: DataFrame, budgets: DataFrame, by: Sequence[str], together: int = 0) -> DataFrame:
    """Every phase of each series' n-of-m budget as a mask (m is at most the period limit).

    With ``together``, a row holds an array of so many masks (the last one of a series fewer), from that of ``phase`` on.
    """
    plans = budgets.where(F.col("m").isNotNull()).select(*by, "n", "m")
    phased = trace.join(plans, list(by)).withColumn(
        "phase", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(together or 1))))
    mask = lambda phase: n_of_m(F.col("tick"), F.col("n"), F.col("m"), phase)
    if together:
        last = F.least(F.col("phase") + together, F.col("m")) - 1
        return phased.withColumn("sampled", F.transform(F.sequence(F.col("phase"), last), mask))
    return phased.withColumn("sampled", mask(F.col("phase")))


def budget_comparison(trace: DataFrame, config: dict, by: Sequence[str] = ("series_id",),
                      tolerance: float = 0.001, max_period: int = 128, kept: DataFrame | None = None) -> DataFrame:
    """Per series: the adaptive ratio, the reciprocal fixed interval and the n-of-m budget.

    ``kept``: the adaptive replay of the trace, where it is there already.
    """
    if kept is None:
        kept = replay(trace, [config], "urgency_adaptive", by)
    ratio = kept.groupBy(*by).agg(F.avg(F.when(F.col("sampled"), 1.0).otherwise(0.0)).alias("sample_ratio"))
    return shortest_period(ratio.withColumn("fixed_interval", fixed_interval(F.col("sample_ratio"))),
                           "sample_ratio", tolerance, max_period)


def two_pass(trace: DataFrame, config: dict, by: Sequence[str] = ("series_id",),
             policies: Sequence[str] = ("wavelet_rate", "predictive_frequency", "robust_exponential", "time_or_variation"),
             tolerance: float = 0.001) -> DataFrame:
    """Adaptive, fixed-interval, budget-matched and literature samplers in one table."""
    by = list(by)
    methods = by + ["method", "variant"]
    small = is_small(trace, by)  # a scan below holds no more rows of a key than the trace has
    # All masks are over the same ticks. Peaks are ranked once a series and written, as every sampler reads these rows.
    ranked = cut(peak_ranks(trace.select(*by, "tick", F.col("value").cast("double")), by))
    # read twice: as a mask, and for the budgets
    adaptive = cut(replay(ranked, [config], "urgency_adaptive", by, small=small).select(*by, "tick", "value", "sampled"))
    masks = adaptive.withColumn("method", F.lit("adaptive"))
    for name in policies:
        played = replay(ranked, [config], name, by, small=small).select(*by, "tick", "value", "sampled")
        masks = masks.unionByName(played.withColumn("method", F.lit(name)))
    if not small:  # one window a key ranks rows where they are; row ranges would sort them once more
        ranks = ranked.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate([*by, "tick"])], "peak_rank", "n_ticks")
        match = F.lit(True)
        for i, k in enumerate([*by, "tick"]):
            match = match & masks[k].eqNullSafe(ranks[f"__r{i}"])
        masks = masks.join(ranks.hint("merge"), match)
    columns = [c for c in [*by, "method", "tick", "value", "sampled", "peak_rank", "n_ticks"] if c in masks.columns]
    rows = masks.select(*columns).withColumn("variant", F.lit(0))
    budgets = cut(budget_comparison(trace, config, by, tolerance, kept=adaptive))  # one row a series
    fixed = ranked.join(budgets.select(*by, "fixed_interval"), by).withColumn("method", F.lit("fixed_interval")).withColumn(
        "sampled", F.pmod(F.col("tick"), F.col("fixed_interval")) == 0)
    rows = rows.unionByName(fixed.select(*columns).withColumn("variant", F.lit(0)))
    blocks = phase_masks(ranked, budgets, by, PHASES_TOGETHER).withColumn("method", F.lit("budget_matched")).withColumn(
        "variant", F.col("phase"))
    return mask_report(rows, methods, small=small).unionByName(mask_report(blocks, methods, PHASES_TOGETHER, small))


def envelope_sweep(trace: DataFrame, config: dict, min_intervals: Sequence[int], max_interval: int = 20,
                   by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Samplers under common interval envelopes, with the fixed end points."""
    by = list(by)
    bounded = [{**config, "min_interval": lo, "max_interval": max_interval} for lo in min_intervals]
    blocks = [{**c, "envelope_min": c["min_interval"], "envelope_max": max_interval} for c in bounded]
    parts = [("urgency_adaptive", "urgency_adaptive", bounded), ("wavelet_rate", "wavelet_rate", blocks),
             ("robust_exponential", "robust_exponential", bounded)]
    out = None
    lows = F.array(*[F.lit(i) for i in min_intervals])
    for method, policy, configs in parts:
        played = replay(trace, configs, policy, by).withColumn("method", F.lit(method))
        out = played if out is None else out.unionByName(played)
    out = out.withColumn("min_interval", F.element_at(lows, F.col("config_id") + 1))
    rows = out.select(*by, "method", "min_interval", "tick", "value", "sampled")
    # equal bounds are a fixed interval, which needs no replay
    ends = trace.select(*by, "tick", "value", F.explode(lows).alias("min_interval"))
    for method, interval in (("fixed_slow_boundary", F.lit(max_interval)), ("fixed_fast_boundary", F.col("min_interval"))):
        fixed = ends.withColumn("method", F.lit(method)).withColumn("sampled", F.pmod(F.col("tick"), interval) == 0)
        if method == "fixed_fast_boundary":  # where both ends are the same, one of them is enough
            fixed = fixed.where(F.col("min_interval") != max_interval)
        rows = rows.unionByName(fixed.select(*rows.columns))
    return mask_report(rows, [*by, "method", "min_interval"])


def periodic_points(points: DataFrame, by: Sequence[str], max_interval: int) -> DataFrame:
    """One fixed-interval point per interval: the fast boundary, and the slow one where both meet."""
    rows = points.where((F.col("method") == "fixed_fast_boundary") | (
        (F.col("method") == "fixed_slow_boundary") & (F.col("min_interval") == max_interval)))
    last = F.max_by(F.struct(*[F.col(c) for c in points.columns]), F.col("method"))
    return rows.groupBy(*by, "min_interval").agg(last.alias("r")).select("r.*")


def weighted_reports(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reports of several members pooled by their number of readings."""
    w = F.col("n_total")
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum(w).alias("n_points"),
        (F.sum("n_sampled") / F.sum(w)).alias("sample_ratio"), mean("raw_recon_nrmse"), mean("nrmse_mean"),
        mean("peak_recall_top5"), mean("mean_gap"), mean("p95_gap"), F.max("max_gap").alias("max_gap"))


def candidate_replay(trace: DataFrame, candidates: Sequence[dict], run: Sequence[str], member: str) -> DataFrame:
    """Candidates on recorded fleets: pooled over members, then mean and deviation over runs."""
    reports = evaluate(trace, candidates, by=[*run, member])
    pooled = weighted_reports(reports, [*run, "config_id"])
    return pooled.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("runs"),
        *[x for c in ("sample_ratio", "raw_recon_nrmse", "nrmse_mean", "peak_recall_top5") for x in (
            F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_stdev"))])


# --- analysis of sweep results ----------------------------------------------------------

def unpivot_params(sweep: DataFrame, params: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep…, param, param_value``: one row per parameter of a sweep row."""
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("param_value")) for p in params])
    return sweep.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def marginal_effect(sweep: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    """Quartiles of the metric for every value of every parameter."""
    long = unpivot_params(sweep, params, [metric])
    return percentiles(long, ["param", "param_value"], F.col(metric), {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def parameter_importance(sweep: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    """Between-group share of the metric's variance; parameters with one value are left out."""
    groups = unpivot_params(sweep, params, [metric]).groupBy("param", "param_value").agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("m"), F.sum(F.col(metric) * F.col(metric)).alias("q"))
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / n - (total / n) * (total / n)
    overall = F.sum("q") / n - (total / n) * (total / n)
    return groups.groupBy("param").agg(
        F.count(F.lit(1)).alias("__values"), F.when(overall > 1e-18, between / overall).alias("importance")).where(
        (F.col("__values") >= 2) & F.col("importance").isNotNull()).drop("__values")


def median_heatmap(sweep: DataFrame, px: str, py: str, metric: str) -> DataFrame:
    """Median per cell of two parameters, with both margins (NULL = all values)."""
    both = sweep.select(metric, F.explode(F.array(*[
        F.struct(x.cast("double").alias("px"), y.cast("double").alias("py"))
        for x in (F.col(px), F.lit(None)) for y in (F.col(py), F.lit(None))])).alias("c")).select(metric, "c.*")
    return percentiles(both, ["px", "py"], F.col(metric), {"median": 0.5})


def pareto_frontier(sweep: DataFrame, x: str, y: str, bins: int = 45, by: Sequence[str] = ()) -> DataFrame:
    """Binned frontier: median x, best y and the running best in the direction of cost."""
    by = list(by)
    ends = sweep.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    rows = sweep.join(ends, by) if by else sweep.withColumn("__one", F.lit(1)).join(
        ends.withColumn("__one", F.lit(1)), "__one").drop("__one")
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.floor((F.col(x) - F.col("__lo")) / width)).otherwise(bins - 1)
    binned = rows.withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int"))
    up_y, up_x = y in HIGHER_IS_BETTER, x in HIGHER_IS_BETTER
    best = (F.max if up_y else F.min)(y).alias("best_y")
    cells = group_stats(binned, [*by, "bin"], [best], {"x_median": (F.col(x), 0.5)})
    order = descending("bin") if up_x else F.col("bin")
    running = (running_max if up_y else running_min)(F.col("best_y"))
    return scan(cells, by, [order], {"running_best": running}, small=True)  # at most ``bins`` rows per key


def budget_match(candidates: DataFrame, targets: DataFrame, by: Sequence[str], slack: float = 0.05) -> DataFrame:
    """Smallest ratio in [target, target + slack] per key (ties by sweep index), and the nearest around.

    ``candidates``: by…, sweep_index, sample_ratio; ``targets``: by…, target.
    """
    if slack < 0:
        raise ValueError("slack must not be negative")
    by = list(by)
    eps = 1e-12
    r, t = F.col("sample_ratio"), F.col("target")
    pick = F.struct("sample_ratio", "sweep_index")
    inside, below, above = (r >= t - eps) & (r <= t + slack + eps), r < t - eps, r >= t - eps
    out = candidates.join(targets, by).groupBy(*by).agg(
        F.max("target").alias("target"), F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(inside, 1)).alias("n_in_band"),
        F.min(F.when(inside, pick)).alias("__in"),
        F.max(F.when(below, F.struct(r, -F.col("sweep_index")))).alias("__lo"), F.min(F.when(above, pick)).alias("__hi"))
    return out.select(
        *by, "target", "n_candidates", "n_in_band", F.col("__in.sweep_index").alias("selected_index"),
        F.col("__in.sample_ratio").alias("selected_ratio"), F.col("__lo.sample_ratio").alias("nearest_below"),
        F.col("__hi.sample_ratio").alias("nearest_above"))


def binned_overview(tracks: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Equal-width tick bins: value, urgency, sampling and mean-error statistics."""
    by = list(by)
    wide = with_size(running_ratio(tracks, by), by, "__n")
    # bin b covers ticks [floor(n b / bins), floor(n (b + 1) / bins))
    guess = F.floor((F.col("tick") + 1) * bins / F.col("__n"))
    edge = lambda b: F.floor(F.col("__n") * b / bins)
    b = F.when(edge(guess) > F.col("tick"), guess - 1).otherwise(guess)
    err = F.abs(F.col("full_mean") - F.col("est_mean"))
    return wide.withColumn("bin", b.cast("int")).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("value_mean"), F.stddev_pop("value").alias("value_std"),
        F.avg("urgency").alias("urgency_mean"), F.max("urgency").alias("urgency_max"),
        F.avg(F.when(F.col("sampled"), 1.0).otherwise(0.0)).alias("sample_ratio"),
        F.max_by("ratio_so_far", "tick").alias("cumulative_ratio"),
        F.avg(err).alias("error_mean"), F.max(err).alias("error_max"))


def phase_summary(reports: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population deviation, min and max of every metric over all phases."""
    long = reports.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("p")).select(*by, "p.*")
    return long.groupBy(*by, "metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def selected_run_summary(reports: DataFrame, selected: DataFrame, workload: str, repeat: str, metrics: Sequence[str]) -> DataFrame:
    """Per-run metrics of the selected repeats, summarised per workload."""
    chosen = reports.join(selected.select(workload, repeat), [workload, repeat], "left_semi")
    return phase_summary(chosen, [workload], metrics)
