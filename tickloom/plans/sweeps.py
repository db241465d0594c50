"""Queries: sweeps, budgets, envelopes and the analysis of sweep results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import fidelity as fd
from tickloom.operators import sweep as sw
from tickloom.operators.masks import n_of_m
from tickloom.operators.reconstruct import hold_masks
from tickloom.operators.replay import n_of_m_replay, replay
from tickloom.params import grid, make_config, with_configs
from tickloom.plans.fidelity import CFG, TRACKS, kept_events, rounded, tracks
from tickloom.plans.registry import q6, query
from tickloom.plans.shaping import mapping_sql
from tickloom.plans.sqltext import (D, EVENTS, MASKED, USERS, corr, efficiency, interpolated, masked_tracker, sampler, span, tracker)
from tickloom.session import reuse
from tickloom.sources.tables import event_trace, user_trace

ERR = "abs(full_mean - est_mean)"
SERR = "abs(full_std - est_std)"


def report_sql(kept: str, dense: str, keys: str, dense_on: str) -> str:
    """CTEs ending in ``report``: the information-loss columns per ``keys``."""
    ks = [k.strip() for k in keys.split(",")]
    return f"""{interpolated('est', kept, keys, {'est_mean': 'mean', 'est_std': 'std', 'recon': 'value'})},
tracks AS (SELECT e.*, d.mean AS full_mean, sqrt(d.var) AS full_std FROM est e JOIN {dense} d ON {dense_on} AND d.tick = e.tick),
eff AS ({efficiency(kept, keys)}),
err AS (SELECT {keys}, {q6(f'avg({ERR})')} AS mae_mean, {q6(f'sqrt(avg({ERR} * {ERR}))')} AS rmse_mean,
  {q6(f'sqrt(avg({ERR} * {ERR})) / {span()}')} AS nrmse_mean, {q6(f'max({ERR})')} AS max_mean_error, {q6(corr('full_mean', 'est_mean'))} AS correlation,
  {q6('sqrt(avg((value - recon) * (value - recon)))')} AS raw_recon_rmse, {q6(f'sqrt(avg((value - recon) * (value - recon))) / {span()}')} AS raw_recon_nrmse,
  {q6(f'avg({SERR})')} AS mae_std, {q6(f'sqrt(avg({SERR} * {SERR}))')} AS rmse_std,
  {q6('avg(CASE WHEN value >= est_mean - 3 * est_std AND value <= est_mean + 3 * est_std THEN 1.0 ELSE 0.0 END)')} AS coverage_3sigma,
  {', '.join(q6(f'quantile_cont({ERR}, {p})') + f' AS p{round(p * 100)}_error' for p in (0.5, 0.9, 0.95, 0.99))} FROM tracks GROUP BY {keys}),
pk AS (SELECT {keys}, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS peak_recall_top5 FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(value) DESC, tick) AS rk, count(*) OVER (PARTITION BY {keys}) AS n FROM {kept})
  WHERE rk <= greatest(1, n // 20) GROUP BY {keys}),
report AS (SELECT * FROM eff JOIN err USING ({keys}) JOIN pk USING ({keys}))"""


POLL_COLS = "series_id, tick, value, sampled, interval, urgency, status, mean, std"
GRID = [(t, h) for t in (1.0, 3.0) for h in (10, 20)]
SWEEP = f"""WITH RECURSIVE {USERS}, {tracker('dense0', 'trace', threshold=1.0)}, {tracker('dense1', 'trace', threshold=3.0)},
{', '.join(sampler(f'poll{i}', 'trace', threshold=t, hi=h) for i, (t, h) in enumerate(GRID))},
dense AS (SELECT 0 AS dense_id, series_id, tick, mean, var FROM dense0 UNION ALL SELECT 1, series_id, tick, mean, var FROM dense1),
polls AS ({' UNION ALL '.join(f'SELECT {i} AS config_id, {i // 2} AS dense_id, {POLL_COLS} FROM poll{i}' for i in range(4))}),
{report_sql('polls', 'dense', 'series_id, config_id', 'd.series_id = e.series_id AND d.dense_id = e.dense_id')}"""
CONFIGS = [dict(outlier_threshold=t, max_interval=h) for t, h in GRID]


def grid_sweep(spark, d):
    return sw.evaluate(user_trace(spark, d), grid({"outlier_threshold": [1.0, 3.0], "max_interval": [10, 20]}))


LABELS = "CASE config_id WHEN 0 THEN 'outlier_threshold=1, max_interval=10' WHEN 1 THEN 'outlier_threshold=1, max_interval=20' WHEN 2 THEN 'outlier_threshold=3, max_interval=10' ELSE 'outlier_threshold=3, max_interval=20' END"


@query("swp01_grid_search", f"{SWEEP} SELECT *, {LABELS} AS config_label, CASE WHEN config_id < 2 THEN 1.0 ELSE 3.0 END::DOUBLE AS outlier_threshold, CASE WHEN config_id % 2 = 0 THEN 10 ELSE 20 END AS max_interval FROM report")
def swp01(spark, d):
    configs = grid({"outlier_threshold": [1.0, 3.0], "max_interval": [10, 20]})
    return rounded(sw.describe(grid_sweep(spark, d), configs, ["outlier_threshold", "max_interval"]))


@query("swp02_configuration_list", f"""WITH RECURSIVE {USERS}, {tracker('dense0', 'trace', threshold=2.0)}, {tracker('dense1', 'trace', threshold=3.0, floor=1.0)},
{sampler('poll0', 'trace', threshold=2.0, warmup=8)}, {sampler('poll1', 'trace', threshold=3.0, floor=1.0, lo=2, hi=12, positive_only=True)},
dense AS (SELECT 0 AS dense_id, series_id, tick, mean, var FROM dense0 UNION ALL SELECT 1, series_id, tick, mean, var FROM dense1),
polls AS (SELECT 0 AS config_id, 0 AS dense_id, {POLL_COLS} FROM poll0 UNION ALL SELECT 1, 1, {POLL_COLS} FROM poll1),
{report_sql('polls', 'dense', 'series_id, config_id', 'd.series_id = e.series_id AND d.dense_id = e.dense_id')} SELECT * FROM report""")
def swp02(spark, d):
    configs = [make_config(outlier_threshold=2.0, warmup=8),
               make_config(outlier_threshold=3.0, initial_variance_floor=1.0, min_interval=2, max_interval=12, warmup_positive_std_only=True)]
    return rounded(sw.evaluate(user_trace(spark, d), configs))


EIGHT = [("original_interval", {}), ("smoothstep_interval", {}), ("geometric_rate", {}), ("exponential_ease_out_rate", {}),
         ("power_rate", {"p": "0.5::DOUBLE"}), ("power_rate", {"p": "2.0::DOUBLE"}), ("logistic_rate", {"mid": "0.4::DOUBLE", "steep": "12.0::DOUBLE"}),
         ("logistic_rate", {"mid": "0.6::DOUBLE", "steep": "12.0::DOUBLE"})]
ABLATION = f"""WITH RECURSIVE {USERS}, {sampler('feed', 'trace', mode='feed', threshold=3.0)},
plan AS ({' UNION ALL '.join(f"SELECT {i} AS config_id, series_id, tick, value, urgency, {mapping_sql(n, **kw)} AS interval FROM (SELECT *, urgency AS u FROM feed)" for i, (n, kw) in enumerate(EIGHT))}),
walk AS (SELECT series_id, config_id, tick, value, urgency, interval, TRUE AS sampled, 0 AS steps FROM plan WHERE tick = 0
  UNION ALL SELECT p.series_id, p.config_id, p.tick, p.value, p.urgency, p.interval, w.steps + 1 >= p.interval, CASE WHEN w.steps + 1 >= p.interval THEN 0 ELSE w.steps + 1 END
  FROM walk w JOIN plan p ON p.series_id = w.series_id AND p.config_id = w.config_id AND p.tick = w.tick + 1)"""


@query("swp03_mapping_ablation", f"""{ABLATION}, {tracker('dense', 'trace', threshold=3.0)}, {masked_tracker('seen', 'walk', 'series_id, config_id', threshold=3.0)},
{report_sql('seen', 'dense', 'series_id, config_id', 'd.series_id = e.series_id')} SELECT * FROM report""")
def swp03(spark, d):
    trace = user_trace(spark, d)
    kept, configs = sw.mapping_ablation(trace, make_config(**CFG))
    dense = replay(trace, [make_config(**CFG)], "dense").drop("config_id")
    return rounded(fd.info_loss(dense, kept))


@query("swp04_interval_profiles", f"""{ABLATION}, n AS (SELECT series_id, count(*) AS n FROM trace GROUP BY 1),
keep AS (SELECT DISTINCT series_id, CAST(CASE WHEN n <= 20 THEN i ELSE floor(i * (n - 1) / 19.0{D}) END AS BIGINT) AS tick FROM (SELECT *, unnest(range(20)) AS i FROM n))
SELECT series_id, config_id, tick, interval, {q6('kept / (tick + 1)::DOUBLE')} AS ratio_so_far FROM (
  SELECT *, sum(CASE WHEN sampled THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, config_id ORDER BY tick) AS kept FROM walk) JOIN keep USING (series_id, tick)""")
def swp04(spark, d):
    kept, _ = sw.mapping_ablation(user_trace(spark, d), make_config(**CFG))
    return rounded(sw.interval_profiles(kept, ["series_id", "config_id"], 20))


RATIO = f"""WITH RECURSIVE {EVENTS}, {sampler('poll', 'trace', threshold=3.0)},
ratio AS (SELECT series_id, avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END) AS sample_ratio FROM poll GROUP BY 1),
tried AS (SELECT series_id, sample_ratio, m, least(m, greatest(1, CAST(floor(sample_ratio * m + 0.5) AS INTEGER))) AS k FROM (SELECT *, unnest(range(1, 129)) AS m FROM ratio)),
best AS (SELECT series_id, min_by(k, m) AS k, min(m) AS m FROM tried WHERE abs(k / m::DOUBLE - sample_ratio) <= 0.01 + 1e-12 GROUP BY 1),
budget AS (SELECT r.series_id, sample_ratio, CAST(greatest(1, floor(1.0 / sample_ratio + 0.5)) AS INTEGER) AS fixed_interval, CAST(k / gcd(k, m) AS INTEGER) AS n, CAST(m / gcd(k, m) AS INTEGER) AS m
  FROM ratio r LEFT JOIN best USING (series_id))"""


@query("top06_shortest_period", f"{RATIO} SELECT series_id, {q6('sample_ratio')} AS sample_ratio, fixed_interval, n, m FROM budget")
def top06(spark, d):
    return rounded(sw.budget_comparison(event_trace(spark, d), make_config(**CFG), tolerance=0.01))


@query("swp05_budget_phase_masks", f"""{RATIO}, masks AS (SELECT t.series_id, phase, tick, value, (tick * n + phase) % m < n AS sampled FROM trace t JOIN (SELECT *, unnest(range(m)) AS phase FROM budget) USING (series_id))
SELECT series_id, CAST(phase AS INTEGER) AS phase, count(*) AS n_total, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_sampled, {q6('sum(CASE WHEN sampled THEN value END)')} AS kept_sum FROM masks GROUP BY 1, 2""")
def swp05(spark, d):
    trace = event_trace(spark, d)
    masks = sw.phase_masks(trace, sw.budget_comparison(trace, make_config(**CFG), tolerance=0.01), ["series_id"])
    take = F.col("sampled")
    return rounded(masks.groupBy("series_id", "phase").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.when(take, 1).otherwise(0)).alias("n_sampled"),
        F.sum(F.when(take, F.col("value"))).alias("kept_sum")))


@query("swp05_two_pass_comparison")
def swp05_all(spark, d):
    return rounded(sw.two_pass(event_trace(spark, d), make_config(**CFG), tolerance=0.01))


@query("swp06_common_envelope_sweep")
def swp06(spark, d):
    return rounded(sw.envelope_sweep(user_trace(spark, d), make_config(**CFG), [20, 10, 5, 2, 1]))


@query("set04_periodic_points")
def set04(spark, d):
    points = sw.envelope_sweep(user_trace(spark, d), make_config(**CFG), [20, 10, 5])
    return rounded(sw.periodic_points(points, ["series_id"], 20)).select("series_id", "min_interval", "sample_ratio", "recall_top5")


FLEET = f"""fleet AS (SELECT CAST(user_id % 5 AS BIGINT) AS run, CAST(user_id AS VARCHAR) AS pod, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, value FROM events)"""


def fleet(spark, d):
    t = user_trace(spark, d)
    return t.select((F.col("series_id").cast("long") % 5).alias("run"), F.col("series_id").alias("pod"), "tick", "value")


CANDIDATES = f"""WITH RECURSIVE {FLEET}, {tracker('dense0', 'fleet', 'run, pod', threshold=3.0)},
{sampler('poll0', 'fleet', 'run, pod', threshold=3.0)}, {sampler('poll1', 'fleet', 'run, pod', threshold=3.0, hi=10)},
dense AS (SELECT run, pod, tick, mean, var FROM dense0),
polls AS (SELECT 0 AS config_id, run, pod, tick, value, sampled, mean, std FROM poll0 UNION ALL SELECT 1, run, pod, tick, value, sampled, mean, std FROM poll1),
{report_sql('polls', 'dense', 'run, pod, config_id', 'd.run = e.run AND d.pod = e.pod')},
pooled AS (SELECT run, config_id, count(*) AS n_members, CAST(sum(n_total) AS BIGINT) AS n_points, sum(n_sampled) / sum(n_total)::DOUBLE AS sample_ratio,
  {', '.join(f'sum({c} * n_total) / sum(n_total) AS {c}' for c in ('raw_recon_nrmse', 'nrmse_mean', 'peak_recall_top5', 'mean_gap', 'p95_gap'))}, max(max_gap) AS max_gap FROM report GROUP BY 1, 2)"""
CAND = [make_config(**CFG), make_config(**CFG, max_interval=10)]


def r4(expr: str) -> str:
    return f"(round_even({expr} * 1e4 + 1e-2, 0) / 1e4 + 0.0)"


def round4(df):
    return df.select(*[(F.rint(F.col(c) * 1e4 + 1e-2) / 1e4 + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("swp07_candidate_replay", f"""{CANDIDATES} SELECT config_id, count(*) AS runs, {', '.join(f"{r4(f'avg({c})')} AS {c}_mean, {r4(f'coalesce(stddev_samp({c}), 0)')} AS {c}_stdev" for c in ('sample_ratio', 'raw_recon_nrmse', 'nrmse_mean', 'peak_recall_top5'))}
FROM pooled GROUP BY 1""")
def swp07(spark, d):
    return round4(sw.candidate_replay(fleet(spark, d), CAND, ["run"], "pod"))


@query("agg36_length_weighted_fleet_means", f"""{CANDIDATES} SELECT run, config_id, n_members, n_points, {', '.join(f"{r4(c)} AS {c}" for c in ('sample_ratio', 'raw_recon_nrmse', 'nrmse_mean', 'peak_recall_top5', 'mean_gap', 'p95_gap'))}, max_gap FROM pooled""")
def agg36(spark, d):
    reports = sw.evaluate(fleet(spark, d), CAND, by=["run", "pod"])
    return round4(sw.weighted_reports(reports, ["run", "config_id"]))


@query("swp09_n_of_m_against_dense", f"""WITH RECURSIVE {EVENTS}, {MASKED}, {tracker('dense', 'trace', threshold=3.0)}, {masked_tracker('seen', 'kept', threshold=3.0)},
{report_sql('seen', 'dense', 'series_id', 'd.series_id = e.series_id')} SELECT * FROM report""")
def swp09(spark, d):
    trace, cfg = event_trace(spark, d), make_config(**CFG)
    dense = replay(trace, [cfg], "dense").drop("config_id")
    return rounded(fd.info_loss(dense, n_of_m_replay(trace, cfg, 2, 5).drop("config_id"), ["series_id"], ["series_id"]))


@query("joi12_series_by_configuration", f"""WITH {USERS} SELECT series_id, count(*) AS ticks, c AS config_id, CASE WHEN c < 2 THEN 1.0 ELSE 3.0 END::DOUBLE AS outlier_threshold, CASE WHEN c % 2 = 0 THEN 10 ELSE 20 END AS max_interval FROM trace, (SELECT CAST(unnest(range(4)) AS INTEGER) AS c) GROUP BY ALL""")
def joi12(spark, d):
    sizes = user_trace(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("ticks"))
    return with_configs(sizes, grid({"outlier_threshold": [1.0, 3.0], "max_interval": [10, 20]})).select(
        "series_id", "ticks", "config_id", "outlier_threshold", "max_interval")


@query("agg59_selected_run_summary", f"""WITH RECURSIVE {FLEET.replace('user_id % 5', 'user_id % 3')}, {tracker('dense', 'fleet', 'run, pod')}, {sampler('poll', 'fleet', 'run, pod', hi=10)},
{report_sql('poll', 'dense', 'run, pod', 'd.run = e.run AND d.pod = e.pod')},
chosen AS (SELECT r.* FROM report r WHERE pod NOT LIKE '%7'),
long AS (SELECT run, 'sample_ratio' AS metric, sample_ratio::DOUBLE AS v FROM chosen UNION ALL SELECT run, 'nrmse_mean', nrmse_mean FROM chosen UNION ALL SELECT run, 'max_gap', max_gap FROM chosen)
SELECT run, metric, count(v) AS n, {r4('avg(v)')} AS mean, {r4('stddev_pop(v)')} AS stdev, {r4('min(v)')} AS min, {r4('max(v)')} AS max FROM long GROUP BY 1, 2""")
def agg59(spark, d):
    t = user_trace(spark, d).select((F.col("series_id").cast("long") % 3).alias("run"), F.col("series_id").alias("pod"), "tick", "value")
    reports = sw.evaluate(t, [make_config(max_interval=10)], by=["run", "pod"])
    chosen = t.select("run", "pod").distinct().where(~F.col("pod").endswith("7"))
    return round4(sw.selected_run_summary(reports, chosen, "run", "pod", ["sample_ratio", "nrmse_mean", "max_gap"]))


@query("agg50_binned_overview", f"""{TRACKS}, n AS (SELECT series_id, count(*) AS n FROM trace GROUP BY 1), edges AS (SELECT series_id, CAST(b AS INTEGER) AS bin, n * b // 25 AS s, n * (b + 1) // 25 AS e FROM (SELECT *, unnest(range(25)) AS b FROM n)),
run AS (SELECT *, sum(CASE WHEN sampled THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY tick) / (tick + 1)::DOUBLE AS ratio FROM tracks)
SELECT t.series_id, bin, count(*) AS n, {q6('avg(value)')} AS value_mean, {q6('stddev_pop(value)')} AS value_std, {q6('avg(urgency)')} AS urgency_mean, {q6('max(urgency)')} AS urgency_max,
  {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS sample_ratio, {q6('max_by(ratio, tick)')} AS cumulative_ratio, {q6(f'avg({ERR})')} AS error_mean, {q6(f'max({ERR})')} AS error_max
FROM run t JOIN edges e ON e.series_id = t.series_id AND t.tick >= s AND t.tick < e.e GROUP BY 1, 2""")
def agg50(spark, d):
    return rounded(sw.binned_overview(tracks(spark, d), ["series_id"], 25))


# --- analysis over a table of mask results ---------------------------------------------------

SWEEP_SQL = f"""WITH {EVENTS}, masks AS (SELECT series_id, n, m, phase, tick, value, (tick * n + phase) % m < n AS sampled FROM trace, (SELECT unnest([1, 2, 3]) AS n), (SELECT unnest([5, 7, 9, 11]) AS m), (SELECT unnest([0, 1]) AS phase)),
held AS (SELECT *, coalesce(last_value(CASE WHEN sampled THEN value END IGNORE NULLS) OVER (PARTITION BY series_id, n, m, phase ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN sampled THEN value END IGNORE NULLS) OVER (PARTITION BY series_id, n, m, phase ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h,
  row_number() OVER (PARTITION BY series_id, n, m, phase ORDER BY abs(value) DESC, tick) AS rk, count(*) OVER (PARTITION BY series_id, n, m, phase) AS len FROM masks),
sweep AS (SELECT series_id, n, m, phase, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS sample_ratio, {q6(f'sqrt(avg((value - h) * (value - h))) / {span()}')} AS causal_nrmse,
  {q6('avg(CASE WHEN rk <= greatest(1, floor(len * 0.05::DOUBLE)) THEN CASE WHEN sampled THEN 1.0 ELSE 0.0 END END)')} AS recall_top5 FROM held GROUP BY 1, 2, 3, 4)"""
KEYS = ["series_id", "n", "m", "phase"]


def mask_sweep(spark, d):
    """Quality of 24 masks. Ranks are those of the series and the holds come from one scan, so rows are multiplied only
    for the sums, which Spark makes before it moves them."""
    masks = {(n, m, p): n_of_m(F.col("tick"), n, m, p) for n in (1, 2, 3) for m in (5, 7, 9, 11) for p in (0, 1)}
    name = "__held_{}_{}_{}".format
    ranked = fd.peak_ranks(event_trace(spark, d).select("series_id", "tick", "value"), ["series_id"])
    wide = hold_masks(ranked, ["series_id"], {name(*k): mask for k, mask in masks.items()})
    cells = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(KEYS[1:], k)], mask.alias("sampled"), F.col(name(*k)).alias("held"))
                      for k, mask in masks.items()])
    held = wide.select("series_id", "value", "peak_rank", "n_ticks", F.explode(cells).alias("c")).select(
        "series_id", "value", "peak_rank", "n_ticks", "c.*")
    off = F.col("value") - F.col("held")
    return reuse(rounded(held.groupBy(*KEYS).agg(
        F.avg(F.when(F.col("sampled"), 1.0).otherwise(0.0)).alias("sample_ratio"),
        (F.sqrt(F.avg(off * off)) / fd.signal_range(KEYS, F.col("value"))).alias("causal_nrmse"),
        F.avg(F.when(F.col("peak_rank") <= fd.top_count(0.05, F.col("n_ticks")), F.when(F.col("sampled"), 1.0).otherwise(0.0))).alias("recall_top5"))))


@query("agg51_marginal_effect", f"""{SWEEP_SQL}, long AS (SELECT 'n' AS param, n::DOUBLE AS param_value, recall_top5 FROM sweep UNION ALL SELECT 'm', m, recall_top5 FROM sweep)
SELECT param, param_value, {q6('quantile_cont(recall_top5, 0.25)')} AS p25, {q6('quantile_cont(recall_top5, 0.5)')} AS p50, {q6('quantile_cont(recall_top5, 0.75)')} AS p75 FROM long GROUP BY 1, 2""")
def agg51(spark, d):
    return rounded(sw.marginal_effect(mask_sweep(spark, d), ["n", "m"], "recall_top5"))


@query("agg52_parameter_importance", f"""{SWEEP_SQL}, long AS (SELECT 'n' AS param, n AS v, recall_top5 AS y FROM sweep UNION ALL SELECT 'm', m, recall_top5 FROM sweep UNION ALL SELECT 'phase', phase, recall_top5 FROM sweep),
g AS (SELECT param, v, count(*) AS k, avg(y) AS gm FROM long GROUP BY 1, 2), t AS (SELECT avg(recall_top5) AS mu, var_pop(recall_top5) AS tv FROM sweep)
SELECT param, {q6('sum(k * (gm - mu) * (gm - mu)) / sum(k) / any_value(tv)')} AS importance FROM g, t GROUP BY 1""")
def agg52(spark, d):
    return rounded(sw.parameter_importance(mask_sweep(spark, d), ["n", "m", "phase"], "recall_top5"))


@query("agg53_median_heatmap", f"{SWEEP_SQL} SELECT n::DOUBLE AS px, m::DOUBLE AS py, {q6('quantile_cont(causal_nrmse, 0.5)')} AS median FROM sweep GROUP BY CUBE (n, m)")
def agg53(spark, d):
    return rounded(sw.median_heatmap(mask_sweep(spark, d), "n", "m", "causal_nrmse"))


@query("agg54_pareto_frontier", f"""{SWEEP_SQL}, e AS (SELECT series_id, min(sample_ratio) AS lo, max(sample_ratio) AS hi FROM sweep GROUP BY 1),
b AS (SELECT series_id, sample_ratio, recall_top5, CAST(least(greatest(floor((sample_ratio - lo) / ((hi - lo) / 45)), 0), 44) AS INTEGER) AS bin FROM sweep JOIN e USING (series_id)),
c AS (SELECT series_id, bin, quantile_cont(sample_ratio, 0.5) AS x_median, max(recall_top5) AS best_y FROM b GROUP BY 1, 2)
SELECT series_id, bin, {q6('x_median')} AS x_median, best_y, max(best_y) OVER (PARTITION BY series_id ORDER BY bin) AS running_best FROM c""")
def agg54(spark, d):
    return rounded(sw.pareto_frontier(mask_sweep(spark, d), "sample_ratio", "recall_top5", by=["series_id"]), "best_y", "running_best")


@query("agg55_phase_summary", f"""{SWEEP_SQL}, long AS (SELECT n, m, 'sample_ratio' AS metric, sample_ratio AS v FROM sweep UNION ALL SELECT n, m, 'causal_nrmse', causal_nrmse FROM sweep UNION ALL SELECT n, m, 'recall_top5', recall_top5 FROM sweep)
SELECT n, m, metric, count(v) AS n_rows, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS stdev, {q6('min(v)')} AS min, {q6('max(v)')} AS max FROM long GROUP BY 1, 2, 3""")
def agg55(spark, d):
    sweep = mask_sweep(spark, d).withColumnsRenamed({"n": "kn", "m": "km"})
    out = sw.phase_summary(sweep, ["kn", "km"], ["sample_ratio", "causal_nrmse", "recall_top5"])
    return rounded(out.withColumnRenamed("n", "n_rows").withColumnsRenamed({"kn": "n", "km": "m"}))


@query("top03_sorted_sweep", f"{SWEEP_SQL} SELECT row_number() OVER (ORDER BY causal_nrmse, series_id, n, m, phase) - 1 AS place, * FROM sweep")
def top03(spark, d):
    from tickloom.operators.scans import number_rows
    return number_rows(mask_sweep(spark, d), [], ["causal_nrmse", *KEYS], "place")


@query("top05_budget_match", f"""{SWEEP_SQL}, c AS (SELECT series_id, (n * 100 + m * 2 + phase)::BIGINT AS sweep_index, sample_ratio, 0.2::DOUBLE AS target FROM sweep)
SELECT series_id, any_value(target) AS target, count(*) AS n_candidates, count(CASE WHEN sample_ratio >= target - 1e-12 AND sample_ratio <= target + 0.05 + 1e-12 THEN 1 END) AS n_in_band,
  min_by(sweep_index, CASE WHEN sample_ratio >= target - 1e-12 AND sample_ratio <= target + 0.05 + 1e-12 THEN (sample_ratio, sweep_index) END) AS selected_index,
  min(CASE WHEN sample_ratio >= target - 1e-12 AND sample_ratio <= target + 0.05 + 1e-12 THEN sample_ratio END) AS selected_ratio,
  max(CASE WHEN sample_ratio < target - 1e-12 THEN sample_ratio END) AS nearest_below, min(CASE WHEN sample_ratio >= target - 1e-12 THEN sample_ratio END) AS nearest_above FROM c GROUP BY 1""")
def top05(spark, d):
    s = mask_sweep(spark, d).select("series_id", (F.col("n") * 100 + F.col("m") * 2 + F.col("phase")).cast("long").alias("sweep_index"), "sample_ratio")
    targets = s.select("series_id").distinct().withColumn("target", F.lit(0.2))
    return sw.budget_match(s, targets, ["series_id"], 0.05)


@query("agg58_trace_stats", f"""WITH {EVENTS} SELECT series_id, count(*) AS n, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std, min(value) AS min, max(value) AS max FROM trace GROUP BY 1""")
def agg58(spark, d):
    return rounded(event_trace(spark, d).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")), "min", "max")


@query("set01_union_of_methods", f"""WITH {EVENTS}, {MASKED}
SELECT 'n_of_m' AS method, series_id, count(*) AS n_total, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_sampled FROM kept GROUP BY 2
UNION ALL SELECT 'every_fifth', series_id, count(*), CAST(sum(CASE WHEN tick % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM trace GROUP BY 2""")
def set01(spark, d):
    count = lambda df: df.groupBy("method", "series_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.when(F.col("sampled"), 1).otherwise(0)).alias("n_sampled"))
    a = kept_events(spark, d).withColumn("method", F.lit("n_of_m"))
    b = event_trace(spark, d).withColumn("sampled", F.col("tick") % 5 == 0).withColumn("method", F.lit("every_fifth"))
    return count(a.unionByName(b))
