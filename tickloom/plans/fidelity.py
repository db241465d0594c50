"""Queries: kept-tick quality, reconstruction, tracker comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import micros, r6
from tickloom.operators import fidelity as fd
from tickloom.operators.masks import n_of_m
from tickloom.operators.reconstruct import hold_last
from tickloom.operators.replay import replay
from tickloom.params import make_config
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import EVENTS, MASKED, corr, efficiency, interpolated, sampler, span, tracker
from tickloom.sources.tables import event_trace

BASE = f"WITH {EVENTS}, {MASKED}"


def kept_events(spark, folder):
    return event_trace(spark, folder).withColumn("sampled", n_of_m(F.col("tick"), 2, 5))


def rounded(df, *keep):
    """Round every double column that is not listed."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


RANKED = f"""{BASE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, tick) AS peak_rank,
         count(*) OVER (PARTITION BY series_id) AS n_ticks FROM kept)"""


@query("agg01_sampling_efficiency", f"{BASE} {efficiency('kept')}")
def agg01(spark, d):
    return rounded(fd.sampling_efficiency(kept_events(spark, d)))


@query("agg04_linear_reconstruction_error", f"""{BASE}, {interpolated('x', 'kept', 'series_id', {'recon': 'value'})}
SELECT series_id, {q6('sqrt(avg((value - recon) * (value - recon)))')} AS raw_recon_rmse,
  {q6(f'sqrt(avg((value - recon) * (value - recon))) / {span()}')} AS raw_recon_nrmse FROM x GROUP BY 1""")
def agg04(spark, d):
    return rounded(fd.linear_error(kept_events(spark, d)))


@query("agg05_peak_recall_top5", f"""{RANKED}
SELECT series_id, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS peak_recall_top5
FROM ranked WHERE peak_rank <= greatest(1, n_ticks // 20) GROUP BY 1""")
def agg05(spark, d):
    return rounded(fd.peak_recall_top5(kept_events(spark, d)))


def _recalls() -> str:
    return ", ".join(
        q6(f"avg(CASE WHEN peak_rank <= greatest(1, floor(n_ticks * {s}::DOUBLE)) "
           "THEN CASE WHEN sampled THEN 1.0 ELSE 0.0 END END)") + f" AS recall_top{round(s * 100)}"
        for s in fd.PEAK_SHARES)


@query("agg08_peak_recall_by_share", f"{RANKED} SELECT series_id, {_recalls()} FROM ranked GROUP BY 1")
def agg08(spark, d):
    return rounded(fd.peak_recall(kept_events(spark, d)))


HELD = f"""{BASE}, held AS (
  SELECT *, coalesce(
    last_value(CASE WHEN sampled THEN value END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY tick
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(CASE WHEN sampled THEN value END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY tick
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS held FROM kept)"""


@query("agg09_causal_error", f"""{HELD}
SELECT series_id, {q6('sqrt(avg((value - held) * (value - held)))')} AS causal_rmse,
  {q6(f'sqrt(avg((value - held) * (value - held))) / {span()}')} AS causal_nrmse FROM held GROUP BY 1""")
def agg09(spark, d):
    return rounded(fd.causal_error(kept_events(spark, d)))


EVENTS_FOUND = """flagged AS (SELECT * FROM ranked WHERE peak_rank <= greatest(1, floor(n_ticks * 0.05::DOUBLE))),
islands AS (SELECT *, tick - row_number() OVER (PARTITION BY series_id ORDER BY tick) AS island FROM flagged),
found AS (SELECT series_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS length,
            min(CASE WHEN sampled THEN tick END) AS first_hit FROM islands GROUP BY series_id, island)"""


@query("agg10_event_recall", f"""{RANKED}, {EVENTS_FOUND}
SELECT series_id, count(*) AS n_events, count(first_hit) AS n_hit,
  {q6('count(first_hit) / count(*)::DOUBLE')} AS event_recall,
  {q6('avg(first_hit - start_tick)')} AS mean_delay,
  {q6('quantile_cont(CAST(first_hit - start_tick AS DOUBLE), 0.95)')} AS p95_delay
FROM found GROUP BY 1""")
def agg10(spark, d):
    return rounded(fd.event_recall(kept_events(spark, d)))


@query("agg11_sampling_quality", f"""{HELD}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, tick) AS peak_rank,
         count(*) OVER (PARTITION BY series_id) AS n_ticks FROM held), {EVENTS_FOUND},
a AS (SELECT series_id, {_recalls()},
  {q6('sqrt(avg((value - held) * (value - held)))')} AS causal_rmse,
  {q6(f'sqrt(avg((value - held) * (value - held))) / {span()}')} AS causal_nrmse FROM ranked GROUP BY 1),
b AS (SELECT series_id, count(*) AS n_events, count(first_hit) AS n_hit,
  {q6('count(first_hit) / count(*)::DOUBLE')} AS event_recall,
  {q6('avg(first_hit - start_tick)')} AS mean_delay,
  {q6('quantile_cont(CAST(first_hit - start_tick AS DOUBLE), 0.95)')} AS p95_delay FROM found GROUP BY 1)
SELECT * FROM a JOIN b USING (series_id)""")
def agg11(spark, d):
    return rounded(fd.sampling_quality(kept_events(spark, d)))


@query("joi04_zero_order_hold", f"{HELD} SELECT series_id, tick, sampled, value, held FROM held")
def joi04(spark, d):
    return hold_last(kept_events(spark, d)).select("series_id", "tick", "sampled", "value", "held")


@query("joi07_linear_interpolation", f"""{BASE}, {interpolated('x', 'kept', 'series_id', {'recon': 'value'})}
SELECT series_id, tick, {q6('recon')} AS recon FROM x""")
def joi07(spark, d):
    return fd.linear_reconstruction(kept_events(spark, d)).select("series_id", "tick", r6("recon").alias("recon"))


@query("joi11_first_hit_per_event", f"{RANKED}, {EVENTS_FOUND} SELECT * FROM found")
def joi11(spark, d):
    return fd.top_events(kept_events(spark, d))


@query("joi20_peak_set_lookup", f"""{RANKED}
SELECT series_id, count(*) AS n_peaks, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_captured
FROM ranked WHERE peak_rank <= greatest(1, floor(n_ticks * 0.05::DOUBLE)) GROUP BY 1""")
def joi20(spark, d):
    top = fd.peak_ranks(kept_events(spark, d)).where(
        F.col("peak_rank") <= fd.top_count(0.05, F.col("n_ticks")))
    return top.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.sum(F.when(F.col("sampled"), 1).otherwise(0)).alias("n_captured"))


@query("set02_peak_ticks_kept", f"""{RANKED}
SELECT series_id, tick FROM ranked WHERE peak_rank <= greatest(1, floor(n_ticks * 0.05::DOUBLE))
INTERSECT SELECT series_id, tick FROM kept WHERE sampled""")
def set02(spark, d):
    kept = kept_events(spark, d)
    top = fd.peak_ranks(kept).where(F.col("peak_rank") <= fd.top_count(0.05, F.col("n_ticks")))
    return top.select("series_id", "tick").intersect(kept.where("sampled").select("series_id", "tick"))


@query("win01_magnitude_rank", f"{RANKED} SELECT series_id, tick, value, peak_rank FROM ranked")
def win01(spark, d):
    return fd.peak_ranks(kept_events(spark, d)).select("series_id", "tick", "value", "peak_rank")


@query("win02_deltas", f"""WITH {EVENTS}
SELECT series_id, tick, {q6('value - lag(value) OVER w')} AS delta,
  CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS BIGINT) AS gap_us
FROM trace WINDOW w AS (PARTITION BY series_id ORDER BY tick)""")
def win02(spark, d):
    t = event_trace(spark, d).withColumn("us", micros("ts"))
    w = fd.scan(t, ["series_id"], ["tick"], {
        "pv": fd.previous(F.col("value")), "pu": fd.previous(F.col("us"))}, "tick")
    return w.select("series_id", "tick", r6(F.col("value") - F.col("pv")).alias("delta"),
                    (F.col("us") - F.col("pu")).alias("gap_us"))


@query("win03_running_ratio", f"""{BASE}
SELECT series_id, tick, kept_so_far, {q6('kept_so_far / (tick + 1)::DOUBLE')} AS ratio_so_far FROM (
  SELECT *, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY tick) AS BIGINT)
    AS kept_so_far FROM kept)""")
def win03(spark, d):
    return fd.running_ratio(kept_events(spark, d)).select(
        "series_id", "tick", "kept_so_far", r6("ratio_so_far").alias("ratio_so_far"))


# --- metrics over replayed tracks -------------------------------------------------

CFG = dict(outlier_threshold=3.0)
TRACKS = f"""WITH RECURSIVE {EVENTS}, {tracker('dense', 'trace', threshold=3.0)},
{sampler('poll', 'trace', threshold=3.0)},
{interpolated('est', 'poll', 'series_id', {'est_mean': 'mean', 'est_std': 'std', 'recon': 'value'})},
tracks AS (SELECT e.*, d.mean AS full_mean, sqrt(d.var) AS full_std, d.status AS full_status
           FROM est e JOIN dense d USING (series_id, tick))"""


def adaptive_events(spark, d):
    trace = event_trace(spark, d)
    return (replay(trace, [make_config(**CFG)], "dense").drop("config_id"),
            replay(trace, [make_config(**CFG)], "urgency_adaptive").drop("config_id"))


def tracks(spark, d):
    dense, kept = adaptive_events(spark, d)
    return fd.compare_tracks(dense, kept, ["series_id"], ["series_id"])


ERR = "abs(full_mean - est_mean)"
SERR = "abs(full_std - est_std)"


@query("joi01_dense_with_kept", f"""{TRACKS}
SELECT series_id, tick, sampled, {q6('full_mean')} AS full_mean, {q6('est_mean')} AS est_mean,
  {q6('full_std')} AS full_std, {q6('est_std')} AS est_std FROM tracks""")
def joi01(spark, d):
    return rounded(tracks(spark, d).select("series_id", "tick", "sampled", "full_mean", "est_mean",
                                           "full_std", "est_std"))


@query("agg02_mean_tracking_error", f"""{TRACKS}
SELECT series_id, {q6(f'avg({ERR})')} AS mae_mean, {q6(f'sqrt(avg({ERR} * {ERR}))')} AS rmse_mean,
  {q6(f'sqrt(avg({ERR} * {ERR})) / {span()}')} AS nrmse_mean, {q6(f'max({ERR})')} AS max_mean_error,
  {q6(f'quantile_cont({ERR}, 0.5)')} AS p50_error, {q6(f'quantile_cont({ERR}, 0.9)')} AS p90_error,
  {q6(f'quantile_cont({ERR}, 0.95)')} AS p95_error, {q6(f'quantile_cont({ERR}, 0.99)')} AS p99_error
FROM tracks GROUP BY 1""")
def agg02(spark, d):
    return rounded(fd.track_error(tracks(spark, d), ["series_id"]).select(
        "series_id", "mae_mean", "rmse_mean", "nrmse_mean", "max_mean_error",
        "p50_error", "p90_error", "p95_error", "p99_error"))


@query("agg03_mean_correlation", f"""{TRACKS}
SELECT series_id, {q6(corr('full_mean', 'est_mean'))} AS correlation FROM tracks GROUP BY 1""")
def agg03(spark, d):
    return rounded(fd.track_error(tracks(spark, d), ["series_id"]).select("series_id", "correlation"))


@query("agg06_std_tracking_error", f"""{TRACKS}
SELECT series_id, {q6(f'avg({SERR})')} AS mae_std, {q6(f'sqrt(avg({SERR} * {SERR}))')} AS rmse_std
FROM tracks GROUP BY 1""")
def agg06(spark, d):
    return rounded(fd.track_error(tracks(spark, d), ["series_id"]).select("series_id", "mae_std", "rmse_std"))


@query("agg07_band_coverage", f"""{TRACKS}
SELECT series_id, {q6('avg(CASE WHEN value >= est_mean - 3 * est_std AND value <= est_mean + 3 * est_std '
                      'THEN 1.0 ELSE 0.0 END)')} AS coverage_3sigma FROM tracks GROUP BY 1""")
def agg07(spark, d):
    return rounded(fd.track_error(tracks(spark, d), ["series_id"]).select("series_id", "coverage_3sigma"))


@query("agg17_status_counts", f"""WITH RECURSIVE {EVENTS}, {tracker('dense', 'trace', threshold=3.0)},
{sampler('poll', 'trace', threshold=3.0)}
SELECT 'dense' AS run, series_id, status, count(*) AS n FROM dense GROUP BY 2, 3
UNION ALL SELECT 'adaptive', series_id, status, count(*) FROM poll WHERE sampled GROUP BY 2, 3""")
def agg17(spark, d):
    dense, kept = adaptive_events(spark, d)
    both = dense.withColumn("run", F.lit("dense")).unionByName(kept.withColumn("run", F.lit("adaptive")))
    return both.where("sampled").groupBy("run", "series_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg18_urgency_summary", f"""WITH RECURSIVE {EVENTS}, {sampler('poll', 'trace', threshold=3.0)}
SELECT coalesce(series_id, '__pooled__') AS series_id, count(*) AS n, {q6('avg(urgency)')} AS mean_urgency,
  {q6('quantile_cont(urgency, 0.5)')} AS median_urgency FROM poll GROUP BY GROUPING SETS ((series_id), ())""")
def agg18(spark, d):
    kept = adaptive_events(spark, d)[1].select("series_id", "urgency")
    levels = kept.select(F.explode(F.array(F.col("series_id"), F.lit("__pooled__"))).alias("series_id"), "urgency")
    return rounded(fd.group_stats(levels, ["series_id"], [
        F.count(F.lit(1)).alias("n"), F.avg("urgency").alias("mean_urgency")],
        {"median_urgency": (F.col("urgency"), 0.5)}))


@query("set06_outlier_jaccard", f"""{TRACKS}
SELECT series_id, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS n_both,
  CAST(sum(CASE WHEN a OR b THEN 1 ELSE 0 END) AS BIGINT) AS n_either,
  {q6('coalesce(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a OR b THEN 1 ELSE 0 END), 0)::DOUBLE, 1.0)')} AS jaccard
FROM (SELECT series_id, coalesce(status = 'OUTLIER', FALSE) AS a, full_status = 'OUTLIER' AS b FROM tracks) GROUP BY 1""")
def set06(spark, d):
    dense, kept = adaptive_events(spark, d)
    return rounded(fd.outlier_overlap(dense, kept, ["series_id"], ["series_id"]))


@query("sta20_dense_and_adaptive_report", f"""{TRACKS}, eff AS ({efficiency('poll')}),
err AS (SELECT series_id, {q6(f'avg({ERR})')} AS mae_mean, {q6(f'sqrt(avg({ERR} * {ERR}))')} AS rmse_mean,
  {q6(f'sqrt(avg({ERR} * {ERR})) / {span()}')} AS nrmse_mean, {q6(f'max({ERR})')} AS max_mean_error,
  {q6(corr('full_mean', 'est_mean'))} AS correlation,
  {q6('sqrt(avg((value - recon) * (value - recon)))')} AS raw_recon_rmse,
  {q6(f'sqrt(avg((value - recon) * (value - recon))) / {span()}')} AS raw_recon_nrmse,
  {q6(f'avg({SERR})')} AS mae_std, {q6(f'sqrt(avg({SERR} * {SERR}))')} AS rmse_std,
  {q6('avg(CASE WHEN value >= est_mean - 3 * est_std AND value <= est_mean + 3 * est_std THEN 1.0 ELSE 0.0 END)')} AS coverage_3sigma,
  {q6(f'quantile_cont({ERR}, 0.5)')} AS p50_error, {q6(f'quantile_cont({ERR}, 0.9)')} AS p90_error,
  {q6(f'quantile_cont({ERR}, 0.95)')} AS p95_error, {q6(f'quantile_cont({ERR}, 0.99)')} AS p99_error
  FROM tracks GROUP BY 1),
pk AS (SELECT series_id, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS peak_recall_top5 FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, tick) AS rk,
    count(*) OVER (PARTITION BY series_id) AS n FROM poll) WHERE rk <= greatest(1, n // 20) GROUP BY 1)
SELECT * FROM eff JOIN err USING (series_id) JOIN pk USING (series_id)""")
def sta20(spark, d):
    dense, kept = adaptive_events(spark, d)
    return rounded(fd.info_loss(dense, kept, ["series_id"], ["series_id"]))
