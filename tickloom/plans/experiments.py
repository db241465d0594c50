"""Queries: experiment alignment, scaling accuracy, repeats, overhead and comparability."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import experiments as ex
from tickloom.operators import overhead as ov
from tickloom.operators import windows as wn
from tickloom.operators.masks import n_of_m
from tickloom.plans.fidelity import rounded
from tickloom.plans.inputs import HOUR, PHASES, SEC, events, hour_of, phases, sec_of
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import EVENTS, USERS, corr
from tickloom.plans.windows import FILLED, replicas
from tickloom.session import note_short
from tickloom.sources import schedules as sc
from tickloom.sources.tables import event_trace, user_trace

POINTS = f"""points AS (SELECT user_id % 10 AS run, event_id, ({HOUR} - (SELECT min({HOUR}) FROM events))::DOUBLE + 0.5 AS elapsed_s FROM events)"""


def filled(spark, d):
    return wn.fill_valid(replicas(spark, d), ["run"], "elapsed_s", ["ready", "desired"])


def event_points(spark, d):
    e = events(spark, d).withColumn("__h", hour_of("ts"))
    first = e.agg(F.min("__h")).scalar()
    return e.select((F.col("user_id") % 10).alias("run"), "event_id", ((F.col("__h") - first) + 0.5).alias("elapsed_s"))


@query("joi05_replicas_at_time", f"""WITH {FILLED}, {POINTS}
SELECT p.run, p.event_id, p.elapsed_s, coalesce(f.ready, 1)::INTEGER AS replicas FROM points p ASOF LEFT JOIN filled f ON f.run = p.run AND f.elapsed_s <= p.elapsed_s""")
def joi05(spark, d):
    return ex.value_at(event_points(spark, d), filled(spark, d), ["run"], "elapsed_s", "ready", "replicas").withColumn(
        "replicas", F.col("replicas").cast("int"))


@query("joi08_signal_at_decisions", f"""WITH {FILLED}, sig AS (SELECT user_id % 10 AS run, ({SEC} - (SELECT min({HOUR}) FROM events) * 3600.0) / 3600.0 AS t, value FROM events),
pts AS (SELECT run, elapsed_s AS t, desired FROM (SELECT *, lag(desired) OVER (PARTITION BY run ORDER BY elapsed_s) AS p FROM filled) WHERE p IS NULL OR desired <> p),
lo AS (SELECT p.*, s.t AS x0, s.value AS y0 FROM pts p ASOF LEFT JOIN sig s ON s.run = p.run AND s.t <= p.t),
bo AS (SELECT p.*, s.t AS x1, s.value AS y1 FROM lo p ASOF LEFT JOIN sig s ON s.run = p.run AND s.t >= p.t)
SELECT run, t, desired, {q6('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END')} AS signal FROM bo""")
def joi08(spark, d):
    e = events(spark, d)
    first = e.agg(F.min(hour_of("ts"))).scalar()
    sig = e.select(
        (F.col("user_id") % 10).alias("run"), ((sec_of("ts") - first * 3600.0) / 3600.0).alias("t"), "value")
    return rounded(ex.decision_points(filled(spark, d).withColumnRenamed("elapsed_s", "t"), sig, ["run"]), "t")


PH = f"""{PHASES}, pts AS (SELECT CAST(user_id AS VARCHAR) AS shape, event_id, event_id * 0.25 AS elapsed_s FROM events)"""


def schedule_points(spark, d):
    points = events(spark, d).select(F.col("user_id").cast("string").alias("shape"), "event_id", (F.col("event_id") * 0.25).alias("elapsed_s"))
    return note_short(points, "shape")


@query("joi09_points_in_phase", f"""WITH {PH} SELECT p.shape, p.event_id, name, direction FROM pts p JOIN phases f ON f.shape = p.shape AND p.elapsed_s >= start_s AND p.elapsed_s < end_s""")
def joi09(spark, d):
    from tickloom.operators.reconstruct import interval_join
    return interval_join(schedule_points(spark, d), phases(spark, d), ["shape"], "elapsed_s", "start_s", "end_s", ["name", "direction"]).drop("elapsed_s")


@query("joi09_points_in_overlapping_windows", f"""WITH pts AS (SELECT event_type AS kind, event_id, {SEC} AS t FROM events),
w AS (SELECT event_type AS kind, event_id AS window_id, {SEC} AS s, {SEC} + value * 60 * (1 + event_id % 7) AS e FROM events WHERE event_id % 10 = 3)
SELECT kind, event_id, window_id FROM pts JOIN w USING (kind) WHERE t >= s AND t < e""")
def joi09_overlapping(spark, d):
    from tickloom.operators.reconstruct import overlap_join
    e = events(spark, d).select(F.col("event_type").alias("kind"), "event_id", sec_of("ts").alias("t"), "value")
    w = e.where(F.col("event_id") % 10 == 3).select(
        "kind", F.col("event_id").alias("window_id"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 60 * (1 + F.col("event_id") % 7)).alias("e"))
    return overlap_join(e.drop("value"), w, ["kind"], "t", "s", "e", ["window_id"]).drop("t")


@query("joi21_stage_at_time", f"""WITH {PH} SELECT p.shape, p.event_id, name, users FROM pts p LEFT JOIN phases f ON f.shape = p.shape AND p.elapsed_s >= start_s AND p.elapsed_s < end_s""")
def joi21(spark, d):
    return sc.stage_at(schedule_points(spark, d), phases(spark, d), ["shape"]).drop("elapsed_s")


READS = f"""reads AS (SELECT user_id % 4 AS run, {HOUR} AS second, user_id AS pod, event_id, value FROM events),
lastr AS (SELECT run, second, pod, max_by(value, event_id) AS v FROM reads GROUP BY 1, 2, 3)"""


def pod_reads(spark, d):
    return events(spark, d).select((F.col("user_id") % 4).alias("run"), hour_of("ts").alias("second"), F.col("user_id").alias("pod"), "event_id", "value")


@query("agg37_fleet_mean_per_second", f"WITH {READS} SELECT run, second, {q6('avg(v)')} AS mean_cpu, count(*) AS n_pods FROM lastr GROUP BY 1, 2")
def agg37(spark, d):
    return rounded(ex.per_second_fleet_mean(pod_reads(spark, d), ["run"], "pod", "second", "value", "event_id"))


@query("agg61_member_mean_per_second", f"WITH {READS} SELECT pod, second, {q6('avg(value)')} AS mean_value FROM reads GROUP BY 1, 2")
def agg61(spark, d):
    return rounded(pod_reads(spark, d).groupBy("pod", "second").agg(F.avg("value").alias("mean_value")))


# scaling: runs are user_id mod 10; the schedule of run r alternates 12-hour phases
SCHED = """sched AS (SELECT run, 'p' || k AS name, k * 12.0::DOUBLE AS start_s, (k + 1) * 12.0::DOUBLE AS end_s,
  CASE k % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'stable' WHEN 2 THEN 'down' ELSE 'stable' END AS direction
  FROM (SELECT run, unnest(range(CAST(floor(max(elapsed_s) / 12) + 1 AS BIGINT))) AS k FROM filled GROUP BY 1))"""


def schedule(spark, d):
    last = filled(spark, d).groupBy("run").agg(F.max("elapsed_s").alias("m"))
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 12).cast("int"))).alias("k")
    kind = F.element_at(F.array(F.lit("up"), F.lit("stable"), F.lit("down"), F.lit("stable")), F.col("k") % 4 + 1)
    return last.select("run", k).select("run", F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"),
                                        (F.col("k") * 12.0).alias("start_s"), ((F.col("k") + 1) * 12.0).alias("end_s"), kind.alias("direction"))


def _side(state: str, label: str) -> str:
    ok = f"NOT ((direction = 'down' AND {state}_at_start <= 1) OR (direction = 'up' AND {state}_at_start >= 6))"
    hit = f"CASE WHEN {ok} THEN {state}_hit - start_s END"
    return (f"count(CASE WHEN {ok} THEN 1 END) AS {label}transition_count, count({hit}) AS {label}detected_count, "
            f"{q6(f'count({hit}) / nullif(count(CASE WHEN {ok} THEN 1 END), 0)::DOUBLE')} AS {label}detection_rate, {q6(f'avg({hit})')} AS {label}latency_s")


@query("agg38_scaling_accuracy", f"""WITH {FILLED}, {SCHED}, hz AS (SELECT run, max(elapsed_s) + 1e-6 AS h FROM filled GROUP BY 1),
win AS (SELECT s.*, coalesce(min(start_s) OVER (PARTITION BY run, direction ORDER BY start_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), h) AS window_end_s FROM sched s JOIN hz USING (run) WHERE direction <> 'stable'),
chg AS (SELECT run, elapsed_s, ready - lag(ready) OVER w AS r, desired - lag(desired) OVER w AS q FROM filled WINDOW w AS (PARTITION BY run ORDER BY elapsed_s)),
a AS (SELECT w.*, coalesce(f.ready, 1) AS ready_at_start, coalesce(f.desired, 1) AS desired_at_start FROM win w ASOF LEFT JOIN filled f ON f.run = w.run AND f.elapsed_s <= w.start_s),
b AS (SELECT a.*, (SELECT min(elapsed_s) FROM chg c WHERE c.run = a.run AND c.elapsed_s >= a.start_s AND c.elapsed_s < a.window_end_s AND sign(c.r) = CASE a.direction WHEN 'up' THEN 1 ELSE -1 END) AS ready_hit,
  (SELECT min(elapsed_s) FROM chg c WHERE c.run = a.run AND c.elapsed_s >= a.start_s AND c.elapsed_s < a.window_end_s AND sign(c.q) = CASE a.direction WHEN 'up' THEN 1 ELSE -1 END) AS desired_hit FROM a)
SELECT run, direction, {_side('ready', '')}, {_side('desired', 'decision_')} FROM b GROUP BY 1, 2""")
def agg38(spark, d):
    return rounded(ex.scaling_accuracy(filled(spark, d), schedule(spark, d), ["run"], 1, 6))


@query("agg38_scaling_events", f"""WITH {FILLED}, c AS (SELECT *, lag(ready) OVER w AS r, lag(desired) OVER w AS q FROM filled WINDOW w AS (PARTITION BY run ORDER BY elapsed_s))
SELECT run, max(ready) AS peak_replicas, count(*) AS timeline_points, count(CASE WHEN ready > r THEN 1 END) AS scale_up_events, count(CASE WHEN ready < r THEN 1 END) AS scale_down_events,
  count(CASE WHEN desired > q THEN 1 END) AS hpa_scale_up_events, count(CASE WHEN desired < q THEN 1 END) AS hpa_scale_down_events FROM c GROUP BY 1""")
def agg38_events(spark, d):
    return ex.scaling_events(filled(spark, d), ["run"])


CPU = f"""cpu AS (SELECT user_id % 10 AS run, {HOUR} - (SELECT min({HOUR}) FROM events) AS elapsed_s, avg(value) AS mean_cpu FROM events GROUP BY 1, 2)"""


@query("agg39_under_provisioning", f"""WITH {FILLED}, {SCHED}, {CPU}, win AS (SELECT run, start_s, end_s + 12 * CASE WHEN (SELECT count(*) FROM sched n WHERE n.run = s.run AND n.start_s = s.end_s) > 0 THEN 1 ELSE 0 END AS e FROM sched s WHERE direction = 'up'),
ex AS (SELECT run, CAST(sum(ceil(e) - ceil(start_s)) AS BIGINT) AS cpu_expected_seconds FROM win GROUP BY 1),
inn AS (SELECT c.* FROM cpu c JOIN win w ON w.run = c.run AND c.elapsed_s >= start_s AND c.elapsed_s < e),
ld AS (SELECT i.*, coalesce(f.ready, 1) AS ready FROM inn i ASOF LEFT JOIN filled f ON f.run = i.run AND f.elapsed_s <= i.elapsed_s),
s AS (SELECT run, count(DISTINCT elapsed_s) AS obs, count(CASE WHEN mean_cpu > 55 THEN 1 END) AS u, sum(greatest(0.0, mean_cpu - 55) * ready) AS x FROM ld GROUP BY 1)
SELECT run, cpu_expected_seconds, coalesce(obs, 0) AS cpu_observed_seconds, {q6('coalesce(obs, 0) / cpu_expected_seconds::DOUBLE')} AS cpu_telemetry_coverage,
  CASE WHEN coalesce(obs, 0) / cpu_expected_seconds::DOUBLE >= 0.95 THEN coalesce(u, 0) END AS under_provisioned_s,
  {q6('CASE WHEN coalesce(obs, 0) / cpu_expected_seconds::DOUBLE >= 0.95 THEN coalesce(x, 0) END')} AS cpu_target_excess_core_seconds FROM ex LEFT JOIN s USING (run)""")
def agg39(spark, d):
    e = events(spark, d).withColumn("__h", hour_of("ts"))
    first = e.agg(F.min("__h")).scalar()
    cpu = e.groupBy((F.col("user_id") % 10).alias("run"), (F.col("__h") - first).alias("elapsed_s")).agg(F.avg("value").alias("mean_cpu"))
    return rounded(ex.provisioning(cpu, filled(spark, d), schedule(spark, d), ["run"], 55.0))


ARMS = """arms AS (SELECT user_id % 10 AS repeat, CASE (user_id // 10) % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'full' ELSE 'adaptive' END AS arm, event_type AS metric, event_id, ts, value FROM events)"""


def arms(spark, d):
    kind = F.element_at(F.array(F.lit("baseline"), F.lit("full"), F.lit("adaptive")), (F.floor(F.col("user_id") / 10) % 3 + 1).cast("int"))
    return events(spark, d).select((F.col("user_id") % 10).alias("repeat"), kind.alias("arm"), F.col("event_type").alias("metric"), "event_id", "ts", "value")


REP = f"""{q6('avg(v)')} AS mean, {q6('coalesce(stddev_samp(v), 0)')} AS stdev, {q6('coalesce(stddev_samp(v) / sqrt(count(v)), 0)')} AS sem,
  {q6('1.96 * coalesce(stddev_samp(v) / sqrt(count(v)), 0)')} AS ci95_half_width, {q6('quantile_cont(v, 0.5)')} AS median, count(v) AS n"""


@query("agg33_repeat_summary", f"WITH {ARMS}, x AS (SELECT repeat, arm, metric, sum(value) AS v FROM arms GROUP BY 1, 2, 3) SELECT arm, metric, {REP} FROM x GROUP BY 1, 2")
def agg33(spark, d):
    x = arms(spark, d).groupBy("repeat", "arm", "metric").agg(F.sum("value").alias("v"))
    return rounded(ex.repeat_summary(x, ["arm", "metric"], "v"))


@query("agg34_mean_of_repeat_means", f"WITH {ARMS}, x AS (SELECT repeat, arm, metric, avg(CASE WHEN value > 50 THEN value END) AS v FROM arms GROUP BY 1, 2, 3) SELECT arm, metric, {REP} FROM x WHERE v IS NOT NULL GROUP BY 1, 2")
def agg34(spark, d):
    big = arms(spark, d).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return rounded(ex.repeat_means_summary(big, ["arm", "metric"], "repeat", "value"))


PAIRS = f"""{ARMS}, x AS (SELECT repeat, arm, metric, avg(value) AS v FROM arms GROUP BY 1, 2, 3),
deltas AS (SELECT l.repeat, l.metric, r.v - l.v AS v FROM x l JOIN x r ON l.repeat = r.repeat AND l.metric = r.metric AND l.arm = 'full' AND r.arm = 'adaptive')"""


def deltas(spark, d):
    x = arms(spark, d).groupBy("repeat", "arm", "metric").agg(F.avg("value").alias("v"))
    return ex.paired_deltas(x, ["repeat", "metric"], "arm", "full", "adaptive", "v")


@query("joi15_paired_runs", f"WITH {PAIRS} SELECT repeat, metric, {q6('v')} AS delta FROM deltas")
def joi15(spark, d):
    return rounded(deltas(spark, d))


@query("agg35_paired_difference_summary", f"WITH {PAIRS} SELECT metric, {REP} FROM deltas GROUP BY 1")
def agg35(spark, d):
    return rounded(ex.repeat_summary(deltas(spark, d), ["metric"], "delta"))


@query("joi16_positional_pairs", f"""WITH {ARMS}, a AS (SELECT metric, event_id, value, row_number() OVER (PARTITION BY metric ORDER BY event_id) - 1 AS position FROM arms WHERE arm = 'full'),
b AS (SELECT metric, event_id, value, row_number() OVER (PARTITION BY metric ORDER BY event_id) - 1 AS position FROM arms WHERE arm = 'adaptive')
SELECT metric, position, a.event_id AS left_event_id, a.value AS left_value, b.event_id AS right_event_id, b.value AS right_value FROM a JOIN b USING (metric, position)""")
def joi16(spark, d):
    side = lambda arm: arms(spark, d).where(F.col("arm") == arm).select("metric", "event_id", "value")
    return ex.pair_by_position(side("full"), side("adaptive"), ["event_id"], ["metric"])


LAGGED = f"""{EVENTS}, full_run AS (SELECT series_id, tick, value FROM trace),
adaptive_run AS (SELECT series_id, tick - 3 AS tick, value + (tick % 5) AS value, (tick * 2) % 5 < 2 AS sampled FROM trace WHERE tick >= 3),
pairs AS (SELECT f.series_id, lag, f.value AS x, a.value AS y FROM adaptive_run a, (SELECT unnest(range(-12, 13)) AS lag), full_run f WHERE a.sampled AND f.series_id = a.series_id AND f.tick = a.tick + lag),
scores AS (SELECT series_id, CAST(lag AS INTEGER) AS lag, count(*) AS overlap_count, {corr('x', 'y')} AS corr, sqrt(avg((x - y) * (x - y))) / quantile_cont(abs(x), 0.95) AS nrmse_p95 FROM pairs GROUP BY 1, 2 HAVING count(*) >= 30)"""


def lagged(spark, d):
    t = event_trace(spark, d)
    shifted = t.where(F.col("tick") >= 3).select(
        "series_id", (F.col("tick") - 3).alias("tick"), (F.col("value") + F.col("tick") % 5).alias("value"), n_of_m(F.col("tick"), 2, 5).alias("sampled"))
    return t.select("series_id", "tick", "value"), shifted


@query("joi13_lag_scores", f"WITH {LAGGED} SELECT series_id, lag, overlap_count, {q6('corr')} AS corr, {q6('nrmse_p95')} AS nrmse_p95 FROM scores")
def joi13(spark, d):
    return rounded(ex.lag_scores(*lagged(spark, d), ["series_id"]))


@query("agg44_trace_comparability", f"""WITH {LAGGED}, best AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY corr - nrmse_p95 DESC, lag) AS rk FROM scores),
kept AS (SELECT series_id, count(CASE WHEN sampled THEN 1 END) AS k FROM adaptive_run GROUP BY 1)
SELECT series_id, CASE WHEN corr >= 0.75 AND nrmse_p95 <= 0.35 THEN 'comparable' WHEN corr >= 0.55 AND nrmse_p95 <= 0.6 THEN 'suspect' ELSE 'non-comparable' END AS status, lag AS best_lag_ticks, overlap_count,
  {q6('overlap_count / k::DOUBLE * 100')} AS overlap_pct, {q6('corr')} AS corr, {q6('nrmse_p95')} AS nrmse_p95,
  concat_ws(',', CASE WHEN abs(lag) >= 6 THEN 'large_shift' END, CASE WHEN corr < 0.75 THEN 'modest_correlation' END, CASE WHEN nrmse_p95 > 0.35 THEN 'elevated_error' END) AS notes
FROM best JOIN kept USING (series_id) WHERE rk = 1""")
def agg44(spark, d):
    return rounded(ex.comparability(*lagged(spark, d), ["series_id"]))


FRESH = """mem AS (SELECT user_id % 20 AS run, user_id AS pod, event_type, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1, 2, 3),
ready AS (SELECT run, pod FROM mem WHERE event_type = 'click'), base AS (SELECT run, pod, lo AS v FROM mem WHERE event_type = 'view'), cur AS (SELECT run, pod, CASE WHEN pod = 7 THEN 0 ELSE hi END AS v FROM mem WHERE event_type = 'view')"""


@query("joi19_freshness", f"""WITH {FRESH}, j AS (SELECT coalesce(r.run, c.run) AS run, r.pod AS rp, c.pod AS cp, c.v AS cv, b.v AS bv FROM ready r FULL JOIN cur c ON r.run = c.run AND r.pod = c.pod LEFT JOIN base b ON b.run = coalesce(r.run, c.run) AND b.pod = coalesce(r.pod, c.pod)),
g AS (SELECT run, count(CASE WHEN rp IS NULL OR cp IS NULL THEN 1 END) AS n_unmatched, count(CASE WHEN rp IS NOT NULL AND bv IS NULL THEN 1 END) AS n_no_baseline, count(CASE WHEN rp IS NOT NULL AND cv <= bv THEN 1 END) AS n_stale FROM j GROUP BY 1)
SELECT *, CASE WHEN n_unmatched > 0 THEN 'members_differ' WHEN n_no_baseline > 0 THEN 'baseline_missing' WHEN n_stale > 0 THEN 'stale' ELSE 'fresh' END AS reason, n_unmatched = 0 AND n_no_baseline = 0 AND n_stale = 0 AS fresh FROM g""")
def joi19(spark, d):
    return fresh_members(spark, d)


def fresh_members(spark, d):
    mem = events(spark, d).groupBy((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("pod"), "event_type").agg(
        F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    views = mem.where(F.col("event_type") == "view")
    ready = mem.where(F.col("event_type") == "click").select("run", "pod")
    base = views.select("run", "pod", F.col("lo").alias("v"))
    cur = views.select("run", "pod", F.when(F.col("pod") == 7, 0).otherwise(F.col("hi")).alias("v"))
    return ex.freshness(ready, base, cur, ["run"], "pod", "v")


@query("str09_staleness_by_latest_version", f"""WITH mx AS (SELECT user_id % 20 AS run, user_id AS pod, max(CASE WHEN event_type = 'view' THEN event_id END)::DOUBLE AS m, max(CASE WHEN event_type = 'click' THEN event_id END)::DOUBLE AS s FROM events GROUP BY 1, 2)
SELECT run, count(*) AS n_members, count(CASE WHEN s IS NULL OR m < s + 100 THEN 1 END) AS n_stale FROM mx WHERE m IS NOT NULL GROUP BY 1""")
def str09(spark, d):
    e = events(spark, d).select((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("pod"), "event_type", F.col("event_id").cast("double").alias("w"))
    latest = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("w")))
    both = e.groupBy("run", "pod").agg(latest("view").alias("metric_wall"), latest("click").alias("last_sample_wall"))
    metrics = both.where(F.col("metric_wall").isNotNull()).select("run", "pod", "metric_wall")
    return ex.published_after_samples(metrics, both.select("run", "pod", "last_sample_wall"), ["run"], "pod", 100.0)


# --- monitoring cost -------------------------------------------------------------------------

COST = f"""{USERS}, cost AS (SELECT series_id AS run, tick, tick % 3 <> 1 AS sampled, tick % 4 = 0 AS updated, CASE WHEN tick % 3 = 0 THEN 1 ELSE 6 END AS interval, least(value / 100, 1.0) AS urgency,
  value * 10 AS read_overhead_us, value * 3 AS tracker_overhead_us, CASE WHEN tick % 5 <> 0 THEN value * 2 END AS adaptive_overhead_us, CASE WHEN tick % 4 = 0 THEN value * 90 END AS metrics_overhead_us, value AS emit_overhead_us,
  value * (16 + 90 * CASE WHEN tick % 4 = 0 THEN 1 ELSE 0 END) AS active_loop_us, value / 60 AS monitor_cpu_pct, tick * 0.5 AS user_cpu_s, tick * 0.25 AS system_cpu_s,
  CASE WHEN series_id LIKE '%3' THEN NULL ELSE tick * 0.8 END AS total_cpu_s, CASE WHEN tick % 2 = 0 THEN tick % 7 + 1 END AS w FROM trace)"""


def cost_rows(spark, d):
    t, v = F.col("tick"), F.col("value")
    pub = F.when(t % 4 == 0, 1).otherwise(0)
    return user_trace(spark, d).select(
        F.col("series_id").alias("run"), t.alias("tick"), (t % 3 != 1).alias("sampled"), (t % 4 == 0).alias("updated"),
        F.when(t % 3 == 0, 1).otherwise(6).alias("interval"), F.least(v / 100, F.lit(1.0)).alias("urgency"),
        (v * 10).alias("read_overhead_us"), (v * 3).alias("tracker_overhead_us"), F.when(t % 5 != 0, v * 2).alias("adaptive_overhead_us"),
        F.when(t % 4 == 0, v * 90).alias("metrics_overhead_us"), v.alias("emit_overhead_us"), (v * (16 + 90 * pub)).alias("active_loop_us"),
        (v / 60).alias("monitor_cpu_pct"), (t * 0.5).alias("user_cpu_s"), (t * 0.25).alias("system_cpu_s"),
        F.when(~F.col("series_id").endswith("3"), t * 0.8).alias("total_cpu_s"), F.when(t % 2 == 0, t % 7 + 1).alias("w"))


@query("agg19_window_weighted_mean", f"WITH {COST} SELECT run, {q6('sum(urgency * greatest(coalesce(w, 1), 1)) / sum(greatest(coalesce(w, 1), 1))')} AS mean_urgency FROM cost GROUP BY 1")
def agg19(spark, d):
    return rounded(ov.weighted_mean(cost_rows(spark, d), ["run"], "urgency", "w", "mean_urgency"))


COLS = (*ov.COMPONENTS, "active_loop_us")


@query("agg20_overhead_summary", f"""WITH {COST}, long AS ({' UNION ALL '.join(f"SELECT run, '{c}' AS metric, {c}::DOUBLE AS v FROM cost" for c in COLS)})
SELECT run, metric, {q6('avg(v)')} AS mean, {q6('max(v)')} AS max, {q6('quantile_cont(v, 0.95)')} AS p95, {q6('quantile_cont(v, 0.99)')} AS p99 FROM long WHERE v IS NOT NULL GROUP BY 1, 2""")
def agg20(spark, d):
    return rounded(ov.overhead_summary(cost_rows(spark, d), ["run"], COLS))


@query("agg21_workload_summary", f"""WITH {ARMS}, s AS (SELECT metric, arm, avg(value) AS m FROM arms GROUP BY 1, 2)
SELECT s.metric, s.arm, {q6('s.m')} AS mean, {q6('(s.m - b.m) / b.m * 100')} AS change_pct, {q6('s.m / b.m * 100')} AS relative_pct FROM s JOIN s b ON b.metric = s.metric AND b.arm = 'baseline'""")
def agg21(spark, d):
    return rounded(ov.arm_changes(ov.workload_summary(arms(spark, d), ["metric", "arm"], "value"), ["metric"], "arm", "mean", "baseline"))


@query("agg21_workload_percentiles", f"WITH {ARMS} SELECT metric, arm, count(value) AS count, {q6('avg(value)')} AS mean, {q6('max(value)')} AS max, {q6('quantile_cont(value, 0.5)')} AS p50, {q6('quantile_cont(value, 0.95)')} AS p95 FROM arms GROUP BY 1, 2")
def agg21_percentiles(spark, d):
    return rounded(ov.workload_summary(arms(spark, d), ["metric", "arm"], "value"))


@query("agg41_cpu_normalisation", f"""WITH {COST}, g AS (SELECT run, count(*) * 0.2 AS wall, coalesce(max(total_cpu_s), max(user_cpu_s) + max(system_cpu_s)) AS cpu, avg(monitor_cpu_pct) AS snap FROM cost GROUP BY 1)
SELECT run, {q6('wall')} AS wall_time_s, {q6('cpu')} AS total_cpu_s, {q6('cpu / wall * 100')} AS mean_cpu_pct_over_wall, {q6('snap')} AS snapshot_mean_cpu_pct FROM g""")
def agg41(spark, d):
    return rounded(ov.cpu_normalisation(cost_rows(spark, d), ["run"], 0.2))


ACC = f"""{COST}, g AS (SELECT run, count(CASE WHEN sampled THEN 1 END) AS sampled_events, count(*) AS emitted_events, count(CASE WHEN updated THEN 1 END) AS updates,
  avg(read_overhead_us) AS r, avg(tracker_overhead_us) AS t, avg(adaptive_overhead_us) AS a, avg(metrics_overhead_us) AS m, avg(emit_overhead_us) AS e, avg(active_loop_us) AS l FROM cost GROUP BY 1),
acc AS (SELECT run, sampled_events, emitted_events, updates, r AS probe_fetch_mean_us, r * sampled_events / 1e6 AS probe_fetch_total_s, t * sampled_events / 1e6 AS tracker_total_s, a * sampled_events / 1e6 AS adaptive_total_s,
  m * updates / 1e6 AS metrics_total_s, e * emitted_events / 1e6 AS emit_total_s, l * sampled_events / 1e6 AS active_loop_total_s FROM g)"""
ACC_COLS = ("probe_fetch_mean_us", "probe_fetch_total_s", "tracker_total_s", "adaptive_total_s", "metrics_total_s", "emit_total_s", "active_loop_total_s")
POST = "(tracker_total_s + coalesce(adaptive_total_s, 0) + coalesce(metrics_total_s, 0) + emit_total_s)"


@query("agg42_cost_accounting", f"""WITH {ACC} SELECT run, sampled_events, emitted_events, updates, {', '.join(f'{q6(c)} AS {c}' for c in ACC_COLS)}, {q6('coalesce(metrics_total_s, 0) + emit_total_s')} AS publish_path_total_s,
  {q6(POST)} AS post_fetch_control_total_s, {q6('probe_fetch_total_s / active_loop_total_s * 100')} AS probe_fetch_share_pct, {q6(POST + ' / active_loop_total_s * 100')} AS post_fetch_control_share_pct FROM acc""")
def agg42(spark, d):
    return rounded(ov.cost_accounting(cost_rows(spark, d), ["run"]))


STAB = f"""{COST}, t AS (SELECT run, max(active_loop_us) AS amax, max(monitor_cpu_pct) AS cmax, greatest(coalesce(max(metrics_overhead_us), 0), max(emit_overhead_us)) AS pmax, greatest(max(read_overhead_us), max(tracker_overhead_us), coalesce(max(adaptive_overhead_us), 0)) AS kmax,
  quantile_cont(active_loop_us, 0.95) AS a95, quantile_cont(active_loop_us, 0.99) AS a99, quantile_cont(monitor_cpu_pct, 0.95) AS c95, quantile_cont(monitor_cpu_pct, 0.99) AS c99 FROM cost GROUP BY 1),
sp AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY active_loop_us DESC, tick DESC) AS rk FROM cost JOIN t USING (run) WHERE active_loop_us >= a99),
p AS (SELECT run, count(*) AS spike_window_count, avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END) AS sf, avg(interval) AS si, avg(urgency) AS su,
  sum(read_overhead_us) AS r, sum(tracker_overhead_us) AS k, coalesce(sum(adaptive_overhead_us), 0) AS a, coalesce(sum(metrics_overhead_us), 0) AS m, sum(emit_overhead_us) AS e FROM sp WHERE rk <= 12 GROUP BY 1),
sc AS (SELECT run, CASE WHEN amax >= 100000 THEN 2 ELSE 0 END + CASE WHEN a99 >= greatest(10000, a95 * 5) THEN 1 ELSE 0 END + CASE WHEN cmax >= 5 THEN 2 WHEN cmax >= 2 THEN 1 ELSE 0 END + CASE WHEN c99 >= greatest(1, c95 * 3) THEN 1 ELSE 0 END
  + CASE WHEN pmax >= 20000 THEN 1 ELSE 0 END + CASE WHEN kmax >= 10000 THEN 1 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN amax >= 100000 THEN 'active_loop_max_extreme' END, CASE WHEN a99 >= greatest(10000, a95 * 5) THEN 'active_loop_p99_inflated' END, CASE WHEN cmax >= 5 THEN 'cpu_large_spike' WHEN cmax >= 2 THEN 'cpu_moderate_spike' END,
    CASE WHEN c99 >= greatest(1, c95 * 3) THEN 'cpu_p99_inflated' END, CASE WHEN pmax >= 20000 THEN 'publish_spike' END, CASE WHEN kmax >= 10000 THEN 'core_loop_spike' END) AS reasons FROM t)"""


@query("agg43_run_stability", f"""WITH {STAB} SELECT run, score::INTEGER AS score, reasons, CASE WHEN score >= 4 THEN 'unstable' WHEN score >= 2 THEN 'suspect' ELSE 'stable' END AS status, spike_window_count, {q6('sf')} AS spike_sampled_fraction,
  {q6('si')} AS spike_interval_mean, {q6('su')} AS spike_urgency_mean, {', '.join(f"{q6(f'{x} / (r + k + a + m + e) * 100')} AS {c}_share_pct" for x, c in zip('rkame', ov.COMPONENTS))},
  concat_ws(',', CASE WHEN (m + e) / (r + k + a + m + e) >= 0.5 THEN 'publish_path_dominates' WHEN (r + k + a) / (r + k + a + m + e) >= 0.5 THEN 'core_loop_dominates' END,
    CASE WHEN sf <= 0.4 THEN 'spikes_on_unsampled_ticks' WHEN sf >= 0.6 AND si <= 2 AND su >= 0.85 THEN 'spikes_at_high_urgency' END) AS hints FROM sc JOIN p USING (run)""")
def agg43(spark, d):
    return rounded(ov.run_stability(cost_rows(spark, d), ["run"]))


SUB = f"""{ARMS}, runs AS (SELECT repeat, arm, metric, avg(value) AS value, CASE repeat % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'suspect' ELSE 'unstable' END AS status, CASE WHEN repeat % 2 = 0 THEN 'comparable' ELSE 'suspect' END AS comparable, repeat = 9 AS warned FROM arms GROUP BY 1, 2, 3)"""


def run_metrics(spark, d):
    x = arms(spark, d).groupBy("repeat", "arm", "metric").agg(F.avg("value").alias("value"))
    k = F.col("repeat") % 3
    return x.withColumn("status", F.when(k == 0, "stable").when(k == 1, "suspect").otherwise("unstable")).withColumn(
        "comparable", F.when(F.col("repeat") % 2 == 0, "comparable").otherwise("suspect")).withColumn("warned", F.col("repeat") == 9)


@query("agg45_experiment_aggregation", f"""WITH {SUB}, s AS (SELECT *, 'all' AS subset FROM runs UNION ALL SELECT *, 'stable_only' FROM runs WHERE status = 'stable' UNION ALL SELECT *, 'non_unstable' FROM runs WHERE status <> 'unstable' UNION ALL SELECT *, 'comparable_only' FROM runs WHERE comparable = 'comparable')
SELECT arm, subset, metric, count(value) AS count, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std, {q6('min(value)')} AS min, {q6('max(value)')} AS max FROM s WHERE NOT warned GROUP BY 1, 2, 3""")
def agg45(spark, d):
    return rounded(ov.subset_summary(run_metrics(spark, d), "arm"))


@query("agg46_arm_savings", f"""WITH {SUB}, m AS (SELECT metric, avg(CASE WHEN arm = 'full' THEN value END) AS f, avg(CASE WHEN arm = 'adaptive' THEN value END) AS a FROM runs WHERE NOT warned GROUP BY 1)
SELECT metric, {q6('f')} AS full_mean, {q6('a')} AS adaptive_mean, {q6('(1 - a / f) * 100')} AS saved_pct FROM m""")
def agg46(spark, d):
    summary = ov.metric_summary(run_metrics(spark, d).where(~F.col("warned")), ["arm"])
    return rounded(ov.arm_savings(summary, [], "arm", "full", "adaptive"))


@query("agg47_confidence_warnings", f"""WITH {ARMS}, c AS (SELECT repeat, metric, arm, count(*) AS n, min(event_id) / 100.0 AS t FROM arms GROUP BY 1, 2, 3),
g AS (SELECT repeat, metric, min(n) AS lo, max(n) AS hi, max(t) - min(t) AS sp FROM c GROUP BY 1, 2)
SELECT repeat, metric, lo AS min_count, hi AS max_count, concat_ws(',', CASE WHEN lo < 8 THEN 'low_confidence' END, CASE WHEN lo > 0 AND hi >= 2 * lo THEN 'count_mismatch' END, CASE WHEN hi <> lo THEN 'unequal_counts' END, CASE WHEN sp > 1.0 THEN 'trim_misaligned' END) AS warnings FROM g""")
def agg47(spark, d):
    c = arms(spark, d).groupBy("repeat", "metric", "arm").agg(F.count(F.lit(1)).alias("count"), (F.min("event_id") / 100.0).alias("trim_start"))
    return ov.confidence_warnings(c, ["repeat", "metric"])


PHASE = """ph AS (SELECT user_id AS run, event_id AS phase_index, CASE event_type WHEN 'click' THEN 'baseline' ELSE event_type END AS monitoring_mode, event_type || '-' || event_id AS label, event_id % 3 AS repeat_index,
  value AS monitor_cpu_s, value * 2 AS workload_cpu_s, value + 10 AS wall_s, CASE WHEN event_type <> 'error' THEN event_id + 1 END AS operations, event_id AS probe_reads, value * 7 AS mean_read_ns FROM events),
b AS (SELECT run, min(phase_index) AS phase_index FROM ph WHERE monitoring_mode = 'baseline' GROUP BY 1), base AS (SELECT ph.* FROM ph JOIN b USING (run, phase_index))"""


@query("agg48_phase_deltas", f"""WITH {PHASE} SELECT p.run, p.label, p.repeat_index, {q6('p.monitor_cpu_s - x.monitor_cpu_s')} AS monitor_cpu_s_delta, {q6('p.workload_cpu_s - x.workload_cpu_s')} AS workload_cpu_s_delta, {q6('p.wall_s - x.wall_s')} AS wall_s_delta,
  {q6('((p.operations / p.wall_s) - (x.operations / x.wall_s)) / (x.operations / x.wall_s) * 100')} AS throughput_delta_pct, p.probe_reads - x.probe_reads AS probe_reads_delta, {q6('p.mean_read_ns - x.mean_read_ns')} AS mean_read_ns_delta FROM ph p JOIN base x USING (run)""")
def agg48(spark, d):
    e, v = events(spark, d), F.col("value")
    ph = e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("phase_index"),
        F.when(F.col("event_type") == "click", "baseline").otherwise(F.col("event_type")).alias("monitoring_mode"),
        F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("label"), (F.col("event_id") % 3).alias("repeat_index"),
        v.alias("monitor_cpu_s"), (v * 2).alias("workload_cpu_s"), (v + 10).alias("wall_s"),
        F.when(F.col("event_type") != "error", F.col("event_id") + 1).alias("operations"), F.col("event_id").alias("probe_reads"), (v * 7).alias("mean_read_ns"))
    return rounded(ov.phase_deltas(ph, ["run"]))


@query("agg49_fleet_sweep_cost", f"""SELECT user_id AS run, {q6('avg(value * 1e5) / 1000')} AS mean_sweep_us, {q6('(max(value) + max(value) / 4) / max(event_id + 1) * 100')} AS monitoring_cpu_pct, {q6('quantile_cont(value * 1e5, 0.99) / 1000')} AS p99_sweep_us FROM events GROUP BY 1""")
def agg49(spark, d):
    v = F.col("value")
    rows = events(spark, d).select(F.col("user_id").alias("run"), (v * 1e5).alias("sweep_ns"), v.alias("user_cpu_s"), (v / 4).alias("system_cpu_s"), (F.col("event_id") + 1).alias("wall_s"))
    return rounded(ov.sweep_cost(rows, ["run"]))


REPORT = """SELECT event_id AS run, CASE WHEN user_id % 4 <> 0 THEN value / 500 END AS sr, CASE WHEN user_id % 3 <> 0 THEN value * 2 END AS loop, CASE WHEN user_id % 5 <> 0 THEN value / 7 END AS cpu, CASE WHEN user_id % 2 = 0 THEN value / 9 END AS u, value FROM events"""


def nested_reports(spark, d):
    v, k = F.col("value"), F.col("user_id")
    stat = lambda c, m=None: F.struct(c.alias("mean"), (m if m is not None else c).alias("max"))
    none = F.lit(None).cast("double")
    return events(spark, d).select(
        F.col("event_id").alias("run"),
        F.struct(F.when(k % 4 != 0, v / 500).alias("sample_ratio"), F.when(k % 4 != 0, v).alias("max_gap"), (v / 11).alias("mean_urgency")).alias("sampling_summary"),
        F.struct(F.when(k % 2 == 0, v / 9).alias("mean_urgency")).alias("scheduler_summary"),
        F.struct(F.when(k % 5 != 0, v / 7).alias("mean_cpu_pct_over_wall"), F.when(k % 5 != 0, v / 3).alias("total_cpu_s")).alias("cpu_normalization"),
        F.struct(F.when(k % 2 == 1, v / 13).alias("probe_fetch_mean_us")).alias("cost_accounting"),
        F.struct(stat(v).alias("read_overhead_us"), stat(v / 2).alias("tracker_overhead_us"), stat(v / 4).alias("adaptive_overhead_us"),
                 stat(v / 8).alias("metrics_overhead_us"), stat(F.when(k % 3 == 0, v / 16)).alias("emit_overhead_us"),
                 stat(F.when(k % 3 != 0, v * 2)).alias("active_loop_us"), stat(v / 17).alias("monitor_cpu_pct"),
                 stat(none).alias("total_cpu_s"), stat(v / 19).alias("user_cpu_s"), stat(v / 23).alias("system_cpu_s")).alias("overhead_summary"))


@query("agg60_report_row", f"""SELECT event_id AS run, {q6('CASE WHEN user_id % 4 <> 0 THEN value / 500 ELSE 1 END')} AS live_sample_ratio, {q6('CASE WHEN user_id % 4 <> 0 THEN value ELSE 1 END')} AS live_max_gap,
  {q6('CASE WHEN user_id % 5 <> 0 THEN value / 7 ELSE value / 17 END')} AS mean_cpu_pct, {q6('CASE WHEN user_id % 5 <> 0 THEN value / 3 ELSE value / 19 + value / 23 END')} AS total_cpu_s, {q6('CASE WHEN user_id % 2 = 0 THEN value / 9 ELSE value / 11 END')} AS mean_urgency,
  {q6('CASE WHEN user_id % 3 <> 0 THEN value * 2 ELSE value + value / 2 + value / 4 + value / 8 + value / 16 END')} AS active_mean_us, {q6('CASE WHEN user_id % 2 = 1 THEN value / 13 ELSE value END')} AS probe_fetch_mean_us FROM events""")
def agg60(spark, d):
    return rounded(ov.evaluation_row(nested_reports(spark, d), ["run"]))


@query("agg60_flattened_report", f"""SELECT event_id AS run, 'sample_ratio' AS metric, {q6('CASE WHEN user_id % 4 <> 0 THEN value / 500 END')} AS value FROM events UNION ALL SELECT event_id, 'max_gap', {q6('CASE WHEN user_id % 4 <> 0 THEN value END')} FROM events
UNION ALL SELECT event_id, 'mean_urgency', {q6('value / 11')} FROM events""")
def agg60_flat(spark, d):
    return rounded(ov.flatten_report(nested_reports(spark, d), ["run"], "sampling_summary"))


@query("set07_active_and_finished_tracks", f"""WITH l AS (SELECT user_id AS track, max(event_id) AS last, max(CASE WHEN event_type = 'error' THEN event_id END) AS stopped FROM events GROUP BY 1)
SELECT track, 'active' AS state, last FROM l WHERE stopped IS NULL OR stopped < last UNION ALL SELECT track, 'finished', last FROM l WHERE stopped = last""")
def set07(spark, d):
    l = events(spark, d).groupBy(F.col("user_id").alias("track")).agg(
        F.max("event_id").alias("last"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("stopped"))
    active = l.where(F.col("stopped").isNull() | (F.col("stopped") < F.col("last")))
    pick = lambda df, s: df.select("track", F.lit(s).alias("state"), "last")
    return pick(active, "active").unionByName(pick(l.where(F.col("stopped") == F.col("last")), "finished"))
