"""Queries: windows, intervals, events and top-k regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import r6
from tickloom.operators import fidelity as fd
from tickloom.operators import intervals as iv
from tickloom.operators import windows as wn
from tickloom.operators.counters import sustained
from tickloom.operators.regions import pick_regions
from tickloom.operators.replay import replay
from tickloom.operators.scans import number_rows, running_max, running_min, scan
from tickloom.params import make_config
from tickloom.plans.fidelity import kept_events, rounded
from tickloom.plans.inputs import HOUR, PHASES, events, hour_of, phases
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import EVENTS, MASKED, USERS, sampler
from tickloom.session import note_short
from tickloom.sources import schedules as sc
from tickloom.sources.tables import event_trace, user_trace


def anomalies_sql(name: str, source: str, z: float, k: int, warmup: int = 50) -> str:
    return f"""{name}_b AS (SELECT series_id, avg(value) AS mu, CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END AS sd FROM {source} WHERE tick < {warmup} GROUP BY 1),
{name}_f AS (SELECT * FROM {source} JOIN {name}_b USING (series_id) WHERE abs(value - mu) > {z} * sd),
{name} AS (SELECT series_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS length FROM (
  SELECT *, tick - row_number() OVER (PARTITION BY series_id ORDER BY tick) AS island FROM {name}_f) GROUP BY series_id, island HAVING count(*) >= {k})"""


@query("agg12_anomaly_windows", f"WITH {EVENTS}, {anomalies_sql('a', 'trace', 1.0, 2)} SELECT * FROM a")
def agg12(spark, d):
    return iv.anomaly_windows(event_trace(spark, d), z=1.0, min_consecutive=2)


HELD_SIG = f"""{EVENTS}, {MASKED}, sig AS (SELECT series_id, tick, coalesce(
  last_value(CASE WHEN sampled THEN value END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), value) AS value FROM kept)"""
MATCHED = f"""{HELD_SIG}, {anomalies_sql('a', 'trace', 1.0, 2)}, {anomalies_sql('b', 'sig', 1.0, 3)},
m AS (SELECT a.series_id, a.start_tick, a.end_tick, b.start_tick AS det_start, b.end_tick AS det_end,
  row_number() OVER (PARTITION BY a.series_id, a.start_tick ORDER BY b.start_tick) AS rk
  FROM a LEFT JOIN b ON b.series_id = a.series_id AND b.start_tick <= a.end_tick + 5 AND b.end_tick >= a.start_tick - 5)"""


def both_windows(spark, d):
    kept = kept_events(spark, d)
    held = fd.hold_last(kept).select("series_id", "tick", F.col("held").alias("value"))
    return iv.anomaly_windows(kept, z=1.0, min_consecutive=2), iv.anomaly_windows(held, z=1.0, min_consecutive=3)


@query("joi10_overlap_with_tolerance", f"""WITH {MATCHED}
SELECT series_id, start_tick, end_tick, det_start, det_end, CAST(greatest(0, det_start - start_tick) AS BIGINT) * CASE WHEN det_start IS NULL THEN NULL ELSE 1 END AS latency FROM m WHERE rk = 1""")
def joi10(spark, d):
    truth, found = both_windows(spark, d)
    return iv.match_windows(truth, found)


@query("agg13_anomaly_comparison", f"""WITH {MATCHED}, l AS (
  SELECT series_id, count(*) AS ground_truth_count, count(det_start) AS detected, avg(greatest(0, det_start - start_tick)) FILTER (WHERE det_start IS NOT NULL) AS lat,
    count(DISTINCT det_start) AS used FROM m WHERE rk = 1 GROUP BY 1),
r AS (SELECT series_id, count(*) AS n FROM b GROUP BY 1)
SELECT series_id, coalesce(ground_truth_count, 0) AS ground_truth_count, coalesce(n, 0) AS detected_count, coalesce(detected, 0) AS detected,
  coalesce(ground_truth_count, 0) - coalesce(detected, 0) AS missed, coalesce(n, 0) - coalesce(used, 0) AS false_positives,
  {q6('coalesce(detected / ground_truth_count::DOUBLE, 1.0)')} AS recall, {q6('coalesce(lat, 0.0)')} AS mean_latency_ticks
FROM l FULL JOIN r USING (series_id)""")
def agg13(spark, d):
    truth, found = both_windows(spark, d)
    return rounded(iv.compare_windows(truth, found))


BURSTS = f"""WITH {EVENTS}, {MASKED}, lim AS (SELECT series_id, quantile_cont(value, 0.55) AS q FROM kept GROUP BY 1),
hi AS (SELECT series_id, tick, tick - row_number() OVER (PARTITION BY series_id ORDER BY tick) AS island FROM kept JOIN lim USING (series_id) WHERE value > q),
rn AS (SELECT series_id, min(tick) AS s, max(tick) + 1 AS e FROM hi GROUP BY series_id, island HAVING count(*) >= 4),
mk AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY series_id ORDER BY s) <= 20 THEN 0 ELSE 1 END AS fresh FROM rn),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY s) AS burst FROM mk),
bursts AS (SELECT series_id, CAST(burst AS BIGINT) AS burst, min(s) AS start, max(e) AS "end" FROM gr GROUP BY 1, 2)"""


@query("agg14_bursts", f"""{BURSTS} SELECT b.*, max(value) AS peak FROM bursts b JOIN kept k ON k.series_id = b.series_id AND k.tick >= b.start AND k.tick < b."end" GROUP BY ALL""")
def agg14(spark, d):
    return iv.bursts(kept_events(spark, d), percentile=0.55, min_length=4)


@query("agg15_burst_peak_recall", f"""{BURSTS}, r AS (
  SELECT b.*, sampled, row_number() OVER (PARTITION BY b.series_id, burst ORDER BY value DESC, tick DESC) AS rk
  FROM bursts b JOIN kept k ON k.series_id = b.series_id AND k.tick >= b.start AND k.tick < b."end")
SELECT series_id, burst, count(*) AS n_top, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_captured, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS peak_recall
FROM r WHERE rk <= greatest(1, ceil(("end" - start) * 0.1::DOUBLE)) GROUP BY 1, 2""")
def agg15(spark, d):
    kept = kept_events(spark, d)
    return rounded(iv.burst_peak_recall(kept, iv.bursts(kept, percentile=0.55, min_length=4)))


@query("agg16_live_summary", f"""WITH {EVENTS}, {MASKED}, live AS (SELECT series_id, tick + 7 AS t, CASE WHEN sampled THEN value END AS value, sampled FROM kept WHERE tick % 3 <> 2 OR sampled),
reads AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM live WHERE sampled),
g AS (SELECT series_id, max(gap) AS mx, avg(gap) AS mn, quantile_cont(gap::DOUBLE, 0.95) AS p, count(*) AS n_sampled FROM reads GROUP BY 1)
SELECT series_id, min(t) AS start_tick, max(t) AS end_tick, max(t) - min(t) + 1 AS n_total, any_value(n_sampled) AS n_sampled,
  {q6('any_value(n_sampled) / (max(t) - min(t) + 1)::DOUBLE')} AS sample_ratio, any_value(mx) AS max_gap, {q6('any_value(mn)')} AS mean_gap, {q6('any_value(p)')} AS p95_gap
FROM live JOIN g USING (series_id) GROUP BY 1""")
def agg16(spark, d):
    kept = kept_events(spark, d).where((F.col("tick") % 3 != 2) | F.col("sampled"))
    live = kept.select("series_id", (F.col("tick") + 7).alias("t"), F.when(F.col("sampled"), F.col("value")).alias("value"), "sampled")
    return rounded(iv.live_summary(live))


@query("win04_rolling_outlier_share", f"""WITH RECURSIVE {USERS}, {sampler('poll', 'trace', threshold=3.0)},
reads AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY tick) - 1 AS pos, CASE WHEN status IN ('OUTLIER', 'DRIFT_RESET') THEN 1.0 ELSE 0.0 END AS odd FROM poll WHERE sampled)
SELECT series_id, pos, {q6('avg(odd) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS share FROM reads""")
def win04(spark, d):
    reads = replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)]).where("sampled").select("series_id", "tick", "status")
    pos = number_rows(reads, ["series_id"], ["tick"], "pos")
    out = wn.rolling_share(pos, ["series_id"], "pos", F.col("status").isin("OUTLIER", "DRIFT_RESET"), 20, "share")
    return out.select("series_id", "pos", r6("share").alias("share"))


@query("win05_centred_mean", f"""WITH {EVENTS}
SELECT series_id, tick, {q6('sum(value) OVER (PARTITION BY series_id ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10')} AS smooth FROM trace""")
def win05(spark, d):
    return wn.centred_mean(event_trace(spark, d), ["series_id"], "tick", "value", 10).select("series_id", "tick", r6("smooth").alias("smooth"))


@query("win06_trimmed_start", f"""WITH {USERS}, st AS (SELECT series_id, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM trace GROUP BY 1),
w AS (SELECT *, n < 6 OR p90 - p10 <= greatest(abs(p90) * 0.05, 1e-6) AS flat, greatest(3, least(7, n // 8)) AS w FROM st),
sm AS (SELECT t.series_id, t.tick, avg(u.value) AS m FROM trace t JOIN w USING (series_id) JOIN trace u ON u.series_id = t.series_id AND u.tick >= t.tick AND u.tick < t.tick + w WHERE t.tick + w <= n GROUP BY 1, 2),
b AS (SELECT w.series_id, CASE WHEN any_value(flat) THEN 0 ELSE coalesce(min(CASE WHEN m >= p10 + (p90 - p10) * 0.25 THEN tick END), 0) END AS start FROM w LEFT JOIN sm USING (series_id) GROUP BY 1)
SELECT series_id, tick, (tick - start)::DOUBLE AS x, start::DOUBLE AS trim_x, value FROM trace JOIN b USING (series_id) WHERE tick >= start""")
def win06(spark, d):
    t = user_trace(spark, d).withColumn("x", F.col("tick").cast("double"))
    return wn.trim_start(t, ["series_id"], "x", "value").select("series_id", "tick", "x", "trim_x", "value")


REPL = f"""h AS (SELECT user_id % 10 AS run, {HOUR} - (SELECT min({HOUR}) FROM events) AS hour, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS c FROM events GROUP BY 1, 2),
replicas AS (SELECT run, hour::DOUBLE AS elapsed_s, CASE WHEN hour % 11 = 0 THEN NULL ELSE c END AS ready, CASE WHEN hour % 13 = 0 THEN NULL ELSE c END AS desired FROM h)"""
FILLED = f"""{REPL}, filled AS (SELECT run, elapsed_s,
  coalesce(last_value(CASE WHEN ready >= 1 THEN ready END IGNORE NULLS) OVER w, 1)::INTEGER AS ready,
  coalesce(last_value(CASE WHEN desired >= 1 THEN desired END IGNORE NULLS) OVER w, 1)::INTEGER AS desired
  FROM replicas WINDOW w AS (PARTITION BY run ORDER BY elapsed_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def replicas(spark, d):
    e = events(spark, d).withColumn("__h", hour_of("ts"))
    first = e.agg(F.min("__h")).scalar()
    h = e.groupBy((F.col("user_id") % 10).alias("run"), (F.col("__h") - first).alias("hour")).agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("c"))
    return h.select("run", F.col("hour").cast("double").alias("elapsed_s"),
                    F.when(F.col("hour") % 11 != 0, F.col("c")).alias("ready"), F.when(F.col("hour") % 13 != 0, F.col("c")).alias("desired"))


@query("win07_forward_fill_valid", f"WITH {FILLED} SELECT * FROM filled")
def win07(spark, d):
    return wn.fill_valid(replicas(spark, d), ["run"], "elapsed_s", ["ready", "desired"])


@query("win08_change_points", f"""WITH {FILLED} SELECT run, elapsed_s, CASE WHEN s > 0 THEN 'up' ELSE 'down' END AS direction, s AS size
FROM (SELECT *, ready - lag(ready) OVER (PARTITION BY run ORDER BY elapsed_s) AS s FROM filled) WHERE s <> 0""")
def win08(spark, d):
    return wn.change_points(wn.fill_valid(replicas(spark, d), ["run"], "elapsed_s", ["ready", "desired"]), ["run"], "elapsed_s", "ready")


@query("agg40_flapping", f"""WITH {FILLED}, c AS (SELECT *, lag(ready) OVER (PARTITION BY run ORDER BY elapsed_s) AS p FROM filled),
f AS (SELECT *, min(CASE WHEN ready < p THEN elapsed_s END) OVER (PARTITION BY run ORDER BY elapsed_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fall FROM c)
SELECT run, count(CASE WHEN ready > p AND fall - elapsed_s <= 3 THEN 1 END) AS flapping_events FROM f GROUP BY 1""")
def agg40(spark, d):
    filled = wn.fill_valid(replicas(spark, d), ["run"], "elapsed_s", ["ready", "desired"])
    return wn.flapping(filled, ["run"], "elapsed_s", "ready", 3.0)


REGION = f"""WITH RECURSIVE {USERS}, {sampler('poll', 'trace', threshold=3.0)}, n AS (SELECT series_id, count(*) AS n FROM poll GROUP BY 1),
starts AS (SELECT series_id, unnest(range(0, n - 16 + 1, 4)) AS start FROM n WHERE n >= 16),
sc AS (SELECT s.series_id, s.start, count(CASE WHEN status IN ('OUTLIER', 'DRIFT_RESET') THEN 1 END) AS anomalies,
  count(CASE WHEN status IN ('OUTLIER', 'DRIFT_RESET') THEN 1 END) * 2.0 + max(urgency) * 16 + stddev_pop(urgency) * 16 AS score
  FROM starts s JOIN poll p ON p.series_id = s.series_id AND p.tick >= s.start AND p.tick < s.start + 16 GROUP BY 1, 2)"""


def region_scores(spark, d):
    poll = replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)]).select("series_id", "tick", "status", "urgency")
    return wn.region_scores(poll, ["series_id"], 16, 4)


@query("win09_region_scores", f"{REGION} SELECT series_id, start, anomalies, {q6('score')} AS score FROM sc")
def win09(spark, d):
    return rounded(region_scores(spark, d))


@query("str05_sliding_region_windows", f"{REGION} SELECT series_id, start, start + 16 AS stop, {q6('score')} AS score FROM sc")
def str05(spark, d):
    return region_scores(spark, d).select("series_id", "start", (F.col("start") + 16).alias("stop"), r6("score").alias("score"))


@query("top02_non_overlapping_regions")
def top02(spark, d):
    return rounded(pick_regions(region_scores(spark, d), ["series_id"], 16, 3, min_gap=16))


@query("win10_largest_variance_window", f"""WITH {EVENTS}, rates AS (SELECT series_id, tick, k, CASE k WHEN 0 THEN value ELSE value / 2 + tick % 7 END AS rate FROM trace, (SELECT unnest([0, 1]) AS k)),
v AS (SELECT series_id, k, tick AS start, var_pop(rate) OVER (PARTITION BY series_id, k ORDER BY tick ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS v,
  count(*) OVER (PARTITION BY series_id, k ORDER BY tick ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS c FROM rates),
t AS (SELECT series_id, start, sum(v) AS total FROM v WHERE c = 50 GROUP BY 1, 2)
SELECT series_id, max_by(start, total) AS start, {q6('max(total)')} AS total_variance FROM t GROUP BY 1""")
def win10(spark, d):
    t = event_trace(spark, d)
    rates = t.select("series_id", "tick", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("value").alias("rate")),
        F.struct(F.lit(1).alias("k"), (F.col("value") / 2 + F.col("tick") % 7).alias("rate")))).alias("e")).select("series_id", "tick", "e.*")
    return rounded(wn.best_variance_window(rates, ["series_id"], "k", "rate", 50))


@query("win12_running_extremes", f"WITH {EVENTS} SELECT series_id, tick, min(value) OVER w AS low, max(value) OVER w AS high FROM trace WINDOW w AS (PARTITION BY series_id ORDER BY tick)")
def win12(spark, d):
    return scan(event_trace(spark, d), ["series_id"], ["tick"], {"low": running_min(F.col("value")), "high": running_max(F.col("value"))}, "tick").select(
        "series_id", "tick", "low", "high")


@query("win13_history_median", f"""WITH o AS (SELECT {HOUR} AS hour, count(*) AS ops FROM events GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY hour) - 1 AS pos FROM o)
SELECT a.pos, any_value(a.ops) AS ops, list_sort(list(b.ops))[CAST(count(*) // 2 AS INTEGER) + 1] AS median_ops FROM s a JOIN s b ON b.pos <= a.pos AND b.pos > a.pos - 300 GROUP BY 1""")
def win13(spark, d):
    ops = events(spark, d).groupBy(hour_of("ts").alias("hour")).agg(F.count(F.lit(1)).alias("ops"))
    pos = number_rows(ops, [], ["hour"], "pos")
    return wn.history_median(pos, [], "pos", "ops", 300, "median_ops").select("pos", "ops", "median_ops")


@query("win14_crossed_schedule_events", f"""WITH {PHASES}, clock AS (SELECT CAST(user_id AS VARCHAR) AS shape, event_id * 0.75 AS at FROM events),
edges AS (SELECT shape, 'phase_start' AS event, name AS phase, start_s AS at FROM phases UNION ALL SELECT shape, 'phase_end', name, end_s FROM phases
  UNION ALL SELECT DISTINCT shape, 'load_start', NULL, 0.0::DOUBLE FROM phases UNION ALL SELECT shape, 'load_end', NULL, max(end_s) FROM phases GROUP BY 1)
SELECT e.shape, event, phase, e.at AS scheduled_offset_s, min(c.at)::DOUBLE AS seen_at FROM edges e JOIN clock c ON c.shape = e.shape AND c.at >= e.at GROUP BY 1, 2, 3, 4""")
def win14(spark, d):
    clock = events(spark, d).select(F.col("user_id").cast("string").alias("shape"), (F.col("event_id") * 0.75).alias("elapsed_s"))
    return sc.crossed_boundaries(note_short(clock, "shape"), phases(spark, d), ["shape"])


@query("win15_transition_windows", f"""WITH {PHASES}, m AS (SELECT *, min(start_s) OVER (PARTITION BY shape, direction ORDER BY start_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM phases WHERE direction <> 'stable'),
e AS (SELECT shape, max(end_s) AS last FROM phases GROUP BY 1)
SELECT shape, name, direction, start_s, coalesce(nxt, last) AS window_end_s FROM m JOIN e USING (shape)""")
def win15(spark, d):
    return sc.transition_windows(phases(spark, d), ["shape"]).select("shape", "name", "direction", "start_s", "window_end_s")


@query("win15_directional_windows", f"""WITH {PHASES}, m AS (SELECT *, min(CASE WHEN direction <> 'stable' THEN start_s END) OVER (PARTITION BY shape ORDER BY start_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM phases),
e AS (SELECT shape, max(end_s) AS last FROM phases GROUP BY 1)
SELECT shape, name, start_s, coalesce(nxt, last) AS window_end_s FROM m JOIN e USING (shape) WHERE direction = 'up'""")
def win15_up(spark, d):
    return sc.directional_windows(phases(spark, d), ["shape"], "up").select("shape", "name", "start_s", "window_end_s")


@query("top01_capped_points", f"WITH {EVENTS} SELECT series_id, tick, value FROM trace WHERE tick < 500")
def top01(spark, d):
    return event_trace(spark, d).where(F.col("tick") < 500).select("series_id", "tick", "value")


@query("top04_spike_rows", f"""WITH {EVENTS}, p AS (SELECT series_id, quantile_cont(value, 0.99) AS q FROM trace GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, tick DESC) AS rk FROM trace JOIN p USING (series_id) WHERE value >= q)
SELECT series_id, tick, value FROM r WHERE rk <= 12""")
def top04(spark, d):
    return iv.top_spikes(event_trace(spark, d), ["series_id"], "value", 12).select("series_id", "tick", "value")


@query("str10_consecutive_alarm", f"""WITH {USERS}, f AS (SELECT *, value > 40 AS hot FROM trace),
g AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY tick) AS island FROM f)
SELECT series_id, tick, hot AND row_number() OVER (PARTITION BY series_id, island, hot ORDER BY tick) >= 2 AS alarm FROM g""")
def str10(spark, d):
    return sustained(user_trace(spark, d), ["series_id"], "tick", F.col("value") > 40, 2).select("series_id", "tick", "alarm")
