"""Queries: tracker, sampler and literature policies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import r6
from tickloom.operators.masks import bernoulli, even_positions, n_of_m
from tickloom.operators.policies import haar_sparsity
from tickloom.operators.replay import masked_replay, replay
from tickloom.params import make_config
from tickloom.plans.fidelity import rounded
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import (D, EVENTS, MASKED, REVENUE, USERS, linear_interval, masked_tracker,
                                    sampler, tracker)
from tickloom.sources.tables import event_trace, revenue_trace, table, user_trace

TICK = "series_id, tick, status, {m} AS mean, {s} AS std, {z} AS z_score"


def _ticks(std: str) -> str:
    return TICK.format(m=q6("mean"), s=q6(std), z=q6("z_score"))


def _tick_cols(df, *more):
    return rounded(df.select("series_id", "tick", *more, "status", "mean", "std", "z_score"))


@query("sta01_tracker", f"""WITH RECURSIVE {EVENTS}, {tracker('dense', 'trace')}
SELECT {_ticks('sqrt(var)')}, {q6('alpha')} AS alpha FROM dense""")
def sta01(spark, d):
    return _tick_cols(replay(event_trace(spark, d), [make_config()], "dense"), "alpha")


@query("sta01_tracker_smooth_signal", f"""WITH RECURSIVE {REVENUE}, {tracker('dense', 'trace', threshold=3.0)}
SELECT {_ticks('sqrt(var)')}, {q6('alpha')} AS alpha FROM dense""")
def sta01_smooth(spark, d):
    return _tick_cols(replay(revenue_trace(spark, d), [make_config(outlier_threshold=3.0)], "dense"), "alpha")


def _poll_sql(source: str, **kw) -> str:
    return f"""WITH RECURSIVE {source}, {sampler('poll', 'trace', **kw)}
SELECT {_ticks('std')}, sampled, interval, {q6('urgency')} AS urgency FROM poll"""


POLL = ("sampled", "interval", "urgency")


@query("sta02_urgency_sampler", _poll_sql(EVENTS))
def sta02(spark, d):
    return _tick_cols(replay(event_trace(spark, d), [make_config()]), *POLL)


@query("sta02_urgency_sampler_smooth_signal", _poll_sql(REVENUE, threshold=3.0))
def sta02_smooth(spark, d):
    return _tick_cols(replay(revenue_trace(spark, d), [make_config(outlier_threshold=3.0)]), *POLL)


@query("sta02_urgency_sampler_io_profile",
       _poll_sql(EVENTS, threshold=1.0, floor=1.0, hi=10, positive_only=True))
def sta02_io(spark, d):
    cfg = make_config(initial_variance_floor=1.0, warmup_positive_std_only=True, max_interval=10)
    return _tick_cols(replay(event_trace(spark, d), [cfg]), *POLL)


@query("sta03_always_sample_urgency", _poll_sql(USERS, mode="feed", threshold=3.0))
def sta03(spark, d):
    return _tick_cols(replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)], "always_sample"), *POLL)


@query("sta04_fixed_urgency_replay", f"""WITH RECURSIVE {USERS},
{sampler('feed', 'trace', mode='feed', threshold=3.0)},
plan AS (SELECT series_id, tick, value, urgency, {linear_interval('urgency', 1, 20)} AS interval FROM feed),
walk AS (
  SELECT series_id, tick, value, urgency, interval, TRUE AS sampled, 0 AS steps FROM plan WHERE tick = 0
  UNION ALL
  SELECT p.series_id, p.tick, p.value, p.urgency, p.interval, w.steps + 1 >= p.interval,
         CASE WHEN w.steps + 1 >= p.interval THEN 0 ELSE w.steps + 1 END
  FROM walk w JOIN plan p ON p.series_id = w.series_id AND p.tick = w.tick + 1),
{masked_tracker('seen', 'walk', threshold=3.0)}
SELECT {TICK.format(m=q6('mean'), s=q6('std'), z=q6('z_score'))}, sampled, interval, {q6('urgency')} AS urgency
FROM seen JOIN (SELECT series_id, tick, interval, urgency FROM walk) USING (series_id, tick)""")
def sta04(spark, d):
    cfg = make_config(outlier_threshold=3.0)
    trace = replay(user_trace(spark, d), [cfg], "always_sample").select("series_id", "tick", "value", "urgency")
    return _tick_cols(replay(trace, [cfg], "scheduled_urgency", aux=("urgency",)), *POLL)


@query("sta05_mask_fed_tracker", f"""WITH RECURSIVE {EVENTS}, {MASKED}, {masked_tracker('seen', 'kept', threshold=3.0)}
SELECT {TICK.format(m=q6('mean'), s=q6('std'), z=q6('z_score'))}, sampled FROM seen""")
def sta05(spark, d):
    trace = event_trace(spark, d).withColumn("sampled", n_of_m(F.col("tick"), 2, 5)).withColumn("interval", F.lit(3))
    return _tick_cols(masked_replay(trace, make_config(outlier_threshold=3.0)), "sampled")


@query("sta06_wavelet_rate")
def sta06(spark, d):
    return _tick_cols(replay(event_trace(spark, d), [make_config()], "wavelet_rate"), *POLL)


@query("sta07_evenly_spaced_ticks", f"""WITH {USERS}, sizes AS (
  SELECT series_id, count(*) AS n, greatest(1, count(*) // 3) AS k FROM trace GROUP BY 1)
SELECT DISTINCT series_id, CAST(CASE WHEN k <= 1 THEN 0 ELSE round_even(i * ((n - 1)::DOUBLE / (k - 1)), 0) END AS BIGINT) AS tick
FROM (SELECT series_id, n, k, unnest(range(k)) AS i FROM sizes)""")
def sta07(spark, d):
    sizes = user_trace(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return sizes.select("series_id", F.explode(even_positions(F.col("n"), k)).alias("tick"))


@F.pandas_udf(T.IntegerType())
def _sparsity(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: haar_sparsity(b, 0.995)).astype("int32")


@query("sta08_haar_sparsity")
def sta08(spark, d):
    block = event_trace(spark, d).withColumn("block", F.floor(F.col("tick") / 64))
    values = F.transform(F.array_sort(F.collect_list(F.struct("tick", "value"))), lambda x: x["value"])
    return block.groupBy("series_id", "block").agg(values.alias("v")).select(
        "series_id", "block", _sparsity("v").alias("sparsity"))


@query("sta09_predictive_frequency", f"""WITH RECURSIVE {EVENTS}, walk AS (
  SELECT series_id, tick, value, TRUE AS sampled, every, every - 1 AS k_left, value AS k_prev, 0.0{D} AS k_inno, scale AS k_scale
  FROM (SELECT *, CASE WHEN 0 * 20 <= 0.1{D} * greatest(scale, 1e-8) THEN 20 ELSE 1 END AS every
        FROM (SELECT *, 0.2{D} * abs(value) + (1{D} - 0.2{D}) * 0 AS scale FROM trace WHERE tick = 0))
  UNION ALL
  SELECT series_id, tick, value, take, every1, CASE WHEN take THEN every1 - 1 ELSE k_left - 1 END,
         CASE WHEN take THEN value ELSE k_prev END, inno1, scale1
  FROM (SELECT *, CASE WHEN take AND abs(target - every) / greatest(1, every){D} >= 0.2{D} THEN target ELSE every END AS every1
    FROM (SELECT *, CASE WHEN inno1 * 20 <= lim THEN 20 WHEN inno1 * 16 <= lim THEN 16 WHEN inno1 * 8 <= lim THEN 8
                         WHEN inno1 * 4 <= lim THEN 4 WHEN inno1 * 2 <= lim THEN 2 ELSE 1 END AS target
      FROM (SELECT *, 0.1{D} * greatest(scale1, 1e-8) AS lim
        FROM (SELECT *, CASE WHEN take THEN 0.2{D} * (abs(value - k_prev) / greatest(1, every)) + (1{D} - 0.2{D}) * k_inno ELSE k_inno END AS inno1,
                     CASE WHEN take THEN 0.2{D} * abs(value) + (1{D} - 0.2{D}) * k_scale ELSE k_scale END AS scale1
          FROM (SELECT t.series_id, t.tick, t.value, w.every, w.k_left, w.k_prev, w.k_inno, w.k_scale, w.k_left <= 0 AS take
                FROM walk w JOIN trace t ON t.series_id = w.series_id AND t.tick = w.tick + 1))))))
SELECT series_id, tick, sampled, CAST(every AS INTEGER) AS interval FROM walk""")
def sta09(spark, d):
    return replay(event_trace(spark, d), [make_config()], "predictive_frequency").select(
        "series_id", "tick", "sampled", "interval")


@query("sta10_robust_exponential", f"""WITH RECURSIVE {EVENTS}, walk AS (
  SELECT series_id, tick, TRUE AS sampled, 1 AS every, 0 AS k_left, [value] AS hist, 0 AS stable FROM trace WHERE tick = 0
  UNION ALL
  SELECT series_id, tick, take, every1, CASE WHEN take THEN every1 - 1 ELSE k_left - 1 END,
         CASE WHEN NOT take THEN hist WHEN len(hist) < 20 THEN list_append(hist, value) ELSE list_append(hist[2:], value) END,
         CASE WHEN NOT take THEN stable WHEN len(hist) < 20 OR far THEN 0 WHEN stable + 1 >= 3 THEN 0 ELSE stable + 1 END
  FROM (SELECT *, CASE WHEN NOT take THEN every WHEN len(hist) < 20 THEN 1
                       WHEN far THEN greatest(1, CAST(ceil(every / 2.0) AS INTEGER))
                       WHEN stable + 1 >= 3 THEN least(20, every * 2) ELSE every END AS every1
    FROM (SELECT *, abs(value - med) / CASE WHEN 1.4826{D} * mad <= 1e-12 THEN greatest(1e-8, 0.01{D} * greatest(1, abs(med)))
                                        ELSE 1.4826{D} * mad END > 3 AS far
      FROM (SELECT *, list_aggregate(list_transform(hist, lambda h: abs(h - med)), 'median') AS mad
        FROM (SELECT t.series_id, t.tick, t.value, w.every, w.k_left, w.hist, w.stable, w.k_left <= 0 AS take,
                     list_aggregate(w.hist, 'median') AS med
              FROM walk w JOIN trace t ON t.series_id = w.series_id AND t.tick = w.tick + 1)))))
SELECT series_id, tick, sampled, CAST(every AS INTEGER) AS interval FROM walk""")
def sta10(spark, d):
    return replay(event_trace(spark, d), [make_config()], "robust_exponential").select(
        "series_id", "tick", "sampled", "interval")


@query("sta11_time_or_variation", f"""WITH RECURSIVE {EVENTS}, walk AS (
  SELECT series_id, tick, TRUE AS sampled, 1 AS interval, value AS prev, 0.0{D} AS acc, 20 AS timer, 0 AS last FROM trace WHERE tick = 0
  UNION ALL
  SELECT series_id, tick, fire, CAST(CASE WHEN fire THEN greatest(1, tick - last) ELSE 20 END AS INTEGER), value,
         CASE WHEN fire THEN 0.0 ELSE acc1 END,
         CASE WHEN tick >= timer THEN timer + 20 * ((tick - timer) // 20 + 1) ELSE timer END,
         CASE WHEN fire THEN tick ELSE last END
  FROM (SELECT *, tick >= timer OR abs(acc1) >= 120.0{D} AS fire
    FROM (SELECT t.series_id, t.tick, t.value, w.timer, w.last, w.acc + (t.value - w.prev) AS acc1
          FROM walk w JOIN trace t ON t.series_id = w.series_id AND t.tick = w.tick + 1)))
SELECT series_id, tick, sampled, interval FROM walk""")
def sta11(spark, d):
    cfg = {**make_config(), "variation_threshold": 120.0}
    return replay(event_trace(spark, d), [cfg], "time_or_variation").select(
        "series_id", "tick", "sampled", "interval")


@query("sta11_time_or_variation_calibrated")
def sta11_auto(spark, d):
    return replay(event_trace(spark, d), [make_config()], "time_or_variation").select(
        "series_id", "tick", "sampled", "interval")


@query("sta12_n_of_m", f"WITH {EVENTS} SELECT series_id, tick, (tick * 3 + 1) % 7 < 3 AS sampled FROM trace")
def sta12(spark, d):
    return event_trace(spark, d).select("series_id", "tick", n_of_m(F.col("tick"), 3, 7, 1).alias("sampled"))


UNIFORM = "(CAST('0x' || substr(md5({x}), 1, 8) AS UBIGINT) / 4294967296.0)"


@query("sta13_bernoulli_requests", f"""SELECT event_id AS event_index, TRUE AS full_selected,
  {UNIFORM.format(x="'1:' || event_id")} < 0.5 AS uniform_selected FROM events""")
def sta13(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("event_index"), F.lit(True).alias("full_selected"),
        bernoulli(0.5, 1, F.col("event_id")).alias("uniform_selected"))


@query("sta18_fleet_dual_tracking", f"""WITH RECURSIVE {USERS}, {tracker('dense', 'trace', threshold=3.0)},
{sampler('poll', 'trace', threshold=3.0)}
SELECT p.series_id AS container, p.tick, {q6('d.mean')} AS full_mean, p.sampled, {q6('p.mean')} AS mean
FROM poll p JOIN dense d USING (series_id, tick)""")
def sta18(spark, d):
    trace = user_trace(spark, d).withColumnRenamed("series_id", "container")
    cfg = [make_config(outlier_threshold=3.0)]
    dense = replay(trace, cfg, "dense", ["container"]).select(
        "container", "tick", r6("mean").alias("full_mean"))
    kept = replay(trace, cfg, "urgency_adaptive", ["container"]).select(
        "container", "tick", "sampled", r6("mean").alias("mean"))
    return kept.join(dense, ["container", "tick"])


@query("sta19_live_counter_replay", _poll_sql(EVENTS, mode="live", threshold=3.0))
def sta19(spark, d):
    return _tick_cols(replay(event_trace(spark, d), [make_config(outlier_threshold=3.0)], "live_counter"), *POLL)
