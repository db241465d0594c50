"""Queries: streams of the event table that arrive in steps and out of order, drained.

A last step holds rows of no key far in the future, so that the watermark passes all others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import r6
from tickloom.operators.replay import replay
from tickloom.params import make_config
from tickloom.plans.inputs import HOUR, events, hour_of
from tickloom.plans.registry import q6, query
from tickloom.plans.windows import REGION, USERS, user_trace
from tickloom.streaming.drain import drain_steps
from tickloom.streaming.late import alarms, counts_with_late_rows, state_in_rocksdb
from tickloom.streaming.windows import sliding_scores, tumbling_counts, unmatched_within

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
END_S = 4_000_000_000  # seconds: after all events


def arriving(spark, d, step_of):
    """The events in three steps, and a closing one with a row of every kind and no user."""
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("step", step_of)
    last = e.select("event_type").distinct().select(*[
        (F.col(c) if c == "event_type" else F.timestamp_seconds(F.lit(END_S)) if c == "ts" else F.lit(-1) if c == "user_id" else F.lit(None)).cast(e.schema[c].dataType).alias(c)
        for c in e.columns if c != "step"])
    return [e.where(F.col("step") == i).drop("step") for i in range(3)] + [last]


def shuffled():
    return F.pmod("event_id", F.lit(3))


@query("str04_tumbling_counts_streamed", """SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def str04_streamed(spark, d):
    counts = lambda s: tumbling_counts(s, "ts", "1 hour", ["event_type"], ["click", "view"], delay="400 days")
    return drain_steps(arriving(spark, d, shuffled()), counts).where(F.unix_seconds("start") < END_S - 3600).select(
        "event_type", F.unix_millis("start").alias("start_ms"), "n")


def traced(rows, key, columns):
    """A trace on a time axis of one second a tick, in three steps by tick and a closing one."""
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("tick") + 1_000_000_000)).select(key, "tick", "ts", *columns)
    step = F.least(F.lit(2), F.floor((F.col("tick") + 3 * (F.col("tick") % 3)) / 8))
    last = rows.sparkSession.range(1).select(*[
        (F.lit("") if c == key else F.timestamp_seconds(F.lit(END_S)) if c == "ts" else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return [rows.where(step == i) for i in range(3)] + [last]


@query("str05_sliding_regions_streamed", f"{REGION} SELECT series_id, start, start + 16 AS stop, anomalies, {q6('score')} AS score FROM sc")
def str05_streamed(spark, d):
    poll = replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)]).select("series_id", "tick", "status", "urgency")
    odd = F.col("status").isin("OUTLIER", "DRIFT_RESET")
    scores = lambda s: sliding_scores(s, "ts", "16 seconds", "4 seconds", ["series_id"], odd, "urgency", 16.0, delay="20 seconds")
    start = F.unix_seconds("start") - 1_000_000_000
    return (drain_steps(traced(poll, "series_id", ["status", "urgency"]), scores)
            .where((F.col("series_id") != "") & (F.col("n") == 16))
            .select("series_id", start.alias("start"), (start + 16).alias("stop"), F.col("anomalies").cast("long").alias("anomalies"), r6("score").alias("score")))


HORIZON, WAIT_H = 600, 48
STEPPED = f"""r AS (SELECT user_id % 10 AS run, {HOUR} - (SELECT min({HOUR}) FROM events) AS second, ts,
  CASE WHEN event_id % 10 = 0 THEN 2 ELSE least(2, ({HOUR} - (SELECT min({HOUR}) FROM events)) // 240) END AS step FROM events),
seen AS (SELECT s.step, max(epoch_ms(r.ts)) - {WAIT_H * HOUR_MS} AS watermark FROM (SELECT unnest([1, 2]) AS step) s JOIN r ON r.step < s.step GROUP BY 1),
m AS (SELECT run, least(second, {HORIZON}) AS second, second > {HORIZON} AS capped,
  coalesce(second < {HORIZON} AND ((SELECT min({HOUR}) FROM events) + second + 1) * {HOUR_MS} <= watermark, FALSE) AS late FROM r LEFT JOIN seen USING (step))"""


@query("str07_late_requests_streamed", f"""WITH {STEPPED} SELECT run, second, late, count(*) AS requests, count(CASE WHEN capped THEN 1 END) AS capped FROM m GROUP BY 1, 2, 3""")
def str07_streamed(spark, d):
    first = events(spark, d).agg(F.min(hour_of("ts"))).first()[0] or 0
    second = hour_of("ts") - first
    steps = arriving(spark, d, F.when(F.col("event_id") % 10 == 0, 2).otherwise(F.least(F.lit(2), F.floor(second / 240))))
    hour = F.floor(F.unix_millis("ts") / HOUR_MS) - first

    def counted(s):
        rows = s.withColumn("run", F.col("user_id") % 10).withColumn("second", hour)
        return counts_with_late_rows(rows, "run", "second", "ts", first * HOUR_MS, HOUR_MS, HORIZON, WAIT_H * HOUR_MS, 400 * DAY_MS, 400 * DAY_MS)

    with state_in_rocksdb(spark):
        found = drain_steps(steps, counted)
    return (found.where("run >= 0").groupBy("run", "second", "late")
            .agg(F.sum("n").alias("requests"), F.sum("capped").alias("capped")))


@query("str08_operations_streamed", f"""WITH r AS (SELECT user_id % 10 AS run, {HOUR} AS hour FROM events) SELECT run, hour, count(*) AS n FROM r GROUP BY 1, 2""")
def str08_streamed(spark, d):
    counts = lambda s: tumbling_counts(s.withColumn("run", F.col("user_id") % 10), "ts", "1 hour", ["run"], delay="400 days")
    return drain_steps(arriving(spark, d, shuffled()), counts).where("run >= 0").select(
        "run", F.floor(F.unix_millis("start") / HOUR_MS).alias("hour"), "n")


@query("str09_samples_within_delay_streamed", """WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
j AS (SELECT v.user_id, v.event_id, count(c.ts) AS n FROM v LEFT JOIN c ON c.user_id = v.user_id AND c.ts <= v.ts AND c.ts > v.ts - INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT user_id % 20 AS run, count(*) AS n_published, count(CASE WHEN n = 0 THEN 1 END) AS n_stale, CAST(sum(n) AS BIGINT) AS n_samples FROM j GROUP BY 1""")
def str09_streamed(spark, d):
    slim = [s.select("user_id", "event_id", "event_type", "ts") for s in arriving(spark, d, shuffled())]

    def joined(s):
        kind = lambda k: s.where(F.col("event_type") == k)
        return unmatched_within(kind("view"), kind("click"), ["user_id"], "ts", "24 HOURS", "400 days", "event_id")

    found = drain_steps(slim, joined).where("user_id >= 0")
    return (found.groupBy("user_id", "event_id").agg(F.count("matched_event_id").alias("n"))
            .groupBy((F.col("user_id") % 20).alias("run"))
            .agg(F.count(F.lit(1)).alias("n_published"), F.count(F.when(F.col("n") == 0, 1)).alias("n_stale"), F.sum("n").alias("n_samples")))


@query("str10_alarm_streamed", f"""WITH {USERS}, f AS (SELECT *, value > 40 AS hot FROM trace),
g AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY tick) AS island FROM f)
SELECT series_id, tick, hot AND row_number() OVER (PARTITION BY series_id, island, hot ORDER BY tick) >= 2 AS alarm FROM g""")
def str10_streamed(spark, d):
    rows = traced(user_trace(spark, d), "series_id", ["value"])
    over = F.col("value") > 40
    found = drain_steps(rows, lambda s: alarms(s.withWatermark("ts", "20 seconds"), ["series_id"], "tick", "ts", over, 2))
    return found.where("series_id <> ''")
