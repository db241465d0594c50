"""Queries: counters to rates, alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import r6
from tickloom.operators import counters as ct
from tickloom.operators.scans import running_sum, scan
from tickloom.plans.fidelity import rounded
from tickloom.plans.inputs import HOUR, SEC, events, hour_of, sec_of
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import EVENTS, USERS
from tickloom.session import is_short, mark_short
from tickloom.sources.json_traces import tick_spine
from tickloom.sources.tables import event_trace, user_trace

# counters per event type: running sums over the ticks of a series
SNAP = f"""{EVENTS}, snaps AS (
  SELECT series_id, tick, {SEC} AS sec,
    CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) OVER w AS BIGINT) AS total,
    CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT) * (tick % 3) // 4) OVER w AS BIGINT) AS idle,
    CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT) * (tick % 2) // 5) OVER w AS BIGINT) AS iowait
  FROM trace WINDOW w AS (PARTITION BY series_id ORDER BY tick))"""


def snapshots(spark, d):
    t = event_trace(spark, d).withColumn("c", F.rint(F.col("value") * 100).cast("long"))
    idle = F.expr("c * (tick % 3) div 4")
    wait = F.expr("c * (tick % 2) div 5")
    w = scan(t, ["series_id"], ["tick"], {
        "total": running_sum(F.col("c")), "idle": running_sum(idle), "iowait": running_sum(wait)}, "tick")
    return w.select("series_id", "tick", sec_of("ts").alias("sec"), "total", "idle", "iowait")


@query("ctr01_busy_percent", f"""WITH {SNAP}
SELECT series_id, tick, {q6('CASE WHEN dt IS NULL THEN NULL WHEN dt = 0 THEN 0.0 ELSE (1.0 - di / dt::DOUBLE) * 100 END')} AS busy_pct FROM (
  SELECT *, total - lag(total) OVER w AS dt, (idle + iowait) - lag(idle + iowait) OVER w AS di FROM snaps WINDOW w AS (PARTITION BY series_id ORDER BY tick))""")
def ctr01(spark, d):
    return ct.busy_percent(snapshots(spark, d), ["series_id"], "tick", "tick").select("series_id", "tick", r6("busy_pct").alias("busy_pct"))


@query("ctr02_memory_gauge", f"""SELECT event_id, {q6("(1.0 - (CASE WHEN event_type = 'error' THEN value / 2 ELSE value END) / 500.0) * 100")} AS used_pct FROM events""")
def ctr02(spark, d):
    available = F.when(F.col("event_type") != "error", F.col("value"))
    return events(spark, d).select("event_id", r6(ct.used_percent(F.lit(500.0), available, F.col("value") / 2)).alias("used_pct"))


# one snapshot per hour and device, the device counters running over the hours
DEVICES = f"""hourly AS (SELECT {HOUR} AS hour, event_type AS device, sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS amount FROM events GROUP BY 1, 2),
hours AS (SELECT DISTINCT hour FROM hourly), names AS (SELECT DISTINCT device FROM hourly),
counters AS (SELECT hour, device, CAST(sum(coalesce(amount, 0)) OVER (PARTITION BY device ORDER BY hour) AS BIGINT) AS counter
  FROM hours CROSS JOIN names LEFT JOIN hourly USING (hour, device))"""


def device_counters(spark, d):
    amount = F.sum(F.rint(F.col("value") * 100).cast("long")).alias("amount")
    e = events(spark, d)
    hourly = e.groupBy(hour_of("ts").alias("hour"), F.col("event_type").alias("device")).agg(amount)
    wide = hourly.groupBy("hour").pivot("device", ["click", "error", "purchase", "signup", "view"]).agg(F.first("amount"))
    long = wide.select("hour", F.explode(F.array(*[
        F.struct(F.lit(c).alias("device"), F.coalesce(F.col(c), F.lit(0)).alias("amount")) for c in wide.columns[1:]])).alias("s"))
    return scan(long.select("hour", "s.*"), ["device"], ["hour"], {"counter": running_sum(F.col("amount"))}).select("hour", "device", "counter")


def _rate(keep: str) -> str:
    return f"""WITH {DEVICES}, s AS (SELECT hour, CAST(sum(counter) AS BIGINT) AS total FROM counters WHERE {keep} GROUP BY 1)
SELECT hour, {q6('CASE WHEN dh IS NULL THEN NULL WHEN dh <= 0 THEN 0.0 ELSE dt / dh::DOUBLE END')} AS rate FROM (
  SELECT *, total - lag(total) OVER (ORDER BY hour) AS dt, (hour - lag(hour) OVER (ORDER BY hour)) * 3600 AS dh FROM s)"""


@query("ctr03_disk_operations_rate", _rate("device NOT LIKE 'view%' AND device NOT LIKE 'signup%'"))
def ctr03(spark, d):
    keep = ~(F.col("device").startswith("view") | F.col("device").startswith("signup"))
    return rounded(ct.summed_rate(device_counters(spark, d), [], "hour", F.col("hour") * 3600, F.col("counter"), keep))


@query("ctr04_network_bytes_rate", _rate("device <> 'click'").replace("sum(counter)", "sum(counter + 2 * counter)"))
def ctr04(spark, d):
    return rounded(ct.summed_rate(device_counters(spark, d), [], "hour", F.col("hour") * 3600,
                                  F.col("counter") + 2 * F.col("counter"), F.col("device") != "click"))


CGROUP = f"""{USERS}, snaps AS (
  SELECT series_id AS cgroup, tick, {SEC} AS sec, CAST(sum(CAST(round_even(value * 1e6, 0) AS BIGINT)) OVER (PARTITION BY series_id ORDER BY tick) AS BIGINT) AS usage_us FROM trace)"""


def cgroups(spark, d):
    t = user_trace(spark, d).withColumn("us", F.rint(F.col("value") * 1e6).cast("long"))
    c = scan(t, ["series_id"], ["tick"], {"usage_us": running_sum(F.col("us"))}, "tick").select(
        F.col("series_id").alias("cgroup"), "tick", sec_of("ts").alias("sec"), "usage_us")
    return mark_short(c, ["cgroup"]) if is_short(t, ["series_id"]) else c  # the note names the key it was counted by


@query("ctr05_cgroup_cpu_fraction", f"""WITH {CGROUP}
SELECT cgroup, tick, {q6('CASE WHEN ds <= 0 THEN 0.0 ELSE du / 1e6 / ds END')} AS cpu_fraction FROM (
  SELECT *, usage_us - lag(usage_us) OVER w AS du, sec - lag(sec) OVER w AS ds FROM snaps WINDOW w AS (PARTITION BY cgroup ORDER BY tick))""")
def ctr05(spark, d):
    return ct.cpu_fraction(cgroups(spark, d), ["cgroup"], "tick", "usage_us", "sec", "tick").select(
        "cgroup", "tick", r6("cpu_fraction").alias("cpu_fraction"))


@query("ctr06_cgroup_memory", f"""SELECT event_id, {q6('CASE WHEN user_id % 2 = 1 THEN value * 1e6 / 5e8 * 100 ELSE value * 1e6 / 1048576.0 END')} AS used FROM events""")
def ctr06(spark, d):
    limit = F.when(F.col("user_id") % 2 == 1, F.lit(5e8)).otherwise(F.lit(0.0))
    return events(spark, d).select("event_id", r6(ct.memory_use(F.col("value") * 1e6, limit)).alias("used"))


@query("ctr07_fleet_cpu", f"""WITH f AS (
  SELECT {HOUR} AS hour, CAST(user_id AS VARCHAR) AS member, {SEC} AS sec, value, event_id FROM events),
snaps AS (SELECT hour, member, max(hour) * 3600.0 AS sec, CAST(max(CAST(round_even(value * 1e6, 0) AS BIGINT)) AS BIGINT) AS usage_us FROM f GROUP BY 1, 2),
d AS (SELECT *, usage_us - lag(usage_us) OVER w AS du, sec - lag(sec) OVER w AS ds FROM snaps WINDOW w AS (PARTITION BY member ORDER BY hour)),
ok AS (SELECT hour, member, du / 1e6 / ds * 100 AS pct FROM d WHERE du >= 0 AND ds > 0)
SELECT hour, member, {q6('sum(pct)')} AS cpu_pct FROM ok GROUP BY GROUPING SETS ((hour, member), (hour))""")
def ctr07(spark, d):
    snaps = events(spark, d).groupBy(hour_of("ts").alias("hour"), F.col("user_id").cast("string").alias("member")).agg(
        F.max(F.rint(F.col("value") * 1e6).cast("long")).alias("usage_us")).withColumn("sec", F.col("hour") * 3600.0)
    return rounded(ct.fleet_cpu(snaps, "member", "hour", "usage_us", "sec"))


@query("ctr08_counts_per_base_tick", f"""WITH n AS (SELECT {HOUR} AS hour, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
spine AS (SELECT unnest(range(lo, hi + 1)) AS hour FROM (SELECT min(hour) AS lo, max(hour) AS hi FROM n))
SELECT hour, coalesce(n, 0) AS n FROM spine LEFT JOIN n USING (hour)""")
def ctr08(spark, d):
    counts = events(spark, d).where(F.col("event_type").isin("click", "view")).groupBy(
        hour_of("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = tick_spine(bounds, F.col("lo"), F.col("hi"), "hour").select("hour")
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


ACCT = f"""{SNAP}, a AS (SELECT series_id, tick, total, total - idle AS busy, iowait AS own, tick // 500 AS identity FROM snaps),
d AS (SELECT *, total - lag(total) OVER w AS dt, busy - lag(busy) OVER w AS db, own - lag(own) OVER w AS dw, identity <> lag(identity) OVER w AS changed
      FROM a WINDOW w AS (PARTITION BY series_id ORDER BY tick)),
j AS (SELECT *, dt <= 0 OR db < 0 OR dw < 0 OR changed AS bad FROM d WHERE dt IS NOT NULL)"""


def accounting(spark, d):
    s = snapshots(spark, d).select("series_id", "tick", "total", (F.col("total") - F.col("idle")).alias("busy"),
                                   F.col("iowait").alias("own"), F.expr("tick div 500").alias("identity"))
    return ct.interval_accounting(s, ["series_id"], "tick", "tick")


@query("ctr09_interval_accounting", f"""WITH {ACCT}
SELECT series_id, tick, db AS busy_ticks, dw AS own_ticks, greatest(0.0, db - dw)::DOUBLE AS foreign_ticks, {q6('db / dt::DOUBLE')} AS busy_fraction,
  {q6('dw / dt::DOUBLE')} AS own_fraction, {q6('greatest(0.0, db - dw) / dt::DOUBLE')} AS foreign_fraction FROM j WHERE NOT bad""")
def ctr09(spark, d):
    return rounded(accounting(spark, d)[0])


@query("ctr09_rejected_intervals", f"WITH {ACCT} SELECT series_id, tick FROM j WHERE bad")
def ctr09_rejected(spark, d):
    return accounting(spark, d)[1]


ALARM = f"""WITH {EVENTS}, f AS (SELECT *, value > 60 AS hot FROM trace),
g AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY tick) AS island FROM f)
SELECT series_id, tick, value, hot AND row_number() OVER (PARTITION BY series_id, island, hot ORDER BY tick) >= 3 AS alarm FROM g"""


@query("ctr10_sustained_alarm", ALARM)
def ctr10(spark, d):
    return ct.sustained(event_trace(spark, d), ["series_id"], "tick", F.col("value") > 60, 3).select("series_id", "tick", "value", "alarm")


@query("ctr11_process_cpu", f"""WITH {CGROUP}, p AS (
  SELECT cgroup, tick, CASE WHEN tick % 5 < 4 THEN usage_us / 1e6 * 0.75 END AS user_s, CASE WHEN tick % 5 < 4 THEN usage_us / 1e6 * 0.25 END AS system_s,
    CASE WHEN tick % 5 > 2 THEN usage_us / 1e6 END AS total_s, sec AS wall_s FROM snaps),
t AS (SELECT *, coalesce(total_s, user_s + system_s) AS total FROM p)
SELECT cgroup, tick, {q6('CASE WHEN dt IS NOT NULL THEN greatest(0.0, dt) / greatest(dw, 1e-9) * 100 END')} AS cpu_pct,
  {q6('coalesce(user_s, greatest(total, 0.0))')} AS user_total_s, {q6('coalesce(system_s, greatest(total - coalesce(user_s, greatest(total, 0.0)), 0.0))')} AS system_total_s,
  {q6('total')} AS cpu_total_s
FROM (SELECT *, total - lag(total) OVER w AS dt, wall_s - lag(wall_s) OVER w AS dw FROM t WINDOW w AS (PARTITION BY cgroup ORDER BY tick))""")
def ctr11(spark, d):
    c = cgroups(spark, d)
    s, k = F.col("usage_us") / 1e6, F.col("tick") % 5
    p = c.select("cgroup", "tick", F.when(k < 4, s * 0.75).alias("user_s"), F.when(k < 4, s * 0.25).alias("system_s"),
                 F.when(k > 2, s).alias("total_s"), F.col("sec").alias("wall_s"))
    return rounded(ct.process_cpu(p, ["cgroup"], "tick", "tick"))
