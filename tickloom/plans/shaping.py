"""Queries: projections, predicates and synthetic traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import shaping as sh
from tickloom.functions.mapping import MAPPINGS, interval_of_config
from tickloom.functions.numeric import clamp, pct_change, pct_saved, r6
from tickloom.operators.counters import per_tick_value
from tickloom.operators.masks import thin_evenly
from tickloom.operators.replay import replay
from tickloom.operators.scans import following, previous, scan
from tickloom.params import config_label, grid, is_valid, make_config, with_configs
from tickloom.plans.fidelity import kept_events, rounded
from tickloom.plans.inputs import SEC, events, sec_of
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import D, EVENTS, MASKED, USERS, sampler
from tickloom.sources import synth
from tickloom.sources.records import cpu_quantity
from tickloom.sources.tables import event_trace, table, user_trace

PI2 = f"(2 * pi())"


def _trace(expr: str, source: str = EVENTS) -> str:
    return f"WITH {source} SELECT series_id, tick, {q6(expr)} AS value FROM trace"


def _value(df, expr):
    return df.select("series_id", "tick", r6(expr).alias("value"))


@query("prj01_trend", _trace(f"value + tick * 0.05{D}"))
def prj01(spark, d):
    return _value(event_trace(spark, d), sh.trend(F.col("value"), F.col("tick"), 0.05))


@query("prj02_seasonality", _trace(f"value + 10.0{D} * sin({PI2} * tick / 100.0)"))
def prj02(spark, d):
    return _value(event_trace(spark, d), sh.season(F.col("value"), F.col("tick"), 100, 10.0))


def hu(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0{D})"


def hn(*parts: str) -> str:
    return f"(sqrt(-2.0{D} * ln({hu(chr(39) + 'a' + chr(39), *parts)})) * cos({PI2} * {hu(chr(39) + 'b' + chr(39), *parts)}))"


@query("prj03_noise", _trace(f"value + {hn(chr(39) + '7' + chr(39), 'series_id', 'tick')} * 2.0"))
def prj03(spark, d):
    return _value(event_trace(spark, d), sh.noise(F.col("value"), 2.0, F.lit(7), F.col("series_id"), F.col("tick")))


SPEC = """spec AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS series_id, CAST(s_suppkey AS BIGINT) AS seq, CAST(20 + s_suppkey % 30 AS BIGINT) AS n,
    CASE s_suppkey % 5 WHEN 0 THEN 'uniform' WHEN 1 THEN 'normal' WHEN 2 THEN 'lognormal' WHEN 3 THEN 'mixture' ELSE 'constant' END AS distribution,
    CASE s_suppkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 50.0 WHEN 2 THEN 3.0 ELSE 42.0 END::DOUBLE AS p1,
    CASE s_suppkey % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 10.0 ELSE 0.5 END::DOUBLE AS p2
  FROM supplier)"""


def segments(spark, d, plain: bool = True):
    s = table(spark, d, "supplier")
    kind = s["s_suppkey"] % 5
    pick = lambda *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (kind + 1).cast("int"))
    none = F.lit(None).cast("double")
    return s.select(
        F.col("s_nationkey").cast("string").alias("series_id"), F.col("s_suppkey").cast("long").alias("seq"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("label"),
        pick("uniform", "normal", "lognormal", "mixture", "constant").alias("distribution"),
        (F.lit(20) + F.col("s_suppkey") % 30).cast("long").alias("n"), F.lit(11).cast("long").alias("seed"),
        pick(0.0, 50.0, 3.0, 42.0, 42.0).alias("p1"), pick(100.0, 10.0, 0.5, 0.5, 0.5).alias("p2"), F.lit(100.0).alias("p3"),
        F.lit(0.05).alias("trend_slope"), F.lit(25.0).alias("season_period"), F.lit(4.0).alias("season_amplitude"),
        (none if plain else F.lit(1.5)).alias("noise_std"), (none if plain else F.lit(0.1)).alias("anomaly_fraction"),
        F.lit(30.0).alias("anomaly_magnitude"), F.lit(1.0).alias("clip_low"), F.lit(90.0).alias("clip_high"))


S = "'{}'"
IDENT = ("'11'", "series_id", "seq", "i")
RAW = f"""CASE distribution WHEN 'uniform' THEN p1 + (p2 - p1) * {hu("'u'", *IDENT)}
  WHEN 'normal' THEN p1 + p2 * {hn("'n'", *IDENT)} WHEN 'lognormal' THEN exp(p1 + p2 * {hn("'l'", *IDENT)})
  WHEN 'mixture' THEN CASE WHEN {hu("'m'", *IDENT)} < 0.6{D} THEN 20.0 + 5.0 * {hn("'mz'", *IDENT)} ELSE 75.0 + 8.0 * {hn("'mz'", *IDENT)} END
  ELSE p1 END"""
VALUES = f"""{SPEC}, points AS (SELECT *, unnest(range(n)) AS i FROM spec),
vals AS (SELECT *, least(greatest({RAW} + i * 0.05{D} + 4.0{D} * sin({PI2} * i / 25.0), 1.0), 90.0) AS value FROM points)"""


@query("src18_synthetic_distributions", f"""WITH {SPEC}, points AS (SELECT *, unnest(range(n)) AS i FROM spec)
SELECT series_id, seq, i, {q6(RAW)} AS value FROM points""")
def src18(spark, d):
    none = F.lit(None).cast("double")
    bare = segments(spark, d)
    for c in ("trend_slope", "season_period", "clip_low", "clip_high"):
        bare = bare.withColumn(c, none)
    kinds = ("uniform", "normal", "lognormal", "mixture", "constant")
    return rounded(synth.segment_values(bare, kinds))


@query("src18_synthetic_beta")
def src18_beta(spark, d):
    spec = segments(spark, d).withColumn("distribution", F.lit("beta")).withColumn("p1", F.lit(2.0)).withColumn("p2", F.lit(5.0))
    return synth.segment_values(spec, ("beta",))


COMPOSED = f"""{VALUES}, bounds AS (
  SELECT series_id, seq, n, CAST(coalesce(sum(n + 6) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_tick FROM spec),
edges AS (SELECT series_id, seq, max(CASE WHEN i = 0 THEN value END) AS first, max(CASE WHEN i = n - 1 THEN value END) AS last FROM vals GROUP BY 1, 2),
sides AS (SELECT *, lag(last) OVER (PARTITION BY series_id ORDER BY seq) AS left_value FROM edges),
bridged AS (SELECT series_id, seq, i, left_value + (first - left_value) * ((1 - cos(i / 5.0 * pi())) / 2) AS value
  FROM sides, (SELECT unnest(range(6)) AS i) WHERE left_value IS NOT NULL)"""


@query("src19_composed_trace", f"""WITH {COMPOSED}
SELECT series_id, CAST(start_tick + i AS BIGINT) AS tick, {q6('value')} AS value FROM vals JOIN bounds USING (series_id, seq)
UNION ALL SELECT series_id, CAST(start_tick - 6 + i AS BIGINT), {q6('value')} FROM bridged JOIN bounds USING (series_id, seq)""")
def src19(spark, d):
    return rounded(synth.compose(segments(spark, d), 6, "cosine", ("uniform", "normal", "lognormal", "mixture", "constant")))


@query("src19_segment_boundaries", f"""WITH {COMPOSED} SELECT series_id, 's' || seq AS label, start_tick, CAST(start_tick + n AS BIGINT) AS end_tick FROM bounds""")
def src19_bounds(spark, d):
    return synth.segment_bounds(segments(spark, d), 6).select("series_id", "label", "start_tick", "end_tick")


@query("src21_bridges", f"WITH {COMPOSED} SELECT series_id, seq, i, {q6('value')} AS value FROM bridged")
def src21(spark, d):
    spec = segments(spark, d)
    kinds = ("uniform", "normal", "lognormal", "mixture", "constant")
    return rounded(synth.bridges(spec, synth.segment_values(spec, kinds), 6, "cosine"))


@query("win11_segment_edges", f"""WITH {COMPOSED} SELECT series_id, seq, {q6('first')} AS first, {q6('last')} AS last FROM edges""")
def win11(spark, d):
    spec = segments(spark, d)
    v = synth.segment_values(spec, ("uniform", "normal", "lognormal", "mixture", "constant"))
    return rounded(v.groupBy("series_id", "seq").agg(F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last")))


@query("prj04_anomaly_injection", f"""WITH {SPEC}, points AS (SELECT *, unnest(range(n)) AS i FROM spec),
noisy AS (SELECT *, {RAW} + i * 0.05{D} + 4.0{D} * sin({PI2} * i / 25.0) + 1.5{D} * {hn("'z'", *IDENT)} AS v0 FROM points),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, seq ORDER BY {hu("'pick'", *IDENT)}, i) AS rk FROM noisy)
SELECT series_id, seq, i, {q6(f'''least(greatest(v0 + CASE WHEN rk <= greatest(1, floor(n * 0.1{D})) THEN ({hu("'jump'", *IDENT)} * 2.0 - 1.0) * 30.0 ELSE 0.0 END, 1.0), 90.0)''')} AS value FROM ranked""")
def prj04(spark, d):
    return rounded(synth.segment_values(segments(spark, d, plain=False), ("uniform", "normal", "lognormal", "mixture", "constant")))


@query("prj05_clip", f"""WITH {EVENTS} SELECT series_id, tick, least(greatest(value, 5.0), 80.0)::DOUBLE AS both_sides,
  greatest(value, 5.0)::DOUBLE AS low_only, least(value, 80.0)::DOUBLE AS high_only FROM trace""")
def prj05(spark, d):
    v = F.col("value")
    return event_trace(spark, d).select("series_id", "tick", clamp(v, 5.0, 80.0).alias("both_sides"),
                                        clamp(v, 5.0, None).alias("low_only"), clamp(v, None, 80.0).alias("high_only"))


@query("prj06_tracker_offset", f"""WITH RECURSIVE {USERS}, shifted AS (SELECT series_id, tick, value + 100.0{D} AS value FROM trace),
{sampler('poll', 'shifted', threshold=3.0)}
SELECT series_id, tick, sampled, {q6('mean - 100.0')} AS mean, {q6('value - 100.0')} AS value FROM poll""")
def prj06(spark, d):
    shifted = user_trace(spark, d).withColumn("value", F.col("value") + 100.0)
    out = replay(shifted, [make_config(outlier_threshold=3.0)])
    return out.select("series_id", "tick", "sampled", r6(F.col("mean") - 100.0).alias("mean"), r6(F.col("value") - 100.0).alias("value"))


@query("prj07_request_signal", f"""SELECT event_id, {q6('value - 50')} AS raw, {q6('greatest(value - 50, 0.0)')} AS positive,
  round_even(value * 1e6, 0)::DOUBLE AS duration FROM events""")
def prj07(spark, d):
    delta, took = F.col("value") - 50.0, F.rint(F.col("value") * 1e6).cast("long")
    return events(spark, d).select("event_id", *[r6(sh.signal(delta, took, m)).alias(m) if m != "duration"
                                                 else sh.signal(delta, took, m).alias(m) for m in ("raw", "positive", "duration")])


@query("prj08_per_tick_counter", f"""WITH {EVENTS}, {MASKED}, reads AS (SELECT *, coalesce(tick - lag(tick) OVER (PARTITION BY series_id ORDER BY tick), 1) AS w FROM kept WHERE sampled)
SELECT series_id, tick, CAST(w AS BIGINT) AS sample_window_ticks, {q6('value / greatest(1, w)')} AS per_tick FROM reads""")
def prj08(spark, d):
    return rounded(per_tick_value(kept_events(spark, d)).select("series_id", "tick", "sample_window_ticks", "per_tick"))


@query("prj09_cpu_quantity", f"""SELECT event_id, {q6("CASE event_type WHEN 'click' THEN user_id / 1000.0 WHEN 'view' THEN value END")} AS cores FROM events""")
def prj09(spark, d):
    text = (F.when(F.col("event_type") == "click", F.concat(F.col("user_id").cast("string"), F.lit("m")))
            .when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.col("event_type")))
    return events(spark, d).select("event_id", r6(cpu_quantity(text)).alias("cores"))


@query("prj10_group_uid", """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ab' || (user_id % 10) || '-' || 'cd-' || (event_id % 100) ELSE '' END AS uid FROM events""")
def prj10(spark, d):
    name = F.concat(F.lit("group-pod"), F.lit("ab"), (F.col("user_id") % 10).cast("string"), F.lit("_cd_"),
                    (F.col("event_id") % 100).cast("string"), F.lit(".slice"))
    text = F.when(F.col("event_type") == "error", F.lit("system.slice")).otherwise(name)
    return events(spark, d).select("event_id", sh.group_uid(text).alias("uid"))


@query("prj11_time_alignment", f"""WITH starts AS (SELECT user_id, min({SEC}) AS origin_s, max({SEC}) AS last_s FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, {q6(f'{SEC} - origin_s')} AS elapsed_s FROM events JOIN starts USING (user_id) WHERE {SEC} >= origin_s AND {SEC} <= last_s""")
def prj11(spark, d):
    e = events(spark, d).withColumn("s", sec_of("ts"))
    starts = e.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("s").alias("origin_s"), F.max("s").alias("last_s"))
    return e.join(starts, "user_id").where(F.col("s").between(F.col("origin_s"), F.col("last_s"))).select(
        "event_id", r6(F.col("s") - F.col("origin_s")).alias("elapsed_s"))


@query("prj12_even_thinning", f"""WITH {EVENTS}, sizes AS (SELECT series_id, count(*) AS n FROM trace GROUP BY 1),
keep AS (SELECT DISTINCT series_id, CAST(floor(i * (n - 1) / 99.0{D}) AS BIGINT) AS tick FROM (SELECT *, unnest(range(100)) AS i FROM sizes))
SELECT series_id, tick, value FROM trace JOIN keep USING (series_id, tick)""")
def prj12(spark, d):
    t = event_trace(spark, d)
    sizes = t.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return thin_evenly(t.join(sizes, "series_id"), F.col("n"), 100, F.col("tick")).select("series_id", "tick", "value")


@query("prj13_relative_change", f"""WITH a AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS ref, avg(CASE WHEN event_type = 'view' THEN value END) AS v FROM events GROUP BY 1)
SELECT user_id, {q6('CASE WHEN ref <> 0 THEN (v - ref) / ref * 100 END')} AS change_pct, {q6('CASE WHEN ref <> 0 THEN (1 - v / ref) * 100 END')} AS saved_pct FROM a""")
def prj13(spark, d):
    m = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    a = events(spark, d).groupBy("user_id").agg(m("click").alias("ref"), m("view").alias("v"))
    return a.select("user_id", r6(pct_change(F.col("ref"), F.col("v"))).alias("change_pct"), r6(pct_saved(F.col("ref"), F.col("v"))).alias("saved_pct"))


LABEL_SQL = """cfg AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'original_interval' WHEN 1 THEN 'power_rate' WHEN 2 THEN 'logistic_rate' ELSE 'exponential_ease_out_rate' END AS m,
  (user_id % 8) / 4.0 AS p, 1 + user_id % 5 AS lo FROM events)"""


def fmt(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


@query("prj14_config_label", f"""WITH {LABEL_SQL}
SELECT event_id, 'min_interval=' || lo || CASE m WHEN 'power_rate' THEN ', power=' || {fmt('p')} WHEN 'logistic_rate' THEN ', logistic_midpoint=' || {fmt('p')} ELSE '' END AS label FROM cfg""")
def prj14(spark, d):
    kind = F.element_at(F.array(*[F.lit(m) for m in ("original_interval", "power_rate", "logistic_rate", "exponential_ease_out_rate")]),
                        (F.col("user_id") % 4 + 1).cast("int"))
    share = (F.col("user_id") % 8) / 4.0
    c = events(spark, d).select("event_id", kind.alias("interval_mapping"), share.alias("power"), share.alias("logistic_midpoint"),
                                (F.col("user_id") % 5 + 1).cast("int").alias("min_interval"))
    return c.select("event_id", config_label(["min_interval", "power", "logistic_midpoint"]).alias("label"))


@query("prj15_valid_configurations", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT a, t, tol, hi FROM (SELECT unnest([0.0, 0.05, 1.0]) AS a), (SELECT unnest([0.0, 3.0]) AS t), (SELECT unnest([0, 3]) AS tol), (SELECT unnest([0, 20, 70]) AS hi))
SELECT user_id, count(*) AS n_valid FROM n, g WHERE a > 0 AND a < 1 AND t > 0 AND tol >= 0 AND hi > 0 AND hi <= n AND hi >= 1 GROUP BY 1""")
def prj15(spark, d):
    configs = grid({"alpha_base": [0.0, 0.05, 1.0], "outlier_threshold": [0.0, 3.0], "drift_tolerance": [0, 3],
                                    "max_interval": [0, 20, 70]})
    sizes = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return with_configs(sizes, configs).where(is_valid(F.col("n"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_valid"))


@query("prj16_urgency_gradient", f"""WITH RECURSIVE {USERS}, {sampler('poll', 'trace', threshold=3.0)}
SELECT series_id, tick, {q6('CASE WHEN a IS NULL THEN b - urgency WHEN b IS NULL THEN urgency - a ELSE (b - a) / 2 END')} AS gradient
FROM (SELECT *, lag(urgency) OVER w AS a, lead(urgency) OVER w AS b FROM poll WINDOW w AS (PARTITION BY series_id ORDER BY tick))""")
def prj16(spark, d):
    poll = replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)]).select("series_id", "tick", "urgency")
    u = F.col("urgency")
    w = scan(poll, ["series_id"], ["tick"], {"a": previous(u), "b": following(u)}, "tick")
    g = F.when(F.col("a").isNull(), F.col("b") - u).when(F.col("b").isNull(), u - F.col("a")).otherwise((F.col("b") - F.col("a")) / 2)
    return w.select("series_id", "tick", r6(g).alias("gradient"))


@query("prj17_effective_rate", f"""WITH RECURSIVE {USERS}, {sampler('poll', 'trace', threshold=3.0)}
SELECT series_id, tick, {q6('1.0 / interval')} AS rate, {q6('interval * 0.2')} AS seconds FROM poll""")
def prj17(spark, d):
    poll = replay(user_trace(spark, d), [make_config(outlier_threshold=3.0)])
    return poll.select("series_id", "tick", r6(F.lit(1.0) / F.col("interval")).alias("rate"), r6(F.col("interval") * 0.2).alias("seconds"))


@query("prj18_envelope_bounds", f"""SELECT user_id, event_id, {q6('1.0 / (20 + user_id % 5)')} AS min_rate, {q6('1.0 / (1 + event_id % 20)')} AS max_rate FROM events""")
def prj18(spark, d):
    lo, hi = F.col("event_id") % 20 + 1, F.col("user_id") % 5 + 20
    return events(spark, d).select("user_id", "event_id", r6(F.lit(1.0) / hi).alias("min_rate"), r6(F.lit(1.0) / lo).alias("max_rate"))


def sig(x: str) -> str:
    return f"(1{D} / (1{D} + exp(-({x}))))"


def mapping_sql(name: str, p: str = "2.0", mid: str = "0.5", steep: str = "8.0", ease: str = "4.0") -> str:
    low, high = sig(f"-{steep} * {mid}"), sig(f"{steep} * (1 - {mid})")
    shaped = {"original_interval": "u", "linear_rate": "u", "smoothstep_interval": f"u * u * (3.0{D} - 2.0{D} * u)", "power_rate": f"pow(u, {p})",
              "logistic_rate": f"least(1.0, greatest(0.0, ({sig(f'{steep} * (u - {mid})')} - {low}) / ({high} - {low})))",
              "exponential_ease_out_rate": f"(exp(-{ease} * u) - 1) / (exp(-{ease}) - 1)"}
    raw = f"1{D} * pow(20{D}, 1{D} - u)" if name == "geometric_rate" else f"20{D} - 19{D} * ({shaped[name]})"
    return f"CAST(least(greatest(round_even({raw}, 0), 1), 20) AS INTEGER)"


NAMES = (*MAPPINGS, "linear_rate")


@query("prj19_interval_mappings", "WITH u AS (SELECT event_id, least(value / 200.0, 1.0) AS u FROM events) "
       + " UNION ALL ".join(f"SELECT event_id, '{n}' AS mapping, {mapping_sql(n)} AS interval FROM u" for n in NAMES))
def prj19(spark, d):
    u = events(spark, d).select("event_id", F.least(F.col("value") / 200.0, F.lit(1.0)).alias("u"))
    return with_configs(u, [make_config(interval_mapping=n) for n in NAMES]).select("event_id", F.col("interval_mapping").alias("mapping"),
                                                interval_of_config(F.col("u")).alias("interval"))


@query("prj20_index_check", """WITH s AS (SELECT user_id::VARCHAR AS series_id, event_id AS pos, CAST(floor(value) AS BIGINT) AS tick, 100 AS n FROM events)
SELECT series_id, pos, tick, CASE WHEN tick < 0 OR tick >= n THEN 'outside' ELSE 'not increasing' END AS problem
FROM (SELECT *, lag(tick) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM s) WHERE tick < 0 OR tick >= n OR tick <= p""")
def prj20(spark, d):
    s = events(spark, d).select(F.col("user_id").cast("string").alias("series_id"), F.col("event_id").alias("pos"),
                                F.floor("value").cast("long").alias("tick"))
    w = scan(s, ["series_id"], ["pos"], {"p": previous(F.col("tick"))})
    outside = (F.col("tick") < 0) | (F.col("tick") >= 100)
    return w.where(outside | (F.col("tick") <= F.col("p"))).select(
        "series_id", "pos", "tick", F.when(outside, "outside").otherwise("not increasing").alias("problem"))
