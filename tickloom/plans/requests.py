"""Queries: request policies, telemetry, cycles and run validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import r6
from tickloom.operators import requests as rq
from tickloom.operators.validate import run_checks, type_rule_checks
from tickloom.params import make_config
from tickloom.plans.fidelity import rounded
from tickloom.plans.inputs import REQUESTS, requests
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import D, sampler

U = "(CAST('0x' || substr(md5('1:' || event_index), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE)"
UNI = f"{REQUESTS}, uni AS (SELECT *, 0.5{D} AS rate, {U} < 0.5 AS selected FROM requests)"
MARKS = """marks AS (SELECT DISTINCT run, second AS marker FROM requests WHERE second % 48 = 0 AND second > 0
  UNION SELECT run, max(second) FROM requests GROUP BY 1)"""
LONG = "CAST({} AS BIGINT)"


def uniform(spark, d):
    return rq.uniform_selection(requests(spark, d))


def full(spark, d):
    return requests(spark, d).withColumn("rate", F.lit(1.0)).withColumn("selected", F.lit(True))


def markers(spark, d):
    r = requests(spark, d)
    regular = r.where((F.col("second") % 48 == 0) & (F.col("second") > 0)).select("run", F.col("second").alias("marker"))
    return regular.union(r.groupBy("run").agg(F.max("second").alias("marker"))).distinct()


INV = f"""{REQUESTS}, ops AS (SELECT run, second, count(*) AS ops FROM requests GROUP BY 1, 2),
ext AS (SELECT *, min(ops) OVER w AS lo, max(ops) OVER w AS hi FROM ops WINDOW w AS (PARTITION BY run ORDER BY second)),
frm AS (SELECT *, CASE WHEN hi > lo THEN 0.5{D} * ((hi - ops) / (hi - lo)::DOUBLE) END AS f FROM ext),
inv AS (SELECT run, second, ops,
  coalesce(last_value(least(greatest(f, 0.01), 0.5) IGNORE NULLS) OVER (PARTITION BY run ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)::DOUBLE AS rate,
  coalesce(last_value(least(greatest(f, 0.01), 0.5) IGNORE NULLS) OVER (PARTITION BY run ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.5)::DOUBLE AS next_rate,
  CASE WHEN f IS NULL THEN 'KEEP_PREVIOUS' WHEN f > 0.5 THEN 'CLAMP_MAX' WHEN f < 0.01 THEN 'CLAMP_MIN' ELSE 'FORMULA' END AS status FROM frm)"""


@query("sta14_inverse_throughput_rates", f"WITH {INV} SELECT run, second, ops, {q6('rate')} AS rate, {q6('next_rate')} AS next_rate, status FROM inv")
def sta14(spark, d):
    return rounded(rq.inverse_rates(rq.operations(requests(spark, d))))


@query("sta14_inverse_throughput_selection", f"WITH {INV} SELECT run, event_index, {U} < rate AS selected FROM requests JOIN inv USING (run, second)")
def sta14_selection(spark, d):
    r = requests(spark, d)
    return rq.rated_selection(r, rq.inverse_rates(rq.operations(r))).select("run", "event_index", "selected")


@query("sta15_guarded_adaptive_rates")
def sta15(spark, d):
    return rounded(rq.guarded_rates(requests(spark, d)))


def guarded(spark, d):
    r = requests(spark, d)
    return rq.guarded_selection(r, rq.guarded_rates(r))


@query("agg28_cycle_readiness")
def agg28(spark, d):
    return rounded(rq.monitoring_cycles(uniform(spark, d)))


@query("str06_data_dependent_cycles")
def str06(spark, d):
    chosen = guarded(spark, d)
    where = rq.monitoring_cycles(chosen.where(~F.col("baseline"))).select("run", "second", "cycle_index")
    return chosen.join(where, ["run", "second"]).groupBy("run", "cycle_index").agg(
        F.max("second").alias("marker"), F.count(F.lit(1)).alias("population_size"),
        F.count(F.when(F.col("selected"), 1)).alias("sample_size"))


TYPED = f"""WITH RECURSIVE {REQUESTS}, typed AS (
  SELECT run || '/' || request_type AS series_id, run, request_type, event_index,
    row_number() OVER (PARTITION BY run, request_type ORDER BY event_index) - 1 AS tick, delta::DOUBLE AS value FROM requests),
{sampler('poll', 'typed', threshold=3.0)}"""


def controllers(spark, d):
    return rq.per_type_controllers(requests(spark, d), make_config(outlier_threshold=3.0))


@query("sta16_controller_per_type", f"""{TYPED}
SELECT run, request_type, tick, sampled, interval, {q6('urgency')} AS urgency, status FROM poll JOIN (SELECT DISTINCT series_id, run, request_type FROM typed) USING (series_id)""")
def sta16(spark, d):
    return controllers(spark, d).select("run", "request_type", "tick", "sampled", "interval", r6("urgency").alias("urgency"), "status")


@query("sta17_controller_diagnostics", f"""{TYPED}
SELECT run, request_type, count(*) AS decisions, count(CASE WHEN sampled THEN 1 END) AS n_sampled, count(CASE WHEN NOT sampled THEN 1 END) AS n_skipped,
  count(CASE WHEN status = 'INIT' THEN 1 END) AS init_count, count(CASE WHEN status = 'NORMAL' THEN 1 END) AS normal_count,
  count(CASE WHEN status = 'OUTLIER' THEN 1 END) AS outlier_count, count(CASE WHEN status = 'DRIFT_RESET' THEN 1 END) AS drift_reset_count,
  count(CASE WHEN value > 0 THEN 1 END) AS positive, count(CASE WHEN value = 0 THEN 1 END) AS zero, count(CASE WHEN value < 0 THEN 1 END) AS negative,
  min(interval) AS min_interval, {q6('avg(interval)')} AS mean_interval, max(interval) AS max_interval, {q6('avg(urgency)')} AS mean_urgency,
  {q6('max_by(urgency, tick)')} AS final_urgency, max_by(interval, tick) AS final_interval, {q6('max_by(std, CASE WHEN sampled THEN tick END)')} AS tracker_std,
  {q6('avg(CASE WHEN sampled THEN value END)')} AS sampled_mean, {q6('coalesce(stddev_samp(CASE WHEN sampled THEN value END), 0)')} AS sampled_std
FROM poll JOIN (SELECT DISTINCT series_id, run, request_type FROM typed) USING (series_id) GROUP BY 1, 2""")
def sta17(spark, d):
    return rounded(rq.controller_diagnostics(controllers(spark, d), ["run", "request_type"]))


TELE = """tele AS (SELECT run, second, count(*) AS requests, count(CASE WHEN selected THEN 1 END) AS selected, avg(rate) AS mean_rate, min(rate) AS min_rate,
  max(rate) AS max_rate, max_by(rate, event_index) AS last_rate FROM {src} GROUP BY 1, 2)"""
INV_SEL = f"{INV}, chosen AS (SELECT r.*, rate, {U} < rate AS selected FROM requests r JOIN inv USING (run, second))"


@query("agg22_telemetry_per_second", f"""WITH {INV_SEL}, {TELE.format(src='chosen')}
SELECT run, second, requests, selected, {q6('selected / requests::DOUBLE')} AS ratio, {q6('mean_rate')} AS mean_rate, {q6('min_rate')} AS min_rate, {q6('max_rate')} AS max_rate,
  {q6('last_rate')} AS last_rate, CAST(sum(requests) OVER w AS BIGINT) AS population_size, CAST(sum(selected) OVER w AS BIGINT) AS sample_size
FROM tele WINDOW w AS (PARTITION BY run ORDER BY second)""")
def agg22(spark, d):
    r = requests(spark, d)
    return rounded(rq.telemetry(rq.rated_selection(r, rq.inverse_rates(rq.operations(r)))))


REBUILT = f"""{UNI}, {MARKS}, placed AS (SELECT u.*, (SELECT min(m.marker) FROM marks m WHERE m.run = u.run AND m.marker >= u.second) AS marker FROM {{src}} u),
mem AS (SELECT run, marker, avg(s) AS sm, avg(dn) AS dm, count(s) AS st, count(dn) AS dt FROM (
  SELECT run, marker, request_type, avg(CASE WHEN selected THEN delta END) AS s, avg(delta) AS dn FROM placed WHERE delta > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
cyc AS (SELECT run, marker, count(*) AS population_size, count(CASE WHEN selected THEN 1 END) AS sample_size, avg(execution / 1e6) AS pm,
  coalesce(stddev_samp(execution / 1e6), 0) AS ps, avg(CASE WHEN selected THEN execution / 1e6 END) AS sm2,
  CASE WHEN count(CASE WHEN selected THEN 1 END) > 0 THEN coalesce(stddev_samp(CASE WHEN selected THEN execution / 1e6 END), 0) END AS ss FROM placed GROUP BY 1, 2),
rebuilt AS (SELECT c.*, sm AS selected_memory_mean, dm AS dense_memory_mean, st AS selected_memory_types, dt AS dense_memory_types,
  c.marker = (SELECT max(marker) FROM marks m WHERE m.run = c.run) AS final_cycle FROM cyc c LEFT JOIN mem USING (run, marker))"""


def rebuilt_uni(spark, d):
    return rq.rebuild_cycles(uniform(spark, d), markers(spark, d))


@query("agg23_rebuilt_cycles", f"""WITH {REBUILT.format(src='uni')}
SELECT run, marker, population_size, sample_size, {q6('pm')} AS population_mean_ms, {q6('ps')} AS population_std_ms, {q6('sm2')} AS sample_mean_ms, {q6('ss')} AS sample_std_ms,
  {q6('selected_memory_mean')} AS selected_memory_mean, {q6('dense_memory_mean')} AS dense_memory_mean, selected_memory_types, dense_memory_types, final_cycle FROM rebuilt""")
def agg23(spark, d):
    return rounded(rebuilt_uni(spark, d))


@query("joi06_next_marker", f"""WITH {REQUESTS}, {MARKS} SELECT DISTINCT r.run, r.second, (SELECT min(m.marker) FROM marks m WHERE m.run = r.run AND m.marker >= r.second) AS marker FROM requests r""")
def joi06(spark, d):
    from tickloom.operators.reconstruct import asof_forward
    seconds = requests(spark, d).select("run", "second").distinct()
    marks = markers(spark, d).select("run", F.col("marker").alias("second"), "marker")
    return asof_forward(seconds, marks, ["run"], "second", ["marker"])


@query("agg24_mean_of_type_means", f"""WITH {UNI} SELECT run, {q6('avg(s)')} AS selected_memory_mean, {q6('avg(dn)')} AS dense_memory_mean, count(s) AS selected_memory_types, count(dn) AS dense_memory_types
FROM (SELECT run, request_type, avg(CASE WHEN selected THEN delta END) AS s, avg(delta) AS dn FROM uni WHERE delta > 0 GROUP BY 1, 2) GROUP BY 1""")
def agg24(spark, d):
    return rounded(rq.memory_means(uniform(spark, d), ["run"]))


SUMMARY = f"""SELECT run, coalesce(request_type, '__overall__') AS request_type, count(*) AS total_requests, count(CASE WHEN selected THEN 1 END) AS selected_requests,
  count(CASE WHEN delta > 0 THEN 1 END) AS positive_total_count, {q6('coalesce(sum(CASE WHEN delta > 0 THEN delta END), 0)')} AS positive_total_sum,
  {q6('avg(CASE WHEN delta > 0 THEN delta END)')} AS positive_total_mean, count(CASE WHEN delta > 0 AND selected THEN 1 END) AS positive_selected_count,
  {q6('coalesce(sum(CASE WHEN delta > 0 AND selected THEN delta END), 0)')} AS positive_selected_sum, {q6('avg(CASE WHEN delta > 0 AND selected THEN delta END)')} AS positive_selected_mean
FROM uni GROUP BY GROUPING SETS ((run, request_type), (run))"""


@query("agg25_type_totals", f"WITH {UNI} {SUMMARY}")
def agg25(spark, d):
    return rounded(rq.type_summary(uniform(spark, d)))


@query("agg26_merged_moments", f"""WITH {REQUESTS} SELECT run, count(*) AS n, {q6('avg(execution / 1e6)')} AS mean, {q6('stddev_samp(execution / 1e6)')} AS std FROM requests GROUP BY 1""")
def agg26(spark, d):
    parts = rq.partial_moments(requests(spark, d), ["run", "second", "request_type"], F.col("execution") / 1e6)
    return rounded(rq.merge_moments(parts, ["run"]))


@query("agg27_type_proportions", f"""WITH {UNI}, k AS (SELECT run, request_type, count(*) AS n, count(CASE WHEN selected THEN 1 END) AS k FROM uni GROUP BY 1, 2),
p AS (SELECT run, request_type, n / (sum(n) OVER (PARTITION BY run))::DOUBLE AS pop, k / (sum(k) OVER (PARTITION BY run))::DOUBLE AS sam FROM k)
SELECT run, request_type, {q6('pop')} AS population_share, {q6('sam')} AS sample_share, sam > pop OR (sam <= pop + (pop - pop * 0.9{D}) AND sam >= pop - (pop - pop * 0.9{D})) AS close_enough FROM p""")
def agg27(spark, d):
    return rounded(rq.type_proportions(uniform(spark, d), ["run"], 0.9))


@query("agg28_readiness_terms", f"""WITH {UNI}, t AS (SELECT run, second, count(*) AS n, sum(count(*)) OVER (PARTITION BY run ORDER BY second) AS pop,
  CASE WHEN second = 0 THEN 0.999999999999{D} ELSE floor(pow(0.1{D}, second * 1000 / 180000.0{D}) * 10000.0) / 10000.0 END AS decay FROM uni GROUP BY 1, 2),
u AS (SELECT *, floor((1.96{D} - 1.96{D} * decay) * (1.96{D} - 1.96{D} * decay) * 0.25{D} / 0.0025{D}) AS inf FROM t)
SELECT run, second, {q6('decay')} AS decay, CAST(CASE WHEN pop <= 1 THEN 0 ELSE floor(inf / (1 + trunc((inf - 1) / pop))) END AS BIGINT) AS minimum FROM u""")
def agg28_terms(spark, d):
    tele = rq.telemetry(uniform(spark, d))
    decay = rq.decay_factor((F.col("second") * 1000).cast("double"), 180000.0)
    return tele.withColumn("decay", decay).select(
        "run", "second", r6("decay").alias("decay"), rq.minimum_sample(F.col("population_size"), F.col("decay")).alias("minimum"))


TT = f"""WITH {REQUESTS}, mu AS (SELECT run, avg(delta) AS mu FROM requests GROUP BY 1),
s AS (SELECT run, request_type, count(*) AS n, avg(delta) AS mean, var_samp(delta) AS v, any_value(mu) AS mu FROM requests JOIN mu USING (run) GROUP BY 1, 2)"""


def t_test(spark, d):
    r = requests(spark, d)
    mu = r.groupBy("run").agg(F.avg("delta").alias("mu"))
    return rq.one_sample_t(r.join(mu, "run"), ["run", "request_type"], F.col("delta"), F.col("mu"))


@query("agg29_one_sample_t_statistic", f"{TT} SELECT run, request_type, n, {q6('mean')} AS mean, {q6('(mean - mu) / sqrt(v / n)')} AS t FROM s")
def agg29(spark, d):
    return rounded(t_test(spark, d).select("run", "request_type", "n", "mean", "t"))


# The finite sums for whole degrees of freedom: powers of the cosine of the angle of t.
P_VALUE = """st AS (SELECT *, CASE WHEN v > 0 THEN (mean - mu) / sqrt(v / n) END AS t, n - 1 AS df FROM s),
an AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM st),
sm AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(a) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + 2 * k * ln(cos(a)))))
  ELSE (2 * a + CASE WHEN df > 1 THEN 2 * sin(a) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos(a))))) ELSE 0 END) / pi() END AS inside FROM an),
pv AS (SELECT run, request_type, n, mean, mu, t, CASE WHEN df >= 1 THEN 1 - inside END AS p FROM sm)"""


@query("agg29_t_test_p_values", f"""{TT}, {P_VALUE}
SELECT run, request_type, n, {q6('mean')} AS mean, {q6('mu')} AS mu, {q6('t')} AS t, {q6('p')} AS p, {q6('p')} < 0.05 AS reject FROM pv""")
def agg29_p(spark, d):
    return rounded(t_test(spark, d)).withColumn("reject", F.col("p") < 0.05)


FULL_CYC = "fmem AS (SELECT run, marker, avg(s) AS fm FROM (SELECT run, marker, request_type, avg(delta) AS s FROM placed WHERE delta > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("agg30_cycle_rmse", f"""WITH {REBUILT.format(src='uni')}, {FULL_CYC},
e AS (SELECT r.run, coalesce(selected_memory_mean, 0) - coalesce(fm, 0) AS c, CASE WHEN dense_memory_mean IS NOT NULL THEN coalesce(selected_memory_mean, 0) - dense_memory_mean END AS p, selected_memory_mean
  FROM rebuilt r LEFT JOIN fmem USING (run, marker) WHERE NOT final_cycle),
g AS (SELECT run, sqrt(avg(c * c)) / 1024.0 AS cross_rmse_kb, sqrt(avg(p * p)) / 1024.0 AS paired_rmse_kb, count(CASE WHEN selected_memory_mean IS NULL THEN 1 END) AS z FROM e GROUP BY 1)
SELECT run, {q6('cross_rmse_kb')} AS cross_rmse_kb, {q6('paired_rmse_kb')} AS paired_rmse_kb, z AS zero_positive_cycles, {q6('CASE WHEN paired_rmse_kb > 0 THEN cross_rmse_kb / paired_rmse_kb END')} AS cross_to_paired FROM g""")
def agg30(spark, d):
    m = markers(spark, d)
    return rounded(rq.cycle_rmse(rq.rebuild_cycles(uniform(spark, d), m), rq.rebuild_cycles(full(spark, d), m)))


@query("joi17_cycles_on_marker", f"""WITH {REBUILT.format(src='uni')}, {FULL_CYC}
SELECT run, marker, {q6('selected_memory_mean - fm')} AS cross_error, {q6('selected_memory_mean - dense_memory_mean')} AS paired_error FROM rebuilt JOIN fmem USING (run, marker)""")
def joi17(spark, d):
    m = markers(spark, d)
    ref = rq.rebuild_cycles(full(spark, d), m).where(F.col("selected_memory_mean").isNotNull()).select("run", "marker", F.col("selected_memory_mean").alias("fm"))
    return rq.rebuild_cycles(uniform(spark, d), m).join(ref, ["run", "marker"]).select(
        "run", "marker", r6(F.col("selected_memory_mean") - F.col("fm")).alias("cross_error"),
        r6(F.col("selected_memory_mean") - F.col("dense_memory_mean")).alias("paired_error"))


MEANS = """m AS (SELECT run, request_type, avg(CASE WHEN delta > 0 THEN delta END) AS v FROM requests GROUP BY 1, 2),
pairs AS (SELECT a.run AS left_run, b.run AS right_run FROM (SELECT DISTINCT run FROM m) a, (SELECT DISTINCT run FROM m) b WHERE a.run < b.run),
prs AS (SELECT left_run, right_run, sqrt(avg(d * d)) / 1024.0 AS rmse_kb, bool_and(hit) AS same_types FROM (
  SELECT p.left_run, p.right_run, coalesce(x.v, 0) - coalesce(y.v, 0) AS d, x.run IS NOT NULL AND y.run IS NOT NULL AS hit
  FROM pairs p CROSS JOIN (SELECT DISTINCT request_type FROM m) k
  LEFT JOIN m x ON x.run = p.left_run AND x.request_type = k.request_type LEFT JOIN m y ON y.run = p.right_run AND y.request_type = k.request_type
  WHERE x.run IS NOT NULL OR y.run IS NOT NULL) GROUP BY 1, 2)"""


def positive_means(spark, d):
    return requests(spark, d).groupBy("run", "request_type").agg(F.avg(F.when(F.col("delta") > 0, F.col("delta"))).alias("v"))


def pair_table(spark, d):
    return rq.pairwise_rmse(positive_means(spark, d), "run", "request_type", "v")


@query("agg31_reference_stability", f"""WITH {REQUESTS}, {MEANS}
SELECT count(*) AS pairs, bool_and(same_types) AS type_sets_exact, {q6('avg(rmse_kb)')} AS mean_rmse_kb, {q6('coalesce(stddev_samp(rmse_kb), 0)')} AS stdev_rmse_kb,
  {q6('max(rmse_kb)')} AS max_rmse_kb, {q6('quantile_cont(rmse_kb, 0.5)')} AS median_rmse_kb FROM prs""")
def agg31(spark, d):
    return rounded(rq.reference_stability(pair_table(spark, d)))


@query("joi18_run_pairs", f"WITH {REQUESTS}, {MEANS} SELECT left_run, right_run, {q6('rmse_kb')} AS rmse_kb FROM prs")
def joi18(spark, d):
    return rounded(pair_table(spark, d).drop("same_types"))


@query("set05_equal_type_sets", f"WITH {REQUESTS}, {MEANS} SELECT left_run, right_run, same_types FROM prs")
def set05(spark, d):
    return pair_table(spark, d).drop("rmse_kb")


@query("joi14_map_rmse", f"""WITH {UNI}, l AS (SELECT run, request_type, avg(delta) AS v FROM uni WHERE delta > 60 GROUP BY 1, 2), r AS (SELECT run, request_type, avg(delta) AS v FROM uni WHERE selected AND delta > 80 GROUP BY 1, 2)
SELECT run, {q6('sqrt(avg((coalesce(l.v, 0) - coalesce(r.v, 0)) ** 2)) / 1024.0')} AS rmse_kb FROM l FULL JOIN r USING (run, request_type) GROUP BY 1""")
def joi14(spark, d):
    u = uniform(spark, d)
    mean = F.avg("delta").alias("v")
    left = u.where(F.col("delta") > 60).groupBy("run", "request_type").agg(mean)
    right = u.where(F.col("selected") & (F.col("delta") > 80)).groupBy("run", "request_type").agg(mean)
    return rounded(rq.map_rmse(left, right, ["run"], "request_type", "v"))


@query("agg32_group_mean_and_deviation", f"""WITH {UNI}, s AS (SELECT run, request_type, count(CASE WHEN selected THEN 1 END) / count(*)::DOUBLE AS ratio FROM uni GROUP BY 1, 2)
SELECT request_type, {q6('avg(ratio)')} AS mean, {q6('CASE WHEN count(*) > 1 THEN stddev_samp(ratio) ELSE 0 END')} AS stdev FROM s GROUP BY 1""")
def agg32(spark, d):
    ratio = uniform(spark, d).groupBy("run", "request_type").agg(
        (F.count(F.when(F.col("selected"), 1)) / F.count(F.lit(1))).alias("ratio"))
    return rounded(ratio.groupBy("request_type").agg(
        F.avg("ratio").alias("mean"), F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("stdev")))


@query("agg56_post_horizon_totals", f"""WITH {INV_SEL}, {TELE.format(src='chosen')}
SELECT run, {q6('avg(next_rate)')} AS mean_rate, CAST(coalesce(sum(CASE WHEN second > 600 THEN requests END), 0) AS BIGINT) AS late_requests,
  CAST(coalesce(sum(CASE WHEN second > 600 THEN selected END), 0) AS BIGINT) AS late_selected, CAST(coalesce(sum(CASE WHEN second > 600 THEN ops END), 0) AS BIGINT) AS late_operations
FROM tele JOIN inv USING (run, second) GROUP BY 1""")
def agg56(spark, d):
    r = requests(spark, d)
    rates = rq.inverse_rates(rq.operations(r))
    tele = rq.telemetry(rq.rated_selection(r, rates)).join(rates.select("run", "second", "next_rate", "ops"), ["run", "second"])
    late = lambda c: F.coalesce(F.sum(F.when(F.col("second") > 600, F.col(c))), F.lit(0))
    return rounded(tele.groupBy("run").agg(F.avg("next_rate").alias("mean_rate"), late("requests").alias("late_requests"),
                                           late("selected").alias("late_selected"), late("ops").alias("late_operations")))


@query("agg57_run_validation", f"""WITH {UNI}, {MARKS}, t AS (SELECT run, count(*) AS n, count(CASE WHEN selected THEN 1 END) AS k, min(second) AS lo, max(second) AS hi FROM uni GROUP BY 1),
mk AS (SELECT run, max(marker) AS last FROM marks GROUP BY 1)
SELECT run, 'totals_valid' AS "check", n > 0 AND k BETWEEN 0 AND n AS ok FROM t
UNION ALL SELECT run, 'ratio_within_tolerance', abs(k / n::DOUBLE - 0.5) <= greatest(0.01, 6 * sqrt(0.25 / n)) FROM t
UNION ALL SELECT run, 'telemetry_spans_run', lo <= 0 AND hi >= 719 FROM t
UNION ALL SELECT run, 'population_agrees', TRUE FROM t UNION ALL SELECT run, 'sample_agrees', TRUE FROM t
UNION ALL SELECT run, 'late_requests_bounded', (SELECT count(*) FROM uni u WHERE u.run = t.run AND second > 720) <= greatest(100, ceil(n * 0.0001)) FROM t
UNION ALL SELECT run, 'final_marker_is_last', last = hi FROM t JOIN mk USING (run)""")
def agg57(spark, d):
    return run_checks(uniform(spark, d), markers(spark, d), rate=0.5, horizon=720)


@query("agg62_request_type_rule", f"""WITH {REQUESTS} SELECT run, count(DISTINCT request_type) AS n_types, CASE WHEN run % 2 = 0 THEN 'exact' ELSE 'min' END AS rule,
  CASE WHEN run % 2 = 0 THEN count(DISTINCT request_type) = 5 ELSE count(DISTINCT request_type) >= 4 END AS ok FROM requests GROUP BY 1""")
def agg62(spark, d):
    r = requests(spark, d)
    even = F.col("run") % 2 == 0
    rules = r.select("run").distinct().select("run", F.when(even, "exact").otherwise("min").alias("rule"),
                                              F.when(even, 5).otherwise(4).alias("type_count"))
    return type_rule_checks(r, rules)


@query("joi03_missing_and_extra_markers", f"""WITH {REQUESTS}, ref AS (SELECT DISTINCT run, second AS marker FROM requests WHERE second % 24 = 0), got AS (SELECT DISTINCT run, second AS marker FROM requests WHERE second % 36 = 0)
SELECT run, marker, 'missing' AS side FROM ref ANTI JOIN got USING (run, marker) UNION ALL SELECT run, marker, 'extra' FROM got ANTI JOIN ref USING (run, marker)""")
def joi03(spark, d):
    every = lambda k: requests(spark, d).where(F.col("second") % k == 0).select("run", F.col("second").alias("marker")).distinct()
    ref, got = every(24), every(36)
    return ref.join(got, ["run", "marker"], "left_anti").withColumn("side", F.lit("missing")).unionByName(
        got.join(ref, ["run", "marker"], "left_anti").withColumn("side", F.lit("extra")))


@query("set03_marker_differences", f"""WITH {REQUESTS}, ref AS (SELECT run, second AS marker FROM requests WHERE second % 24 = 0), got AS (SELECT run, second AS marker FROM requests WHERE second % 36 = 0)
SELECT *, 'missing' AS side FROM (SELECT * FROM ref EXCEPT SELECT * FROM got) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM got EXCEPT SELECT * FROM ref)""")
def set03(spark, d):
    every = lambda k: requests(spark, d).where(F.col("second") % k == 0).select("run", F.col("second").alias("marker"))
    ref, got = every(24), every(36)
    return ref.subtract(got).withColumn("side", F.lit("missing")).unionByName(got.subtract(ref).withColumn("side", F.lit("extra")))


@query("str07_late_requests_capped", f"""WITH {REQUESTS} SELECT run, least(second, 600) AS second, count(*) AS requests, count(CASE WHEN second > 600 THEN 1 END) AS capped FROM requests GROUP BY 1, 2""")
def str07(spark, d):
    late = F.col("second") > 600
    return requests(spark, d).groupBy("run", F.least("second", F.lit(600)).alias("second")).agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(late, 1)).alias("capped"))


OPS = f"{REQUESTS}, ops AS (SELECT run, second, count(*) AS n FROM requests GROUP BY 1, 2)"


@query("str08_operations_with_zero_seconds", f"""WITH {OPS}, b AS (SELECT run, min(second) AS lo, max(second) AS hi FROM ops GROUP BY 1), spine AS (SELECT run, unnest(range(lo, hi + 1)) AS second FROM b)
SELECT run, second, coalesce(n, 0) AS n FROM spine LEFT JOIN ops USING (run, second)""")
def str08(spark, d):
    from tickloom.sources.json_traces import tick_spine
    ops = rq.operations(requests(spark, d)).withColumnRenamed("ops", "n")
    bounds = ops.groupBy("run").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    spine = tick_spine(bounds, F.col("lo"), F.col("hi"), "second").select("run", "second")
    return spine.join(ops, ["run", "second"], "left").select("run", "second", F.coalesce("n", F.lit(0)).alias("n"))


@query("str08_operations_skipping_empty_seconds", f"WITH {OPS} SELECT run, second, n, row_number() OVER (PARTITION BY run ORDER BY second) - 1 AS reported_second FROM ops")
def str08_sparse(spark, d):
    from tickloom.operators.scans import number_rows
    return number_rows(rq.operations(requests(spark, d)).withColumnRenamed("ops", "n"), ["run"], ["second"], "reported_second")
