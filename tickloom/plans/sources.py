"""Queries: scans of list columns, JSON, event logs, text logs and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import r6
from tickloom.operators.masks import n_of_m
from tickloom.operators.scans import number_rows
from tickloom.plans.fidelity import rounded
from tickloom.plans.inputs import PHASES, events, lines_sql, log_lines, phases
from tickloom.plans.registry import q6, query
from tickloom.plans.sqltext import EVENTS, MASKED, USERS
from tickloom.sources import json_files as jf
from tickloom.sources import json_traces as jt
from tickloom.sources import records as rec
from tickloom.sources import schedules as sc
from tickloom.sources import text_logs as tl
from tickloom.sources.tables import event_trace, table, user_trace
from tickloom.streaming.drain import scratch_path

def val():
    return F.col("value").cast("string")


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("src01_list_column_trace", """WITH flat AS (
  SELECT label, vec_id, unnest(range(8)) AS p, embedding FROM embeddings)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, p) - 1 AS tick,
  CAST(embedding[CAST(p * 8 + 3 AS INTEGER) + 1] AS DOUBLE) AS value FROM flat""")
def src01(spark, d):
    return jt.list_column_trace(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", 8, 3)


@query("src01_list_column_single_feature", """WITH flat AS (
  SELECT vec_id, unnest(range(4)) AS p, embedding FROM embeddings WHERE label = 3)
SELECT row_number() OVER (ORDER BY vec_id, p) - 1 AS tick,
  CAST(embedding[CAST(p * 13 AS INTEGER) + 1] AS DOUBLE) AS value FROM flat""")
def src01_task(spark, d):
    rows = table(spark, d, "embeddings").where(F.col("label") == 3)
    return jt.list_column_trace(rows, ["label"], ["vec_id"], "embedding", 13, 0).drop("label")


@query("src03_json_trace", """SELECT event_id AS doc, CAST(p AS BIGINT) AS tick, CASE p WHEN 0 THEN value ELSE user_id::DOUBLE END AS value
FROM events, (SELECT unnest(range(2)) AS p)""")
def src03(spark, d):
    docs = events(spark, d).select(F.col("event_id").alias("doc"), cat(
        '[[{"usage": {"k": "', val(), '"}}, {"usage": {"k": ', F.col("user_id"), '}}]]').alias("text"))
    return jt.json_values(docs, ["doc"], "text", "usage.k")


@query("src04_detected_json_field", "SELECT event_id AS doc, 0::BIGINT AS tick, value, 'usage.cpus' AS field FROM events")
def src04(spark, d):
    docs = events(spark, d).select(F.col("event_id").alias("doc"), cat(
        '[{"name": "', F.col("event_type"), '", "usage": {"kind": "x", "cpus": "', val(), '"}, "mem": 1}]').alias("text"))
    field = jt.detect_field(docs, "text")
    return jt.json_values(docs, ["doc"], "text", field).withColumn("field", F.lit(field))


@query("src05_composed_trace_file", """SELECT event_id AS doc, CAST(p AS BIGINT) AS tick, CASE p WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE value END AS value,
  p AS kind_tick FROM events, (SELECT unnest(range(3)) AS p)""")
def src05(spark, d):
    two = F.col("value") * 2
    docs = events(spark, d).select(F.col("event_id").alias("doc"), cat(
        '[{"t": 0, "value": ', val(), '}, {"t": 1, "value": ', two, '}, {"t": 2, "value": ', val(), "}]").alias("text"))
    return jt.json_values(docs, ["doc"], "text", "value").withColumn("kind_tick", F.col("tick"))


ARRAY_FILES = """SELECT event_type, event_id // 65536 AS part, value,
  row_number() OVER (PARTITION BY event_type, event_id // 65536 ORDER BY event_id) - 1 AS tick FROM events"""


def array_files(spark, d, element, opening="[", closing="]"):
    """JSON array files of one line, one per event type and 65,536 event ids, and the rows read back from them."""
    rows = events(spark, d).select("event_type", F.floor(F.col("event_id") / 65536).alias("part"), "event_id", element.alias("element"))
    order = Window.partitionBy("event_type", "part").orderBy("event_id")
    line = F.concat(F.when(F.lag("event_id").over(order).isNull(), opening).otherwise(""), "element",
                    F.when(F.lead("event_id").over(order).isNull(), closing).otherwise(""))
    path = scratch_path(spark, "json-arrays")
    rows.select("event_type", "part", "event_id", line.alias("line")).sortWithinPartitions("event_type", "part", "event_id").select(
        "event_type", "part", "line").write.partitionBy("event_type", "part").option("lineSep", ",").text(path)
    return path


def with_file_keys(trace):
    found = lambda name: F.regexp_extract("file", f"{name}=([^/]+)/", 1)
    return trace.select(found("event_type").alias("event_type"), found("part").cast("long").alias("part"), "tick", "value")


@query("src03_json_array_files", ARRAY_FILES)
def src03_files(spark, d):
    """Elements with commas, brackets and quotes in strings and lists; the field is detected."""
    element = cat('{"name": "a, \\"[{", "at": {"list": [1, [2, 3]], "cpus": "', val(), '"}, "mem": ', F.col("user_id"), "}")
    path = array_files(spark, d, element, "[ [", "], [7, 8]]\n")
    return with_file_keys(jf.read_json_trace(spark, path))


@query("src05_plain_array_files", ARRAY_FILES)
def src05_files(spark, d):
    return with_file_keys(jf.read_json_trace(spark, array_files(spark, d, val())))


LOG_SQL = """log AS (SELECT event_id AS line_no, CASE WHEN event_type = 'signup' THEN 'track_start' END AS event,
    CAST(user_id AS VARCHAR) AS pod, 'web-' || user_id AS pod_name,
    CASE WHEN user_id % 3 = 0 THEN 'kube-system' ELSE 'default' END AS namespace,
    CASE WHEN event_type <> 'signup' THEN value END AS value
  FROM events WHERE event_type <> 'error')"""


def log_rows(spark, d):
    """JSON lines with reading and event rows; lines of one type are cut short."""
    event = F.when(F.col("event_type") == "signup", F.lit("track_start"))
    row = F.to_json(F.struct(
        event.alias("event"), F.col("user_id").cast("string").alias("pod"),
        cat("web-", F.col("user_id")).alias("pod_name"),
        F.when(F.col("user_id") % 3 == 0, "kube-system").otherwise("default").alias("namespace"),
        F.when(event.isNull(), F.col("value")).alias("value")))
    line = F.when(F.col("event_type") == "error", F.substring(row, 1, 12)).otherwise(row)
    return events(spark, d).select(F.col("event_id").alias("line_no"), line.alias("line"))


def event_log(spark, d):
    return jt.parse_log_lines(log_rows(spark, d), jt.EVENT_ROW).select(
        "line_no", "event", "pod", "pod_name", "namespace", "value")


@query("src06_jsonl_event_log", f"WITH {LOG_SQL} SELECT * FROM log")
def src06(spark, d):
    return event_log(spark, d)


@query("src06_gzip_event_files", f"WITH {LOG_SQL} SELECT event, pod, pod_name, namespace, value FROM log")
def src06_files(spark, d):
    """The same log through compressed files, with blank lines between its lines."""
    lines = log_rows(spark, d).select(F.explode(F.array("line", F.lit(""))).alias("line"))
    path = scratch_path(spark, "event-log")
    lines.write.option("compression", "gzip").text(path)
    return jt.read_event_log(spark, path).select("event", "pod", "pod_name", "namespace", "value")


READINGS = """SELECT line_no, pod, value FROM log l WHERE event IS NULL AND value IS NOT NULL AND EXISTS (
  SELECT 1 FROM log s WHERE s.event = 'track_start' AND s.namespace = 'default' AND s.pod = l.pod{more})"""


@query("src07_readings_of_members", f"WITH {LOG_SQL} " + READINGS.format(more=" AND regexp_matches(s.pod_name, '^web-1')"))
def src07(spark, d):
    return jt.member_readings(event_log(spark, d), "default", "^web-1").select("line_no", "pod", "value")


@query("joi02_semi_members", f"WITH {LOG_SQL} " + READINGS.format(more=""))
def joi02(spark, d):
    return jt.member_readings(event_log(spark, d), "default").select("line_no", "pod", "value")


@query("src08_progress_log", f"""WITH {lines_sql("'x'")}
SELECT file, event_id::DOUBLE AS x, value AS y FROM lines WHERE user_id % 2 = 0 AND event_type = 'click'
UNION ALL
SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no)::DOUBLE, value FROM lines l
WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM lines p WHERE p.file = l.file AND p.user_id % 2 = 0 AND p.event_type = 'click')""")
def src08(spark, d):
    line = (
        F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0),
               cat("progress: ", F.col("event_id"), " s, ", val(), " tps, lat 1.0 ms"))
        .when(F.col("event_type") == "view", cat("tps = ", val(), " (excluding connections)"))
        .otherwise(F.lit("starting vacuum...")))
    return tl.progress_series(log_lines(spark, d, line), ["file"])


@query("src09_paired_request_log", f"""WITH {lines_sql("'x'")}, hits AS (
  SELECT file, line_no, value, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS n FROM lines WHERE event_type IN ('click', 'view'))
SELECT file, (n // 2 + 1)::DOUBLE AS x, {q6('sum(value)')} AS y FROM hits GROUP BY file, n // 2""")
def src09(spark, d):
    line = F.when(F.col("event_type") == "click", cat("GET: ", val(), " requests per second")).when(
        F.col("event_type") == "view", cat("LPUSH_X: ", val(), " requests per second, p50=0.1")).otherwise(
        F.lit("get: 5 requests per second"))
    return rounded(tl.paired_requests(log_lines(spark, d, line), ["file"]))


@query("src10_latency_log", f"""WITH {lines_sql("'x'")}, marked AS (
  SELECT *, last_value(CASE WHEN event_type IN ('click', 'signup') THEN line_no END IGNORE NULLS) OVER w AS block,
    last_value(CASE WHEN event_type = 'click' THEN 'msec' WHEN event_type = 'signup' THEN 'none' END IGNORE NULLS) OVER w AS unit
  FROM lines WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT file, block, min_by(value * CASE event_type WHEN 'view' THEN 1.0 ELSE 1e3 END * 1e3, line_no) AS y FROM marked
  WHERE event_type IN ('view', 'error') AND unit = 'msec' GROUP BY 1, 2)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY block)::DOUBLE AS x, {q6('y')} AS y FROM hits""")
def src10(spark, d):
    line = (
        F.when(F.col("event_type") == "click", F.lit("     lat percentiles (msec):"))
        .when(F.col("event_type") == "signup", F.lit("     clat percentiles (usec):"))
        .when(F.col("event_type") == "view", cat("     | 99.00th=[ ", val(), "], 99.50th=[ 1]"))
        .when(F.col("event_type") == "error", cat("     | 99.00th=[ ", val(), "k], 99.50th=[ 1]"))
        .otherwise(F.lit("     |  1.00th=[    5],  5.00th=[    6]")))
    return rounded(tl.latency_p99(log_lines(spark, d, line), ["file"]))


@query("src11_load_generator_stats", f"""WITH {lines_sql("'x'")},
h AS (SELECT file, min(line_no) AS head FROM lines WHERE event_type = 'click' GROUP BY 1)
SELECT file, min_by(event_id, line_no) AS total_requests, min_by(user_id, line_no) AS total_failures,
  min_by(value, line_no) AS req_per_s, min_by(value / 4, line_no) AS failures_per_s
FROM lines JOIN h USING (file) WHERE event_type = 'view' AND line_no > head GROUP BY 1""")
def src11(spark, d):
    line = (
        F.when(F.col("event_type") == "click", F.lit("Type     Name   # reqs   # fails |  Avg  Min |  req/s  failures/s"))
        .when(F.col("event_type") == "view", cat(
            "         Aggregated    ", F.col("event_id"), "     ", F.col("user_id"), "(0.00%) |   3    1 |   ",
            val(), "     ", F.col("value") / 4))
        .otherwise(F.lit("GET      /     5     0(0.00%) |  1  1 |  1.0  0.0")))
    return tl.load_stats(log_lines(spark, d, line), ["file"])


@query("src12_load_events", """SELECT user_id::VARCHAR AS file, event_id AS line_no,
  CASE event_type WHEN 'click' THEN 'phase_start' WHEN 'view' THEN 'phase_end' ELSE 'load_end' END AS event, value AS observed_offset_s
FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def src12(spark, d):
    name = (F.when(F.col("event_type") == "click", "phase_start").when(F.col("event_type") == "view", "phase_end")
            .when(F.col("event_type") == "purchase", "load_end").otherwise("heartbeat"))
    line = F.to_json(F.struct(name.alias("event"), F.col("value").alias("observed_offset_s")))
    return rec.load_events(log_lines(spark, d, line), ["file", "line_no"]).select(
        "file", "line_no", "event", "observed_offset_s")


@query("src12_legacy_user_changes", f"""WITH {lines_sql("'x'")}, stamped AS (
  SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM lines WHERE event_type <> 'error')
SELECT file, s - first_value(s) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS elapsed_s,
  CAST(floor(value) AS INTEGER) AS users, event_type
FROM stamped QUALIFY event_type = 'click'""".replace(", event_type\nFROM", "\nFROM"))
def src12_legacy(spark, d):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(F.col("event_type") == "click", cat("[", stamp, ",123] host/INFO: updating to ", F.floor("value"), " users at rate 5"))
        .when(F.col("event_type") == "error", F.lit("Traceback (most recent call last):"))
        .otherwise(cat("[", stamp, ",001] host/INFO: tick")))
    return tl.user_changes(log_lines(spark, d, line), ["file"])


RUN_LOG_SQL = f"""WITH {lines_sql("'x'")}, found AS (
  SELECT file, max_by(user_id + 1, CASE WHEN event_type = 'click' THEN line_no END) AS wall,
    max_by(event_id, CASE WHEN event_type = 'view' THEN line_no END) AS operations,
    max_by(user_id, CASE WHEN event_type = 'view' THEN line_no END) AS last_bucket,
    max_by(value, CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN line_no END) AS tr,
    max_by(value, CASE WHEN event_type = 'purchase' AND user_id % 3 = 1 THEN line_no END) AS tr_short
  FROM lines GROUP BY 1)
SELECT file, wall, operations, last_bucket, {q6('coalesce(tr, tr_short, operations::DOUBLE / wall)')} AS throughput FROM found"""


def run_log(spark, d):
    line = (
        F.when(F.col("event_type") == "click", cat("last sec: ", F.col("user_id") + 1))
        .when(F.col("event_type") == "view", cat("Total operations: ", F.col("event_id"), " ; Sec: ", F.col("user_id")))
        .when((F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0), cat("TR per second: ", val()))
        .when((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 1), cat("TR: ", val()))
        .otherwise(F.lit("===== run =====")))
    return rounded(tl.run_summary(log_lines(spark, d, line), ["file"]))


@query("src13_benchmark_run_log", RUN_LOG_SQL)
def src13(spark, d):
    return run_log(spark, d)


@query("top07_last_matching_line", f"""WITH {lines_sql("'x'")}
SELECT file, max_by(event_id, line_no) AS operations FROM lines WHERE event_type = 'view' GROUP BY 1""")
def top07(spark, d):
    return run_log(spark, d).select("file", "operations").where(F.col("operations").isNotNull())


@query("src14_cycle_csv", """SELECT event_id AS line_no, event_type AS kind, user_id AS cycle,
  CASE WHEN event_type <> 'view' THEN value END AS mean_value FROM events""")
def src14(spark, d):
    line = cat(F.col("event_type"), ",", F.col("user_id"), ",", F.when(F.col("event_type") == "view", "").otherwise(val()))
    lines = events(spark, d).select(F.col("event_id").alias("line_no"), line.alias("line"))
    return rec.parse_csv(lines, "kind string, cycle long, mean_value double", ["line_no"])


@query("src15_marker_list", """WITH m AS (SELECT user_id::VARCHAR AS file, event_id AS line_no, event_id * 2 AS marker FROM events WHERE event_type NOT IN ('error', 'view'))
SELECT file, line_no, marker, coalesce(marker > lag(marker) OVER (PARTITION BY file ORDER BY line_no), TRUE) AS increasing FROM m""")
def src15(spark, d):
    line = (F.when(F.col("event_type") == "error", F.lit("# comment")).when(F.col("event_type") == "view", F.lit("  "))
            .otherwise(cat(F.col("event_id") * 2)))
    return rec.parse_markers(log_lines(spark, d, line), ["file"])


@query("src16_phase_schedule", f"WITH {PHASES} SELECT shape, name, CAST(seq AS BIGINT) AS seq, start_s, end_s, direction FROM phases")
def src16(spark, d):
    return phases(spark, d).select("shape", "name", "seq", "start_s", "end_s", "direction")


DAEMON_SQL = """starts AS (SELECT user_id % 40 AS run, (user_id // 40) % 4 AS arm, event_id, value FROM events WHERE event_type = 'signup' AND user_id % 7 <> 0)"""


@query("src22_run_configuration", f"""WITH {DAEMON_SQL}, own AS (
  SELECT run, arm, min_by(value, event_id) AS outlier_threshold, min_by(value / 8, event_id) AS tracker_offset FROM starts GROUP BY 1, 2),
arms AS (SELECT DISTINCT user_id % 40 AS run, (user_id // 40) % 4 AS arm FROM events),
lent AS (SELECT run, min_by(outlier_threshold, arm) AS t, min_by(tracker_offset, arm) AS o FROM own GROUP BY 1)
SELECT arms.run, arms.arm, coalesce(outlier_threshold, t) AS outlier_threshold, coalesce(tracker_offset, o, 0.0) AS tracker_offset,
  outlier_threshold IS NULL AS borrowed
FROM arms LEFT JOIN own USING (run, arm) LEFT JOIN lent USING (run)""")
def src22(spark, d):
    e = events(spark, d).withColumn("run", F.col("user_id") % 40).withColumn("arm", F.floor(F.col("user_id") / 40) % 4)
    is_start = (F.col("event_type") == "signup") & (F.col("user_id") % 7 != 0)
    log = e.select("run", "arm", F.col("event_id").alias("line_no"),
                   F.when(is_start, F.lit("daemon_start")).otherwise(F.lit("reading")).alias("event"),
                   F.struct(F.col("value").alias("outlier_threshold")).alias("config"),
                   (F.col("value") / 8).alias("tracker_offset"))
    return rec.run_configuration(log, ["run"], "arm").select(
        "run", "arm", F.col("config.outlier_threshold").alias("outlier_threshold"), "tracker_offset", "borrowed")


@query("src23_nested_payloads", f"""SELECT event_id AS doc,
  CASE event_type WHEN 'error' THEN 0.03 WHEN 'view' THEN value ELSE user_id / 1000.0 END::DOUBLE AS cpu_target,
  CASE WHEN event_type = 'click' THEN 2 ELSE 1 END::INTEGER AS min_replicas,
  CASE WHEN event_type <> 'signup' THEN user_id END::INTEGER AS max_replicas FROM events""")
def src23(spark, d):
    good = F.when(F.col("event_type") == "view", val()).otherwise(cat(F.col("user_id"), "m"))
    first = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(good)
    bounds = F.concat(
        F.when(F.col("event_type") == "click", F.lit('"minReplicas": 2, ')).otherwise(F.lit("")),
        F.when(F.col("event_type") == "signup", F.lit("")).otherwise(cat('"maxReplicas": ', F.col("user_id"), ", ")))
    doc = cat('{"items": [{"spec": {', bounds, '"metrics": [{"resource": {"target": {"averageValue": "oops"}}}, '
              '{"pods": {"target": {"averageValue": "', first, '"}}}]}}]}')
    docs = events(spark, d).select(F.col("event_id").alias("doc"), doc.alias("text"))
    return rec.scaler_settings(docs, ["doc"], "text")


@query("src23_scale_events", """SELECT event_id AS doc, 'SuccessfulRescale' AS reason, 'New size: ' || user_id AS message, CAST(event_id AS VARCHAR) AS "lastTimestamp" FROM events WHERE event_type <> 'signup'
UNION ALL SELECT event_id, 'SuccessfulRescale', NULL, NULL FROM events WHERE event_type = 'purchase'""")
def src23_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", F.lit("FailedGetMetric")).otherwise(F.lit("SuccessfulRescale"))
    more = F.when(F.col("event_type") == "purchase", F.lit(', {"reason": "SuccessfulRescale"}, {"message": "no reason"}')).otherwise(F.lit(""))
    doc = cat('{"items": [{"reason": "', kind, '", "message": "New size: ', F.col("user_id"), '", "lastTimestamp": "', F.col("event_id"), '"}', more, "]}")
    return rec.scale_events(events(spark, d).select(F.col("event_id").alias("doc"), doc.alias("text")), ["doc"], "text")


OBSERVED_SQL = f"""{PHASES}, seen AS (
  SELECT shape, name, start_s + 0.5 AS start_s, end_s + 0.25 AS end_s, direction, start_s AS scheduled_start_s, end_s AS scheduled_end_s
  FROM phases WHERE direction <> 'down')"""


def observed(spark, d):
    """Start and end events per phase; falling phases lack the end."""
    both = phases(spark, d).select("shape", F.explode(F.array(
        F.struct(F.lit("phase_start").alias("event"), F.col("name").alias("phase"), "direction",
                 (F.col("start_s") + 0.5).alias("observed_offset_s"), F.col("start_s").alias("scheduled_offset_s")),
        F.struct(F.when(F.col("direction") != "down", F.lit("phase_end")).otherwise(F.lit("lost")).alias("event"),
                 F.col("name").alias("phase"), "direction", (F.col("end_s") + 0.25).alias("observed_offset_s"),
                 F.col("end_s").alias("scheduled_offset_s")))).alias("e")).select("shape", "e.*")
    return sc.observed_phases(both, ["shape"])


@query("src24_recorded_phases", f"""WITH {OBSERVED_SQL} SELECT * FROM seen""")
def src24(spark, d):
    return observed(spark, d).select("shape", "name", "start_s", "end_s", "direction", "scheduled_start_s", "scheduled_end_s")


@query("src24_effective_phases", f"""WITH {OBSERVED_SQL}
SELECT p.shape, p.name, coalesce(s.start_s, p.start_s) AS start_s, coalesce(s.end_s, p.end_s) AS end_s
FROM phases p LEFT JOIN seen s USING (shape, name)""")
def src24_effective(spark, d):
    return sc.effective_phases(phases(spark, d), observed(spark, d), ["shape"]).select("shape", "name", "start_s", "end_s")


@query("src26_sparse_to_dense", f"""WITH {EVENTS}, {MASKED}, ends AS (SELECT series_id, max(tick) AS last FROM kept WHERE sampled GROUP BY 1)
SELECT k.series_id, k.tick AS t, CASE WHEN sampled THEN value END AS value, sampled FROM kept k JOIN ends USING (series_id) WHERE k.tick <= last""")
def src26(spark, d):
    kept = event_trace(spark, d).where(n_of_m(F.col("tick"), 2, 5)).withColumnRenamed("tick", "t")
    return jt.densify(kept.select("series_id", "t", "value"), ["series_id"])


@query("src27_record_table", f"""WITH {USERS}, rows AS (
  SELECT series_id, tick + CASE WHEN series_id LIKE '%7' AND tick >= 4 THEN 1 ELSE 0 END AS tick,
    CASE WHEN trace.tick % 3 <> 1 THEN value END AS value, trace.tick % 3 <> 1 AS sampled, trace.tick % 4 = 0 AS timed, value / 10 AS urgency
  FROM trace),
gaps AS (SELECT *, tick - lag(tick) OVER (PARTITION BY series_id ORDER BY tick) AS step FROM rows)
SELECT series_id, count(*) AS total_rows, count(CASE WHEN sampled OR value IS NOT NULL THEN 1 END) AS sampled_rows,
  count(CASE WHEN timed THEN 1 END) AS timing_measured_rows, {q6('count(CASE WHEN timed THEN 1 END) / count(*)::DOUBLE')} AS timing_measured_fraction,
  1 + count(CASE WHEN sampled OR value IS NOT NULL THEN 1 END) // 3 AS updated_rows,
  {q6('avg(urgency)')} AS mean_urgency, bool_or(coalesce(step <> 1, FALSE)) AS sparse_ticks, bool_or(value IS NULL) AS sparse_values
FROM gaps GROUP BY 1""")
def src27(spark, d):
    t = user_trace(spark, d)
    hole = F.when(F.col("series_id").endswith("7") & (F.col("tick") >= 4), 1).otherwise(0)  # these series skip a tick
    rows = t.select("series_id", (F.col("tick") + hole).alias("t"), F.when(F.col("tick") % 3 != 1, F.col("value")).alias("value"),
                    (F.col("tick") % 3 != 1).alias("sampled"), (F.col("tick") % 4 == 0).alias("timing_measured"),
                    F.lit(None).cast("boolean").alias("updated"), F.lit(3).alias("update_every"),
                    (F.col("value") / 10).alias("urgency"))
    return rounded(rec.record_metadata(rows, ["series_id"]))


@query("src28_member_versions", """WITH docs AS (SELECT *, 'pod-' || user_id AS name FROM events)
SELECT event_id AS doc, name,
  event_type NOT IN ('error', 'view') AS ready,
  CASE WHEN event_type <> 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS metric_version,
  CAST(greatest(user_id, event_id) AS BIGINT) AS n_sampled FROM docs""")
def src28(spark, d):
    name = cat("pod-", F.col("user_id"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = events(spark, d)
    doc = F.col("event_id").alias("doc")
    pods = cat('{"items": [{"metadata": {"name": "', name, '", "labels": {"app": "web"}',
               F.when(F.col("event_type") == "error", F.lit(', "deletionTimestamp": "now"')).otherwise(F.lit("")),
               '}, "status": {"conditions": [{"type": "Init", "status": "True"}, {"type": "Ready", "status": "',
               F.when(F.col("event_type") == "view", F.lit("False")).otherwise(F.lit("True")), '"}]}}]}')
    metrics = cat('{"items": [{"metadata": {"name": "', name, '"}, "timestamp": "', stamp, '", "containers": [',
                  F.when(F.col("event_type") == "signup", F.lit('{"usage": {}}')).otherwise(F.lit('{"usage": {"cpu": "5m"}}')),
                  "]}]}")
    tracks = cat('{"nodes": [{"tracks": [{"pod_name": "', name, '", "namespace": "default", "n_sampled": ', F.col("user_id"),
                 '}]}, {"tracks": [{"pod_name": "', name, '", "namespace": "default", "n_sampled": ', F.col("event_id"),
                 '}, {"pod_name": "other", "namespace": "kube", "n_sampled": 9}]}]}')
    ready = rec.ready_members(e.select(doc, pods.alias("text")), ["doc"], "text", "web")
    version = rec.metric_versions(e.select(doc, metrics.alias("text")), ["doc"], "text", "resource")
    sample = rec.sample_versions(e.select(doc, tracks.alias("text")), ["doc"], "text", "default")
    base = e.select(doc, name.alias("name"))
    return (
        base.join(ready.withColumn("__r", F.lit(True)), ["doc", "name"], "left")
        .join(version, ["doc", "name"], "left").join(sample, ["doc", "name"], "left")
        .select("doc", "name", F.coalesce("__r", F.lit(False)).alias("ready"), "metric_version", "n_sampled"))


@query("src30_representative_run", f"""WITH runs AS (
  SELECT event_type AS workload, user_id AS repeat, ts, event_id, value FROM events),
pick AS (SELECT workload, CASE WHEN bool_or(repeat = 1) THEN 1 ELSE min(repeat) END AS repeat FROM runs GROUP BY 1),
ticks AS (SELECT workload, value, row_number() OVER (PARTITION BY workload ORDER BY ts, event_id) - 1 AS i FROM runs JOIN pick USING (workload, repeat))
SELECT workload, {q6('round_even((i + 1) * 0.2::DOUBLE * 10, 0) / 10')} AS at_s, CAST(round_even(value, 0) AS BIGINT) AS value FROM ticks WHERE i >= 2 AND (i - 2) % 3 = 0""")
def src30(spark, d):
    runs = events(spark, d).select(F.col("event_type").alias("workload"), F.col("user_id").alias("repeat"), "ts", "event_id", "value")
    one = rec.representative_run(runs, ["workload"], "repeat", 1)
    ticks = number_rows(one, ["workload"], ["ts", "event_id"], "i")
    return rec.thinned_points(ticks, "i", skip=2, step=3, seconds_per_tick=0.2).select("workload", r6("at_s").alias("at_s"), "value")
