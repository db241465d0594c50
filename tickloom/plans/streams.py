"""Queries: streams drained from the event table, and written outputs read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import sinks
from tickloom.functions.numeric import r6
from tickloom.operators import fidelity as fd
from tickloom.operators import sweep as sw
from tickloom.params import grid, make_config
from tickloom.plans.fidelity import CFG, TRACKS, adaptive_events, kept_events, rounded
from tickloom.plans.inputs import events
from tickloom.plans.registry import q6, query
from tickloom.plans.requests import SUMMARY, TELE, UNI, markers, uniform
from tickloom.plans.sqltext import EVENTS, MASKED, sampler
from tickloom.plans.sweeps import LABELS, SWEEP, grid_sweep
from tickloom.sources.tables import event_trace, table
from tickloom.streaming.drain import drain, scratch_path
from tickloom.streaming.stateful import member_lifecycle, stream_replay
from tickloom.streaming.windows import tumbling_counts


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


ORDERED = """trace AS (SELECT event_type AS series_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS tick, value FROM events)"""


def streamed(spark, d):
    rows = event_stream(spark, d).select(F.col("event_type").alias("series_id"), "event_id", "value")
    return drain(stream_replay(rows, make_config(**CFG), position="event_id"))


@query("str01_streaming_sampler", f"""WITH RECURSIVE {ORDERED}, {sampler('poll', 'trace', threshold=3.0)}
SELECT series_id, event_id, sampled, interval::BIGINT AS interval, {q6('urgency')} AS urgency, status, {q6('mean')} AS mean, FALSE AS late FROM poll JOIN (SELECT series_id, tick, event_id FROM trace) USING (series_id, tick)""")
def str01(spark, d):
    return rounded(streamed(spark, d).select("series_id", "event_id", "sampled", "interval", "urgency", "status", "mean", "late"))


@query("str03_held_sample", f"""WITH RECURSIVE {ORDERED}, {sampler('poll', 'trace', threshold=3.0)}
SELECT series_id, event_id, {q6('last_value(mean IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS held FROM poll JOIN (SELECT series_id, tick, event_id FROM trace) USING (series_id, tick)""")
def str03(spark, d):
    return streamed(spark, d).select("series_id", "event_id", r6("held").alias("held"))


IDLE_MS = 36 * 3600 * 1000


@query("str02_member_lifecycle", f"""WITH m AS (SELECT user_id AS member, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last, count(*) AS n FROM events GROUP BY 1), w AS (SELECT epoch_us(max(ts)) // 1000 AS wm FROM events)
SELECT member, 'track_start' AS event, first AS at_ms, 0::BIGINT AS n_rows FROM m UNION ALL SELECT member, 'track_stop', last, n FROM m, w WHERE last + {IDLE_MS} < wm - 3600000""")
def str02(spark, d):
    rows = event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    return drain(member_lifecycle(rows, "user_id", "ts", IDLE_MS))


@query("str04_tumbling_counts", """SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def str04(spark, d):
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling_counts(e, "ts", "1 hour", ["event_type"], ["click", "view"]).select(
        "event_type", F.unix_millis("start").alias("start_ms"), "n")


# --- outputs -----------------------------------------------------------------------------

@query("snk01_trace_files", f"WITH {EVENTS} SELECT series_id, tick AS t, value FROM trace")
def snk01(spark, d):
    path = scratch_path(spark, "trace")
    sinks.write_trace(event_trace(spark, d), path)
    return spark.read.schema("t long, value double, series_id string").json(path)


@query("snk02_run_report", f"""{TRACKS}, s AS (SELECT series_id, count(*) AS n, avg(value) AS m, count(CASE WHEN full_status = 'OUTLIER' THEN 1 END) AS dense_outliers, count(CASE WHEN status = 'OUTLIER' THEN 1 END) AS adaptive_outliers,
  count(CASE WHEN sampled THEN 1 END) / count(*)::DOUBLE AS ratio FROM tracks GROUP BY 1)
SELECT series_id, n, {q6('m')} AS mean, {q6('ratio')} AS sample_ratio, dense_outliers, adaptive_outliers, 3.0::DOUBLE AS outlier_threshold FROM s""")
def snk02(spark, d):
    dense, kept = adaptive_events(spark, d)
    report = sinks.run_report(fd.info_loss(dense, kept, ["series_id"], ["series_id"]), dense, kept, make_config(**CFG))
    path = scratch_path(spark, "report")
    sinks.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("series_id", F.col("trace_stats.n").alias("n"), r6(F.col("trace_stats.mean")).alias("mean"),
                       r6(F.col("info_loss.sample_ratio")).alias("sample_ratio"), F.col("dense_status.outlier").alias("dense_outliers"),
                       F.col("adaptive_status.outlier").alias("adaptive_outliers"), F.col("config.outlier_threshold").alias("outlier_threshold"))


@query("snk03_sweep_files", f"{SWEEP} SELECT series_id, config_id, {LABELS} AS config_label, sample_ratio, peak_recall_top5 FROM report")
def snk03(spark, d):
    configs = grid({"outlier_threshold": [1.0, 3.0], "max_interval": [10, 20]})
    path = scratch_path(spark, "sweep")
    sinks.write_sweep(sw.describe(grid_sweep(spark, d), configs, ["outlier_threshold", "max_interval"]), path)
    legend = spark.read.schema("config_id int, config_label string").json(f"{path}/legend")
    records = spark.read.parquet(f"{path}/records").drop("config_label")
    return rounded(records.join(legend, "config_id").select("series_id", "config_id", "config_label", "sample_ratio", "peak_recall_top5"))


@query("snk04_comparison_csv", f"""WITH {EVENTS}, {MASKED} SELECT 'n_of_m' AS method, series_id, count(*) AS n_total, {q6('avg(CASE WHEN sampled THEN 1.0 ELSE 0.0 END)')} AS sample_ratio FROM kept GROUP BY 2
UNION ALL SELECT 'every_fifth', series_id, count(*), {q6('avg(CASE WHEN tick % 5 = 0 THEN 1.0 ELSE 0.0 END)')} FROM trace GROUP BY 2""")
def snk04(spark, d):
    a = kept_events(spark, d).withColumn("method", F.lit("n_of_m"))
    b = event_trace(spark, d).withColumn("sampled", F.col("tick") % 5 == 0).withColumn("method", F.lit("every_fifth"))
    rows = fd.sampling_efficiency(a.unionByName(b), ["method", "series_id"])
    path = scratch_path(spark, "comparison")
    sinks.write_comparison(rows, path, ["method", "series_id", "n_total", "sample_ratio"])
    return rounded(spark.read.option("header", True).schema("method string, series_id string, n_total long, sample_ratio double").csv(path))


@query("snk05_type_summary_with_total", f"WITH {UNI} SELECT run, request_type, total_requests, selected_requests, positive_total_sum FROM ({SUMMARY})")
def snk05(spark, d):
    return request_files(spark, d, "summary", "run long, request_type string, total_requests long, selected_requests long, positive_total_count long, positive_total_sum double",
                         ["run", "request_type", "total_requests", "selected_requests", "positive_total_sum"])


@query("snk06_telemetry_file", f"""WITH {UNI}, {TELE.format(src='uni')} SELECT run, second, requests, selected, {q6('mean_rate')} AS mean_rate FROM tele""")
def snk06(spark, d):
    return request_files(spark, d, "telemetry", "run long, second long, requests long, selected long, mean_rate double",
                         ["run", "second", "requests", "selected", "mean_rate"])


def request_files(spark, d, name, schema, columns):
    path = scratch_path(spark, "requests")
    sinks.write_request_outputs(uniform(spark, d), markers(spark, d), path)
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(f"{path}/{name}")
    kinds = dict(p.split() for p in schema.split(", "))
    return rounded(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]))
