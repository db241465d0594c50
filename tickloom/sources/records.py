"""Records, nested payloads and small typed files of monitoring runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.scans import previous, scan
from tickloom.sources.json_traces import parse_log_lines

# The event names of a load log; the CPU target when none can be read.
LOAD_EVENTS = ("load_armed", "load_start", "phase_start", "phase_end", "load_end")
DEFAULT_CPU_TARGET = 0.03

LOAD_ROW = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("direction", T.StringType()), T.StructField("users", T.IntegerType()),
    T.StructField("spawn_rate", T.IntegerType()), T.StructField("scheduled_offset_s", T.DoubleType()),
    T.StructField("observed_offset_s", T.DoubleType()), T.StructField("observed_epoch_ns", T.LongType()),
])


def load_events(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    return parse_log_lines(lines.select(*keep, "line"), LOAD_ROW).where(F.col("event").isin(*LOAD_EVENTS))


def parse_csv(lines: DataFrame, schema: str, keep: Sequence[str]) -> DataFrame:
    """Comma-separated lines as typed columns; an empty field is NULL."""
    return lines.select(*keep, F.from_csv("line", F.lit(schema), {"nullValue": "", "emptyValue": ""}).alias("__r")).select(
        *keep, "__r.*")


def parse_markers(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Marker lists without comments and blanks, flagged where they fail to increase."""
    text = F.trim("line")
    rows = lines.where((text != "") & ~text.startswith("#")).select(*by, "line_no", text.try_cast("long").alias("marker"))
    wide = scan(rows, by, ["line_no"], {"__p": previous(F.col("marker"))}, "line_no")
    return wide.withColumn("increasing", F.coalesce(F.col("marker") > F.col("__p"), F.lit(True))).drop("__p")


def run_configuration(log: DataFrame, by: Sequence[str], arm: str) -> DataFrame:
    """First ``daemon_start`` per arm; an arm without one borrows from the first arm that has it."""
    by = list(by)
    own = log.where(F.col("event") == "daemon_start").groupBy(*by, arm).agg(
        F.min_by("config", "line_no").alias("__c"), F.min_by("tracker_offset", "line_no").alias("__o"))
    lent = own.groupBy(*by).agg(F.min_by("__c", arm).alias("__lc"), F.min_by("__o", arm).alias("__lo"))
    arms = log.select(*by, arm).distinct()
    return arms.join(own, by + [arm], "left").join(lent, by, "left").select(
        *by, arm, F.coalesce("__c", "__lc").alias("config"),
        F.coalesce("__o", "__lo", F.lit(0.0)).alias("tracker_offset"), F.col("__c").isNull().alias("borrowed"))


def cpu_quantity(text: Column) -> Column:
    """Cores of a quantity such as ``30m``; NULL when it is not a number."""
    milli = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double") / 1000.0
    return F.when(text.endswith("m"), milli).otherwise(text.try_cast("double"))


_TARGET = "struct<target:struct<averageValue:string>>"
_SCALER = (f"struct<items:array<struct<spec:struct<minReplicas:int,maxReplicas:int,"
           f"metrics:array<struct<resource:{_TARGET},pods:{_TARGET}>>>>>>")


def scaler_settings(docs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """First readable CPU target and the replica bounds of an autoscaler document."""
    parsed = docs.select(*by, F.from_json(text, _SCALER).alias("p"))
    metrics = F.flatten(F.transform("p.items", lambda i: F.coalesce(i["spec"]["metrics"], F.array())))
    values = F.transform(metrics, lambda m: cpu_quantity(
        F.coalesce(m["resource"]["target"]["averageValue"], m["pods"]["target"]["averageValue"])))
    first = F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))
    spec = F.try_element_at("p.items", F.lit(1))["spec"]
    return parsed.select(*by, F.coalesce(first, F.lit(DEFAULT_CPU_TARGET)).alias("cpu_target"),
                         F.coalesce(spec["minReplicas"], F.lit(1)).alias("min_replicas"),
                         spec["maxReplicas"].alias("max_replicas"))


def scale_events(docs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Rows of an event list payload that report a rescale."""
    kind = "struct<items:array<struct<reason:string,message:string,lastTimestamp:string>>>"
    return docs.select(*by, F.explode(F.from_json(text, kind)["items"]).alias("e")).select(
        *by, "e.*").where(F.col("reason") == "SuccessfulRescale")


_POD = ("struct<items:array<struct<metadata:struct<name:string,deletionTimestamp:string,labels:struct<app:string>>,"
        "status:struct<conditions:array<struct<type:string,status:string>>>>>>")


def ready_members(docs: DataFrame, by: Sequence[str], text: str, app: str) -> DataFrame:
    """Names of labelled, ready members that are not being deleted."""
    items = docs.select(*by, F.explode(F.from_json(text, _POD)["items"]).alias("i"))
    ready = F.exists("i.status.conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    ok = F.col("i.metadata.deletionTimestamp").isNull() & (F.col("i.metadata.labels.app") == app) & F.coalesce(ready, F.lit(False))
    return items.where(ok).select(*by, F.col("i.metadata.name").alias("name"))


_METRIC = ("struct<items:array<struct<metadata:struct<name:string>,describedObject:struct<name:string>,timestamp:string,"
           "value:string,containers:array<struct<usage:struct<cpu:string>>>>>>")


def metric_versions(docs: DataFrame, by: Sequence[str], text: str, mode: str) -> DataFrame:
    """Timestamp per member; entries without name, timestamp or values are left out."""
    items = docs.select(*by, F.explode(F.from_json(text, _METRIC)["items"]).alias("i"))
    name = F.coalesce("i.metadata.name", "i.describedObject.name")
    ok = name.isNotNull() & (F.coalesce(F.col("i.timestamp"), F.lit("")) != "")
    if mode == "resource":
        full = F.forall("i.containers", lambda c: c["usage"]["cpu"].isNotNull())
        ok = ok & (F.size("i.containers") > 0) & F.coalesce(full, F.lit(False))
    elif mode == "custom":
        ok = ok & F.col("i.value").isNotNull()
    return items.where(ok).select(*by, name.alias("name"), F.col("i.timestamp").alias("metric_version"))


_TRACKS = ("struct<nodes:array<struct<tracks:array<struct<pod_name:string,namespace:string,n_sampled:bigint,"
           "last_sample_wall:double>>>>>")


def sample_versions(docs: DataFrame, by: Sequence[str], text: str, namespace: str) -> DataFrame:
    """Highest sample count per member over all nodes."""
    nodes = docs.select(*by, F.explode(F.from_json(text, _TRACKS)["nodes"]).alias("n"))
    tracks = nodes.select(*by, F.explode("n.tracks").alias("t")).where(
        (F.col("t.namespace") == namespace) & F.col("t.pod_name").isNotNull())
    count = F.coalesce("t.n_sampled", F.lit(0))
    return tracks.groupBy(*by, F.col("t.pod_name").alias("name")).agg(
        F.max(count).alias("n_sampled"), F.max_by("t.last_sample_wall", count).alias("last_sample_wall"))


def record_metadata(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and means of a live record table, with the holes it has."""
    by = list(by)
    wide = scan(rows, by, ["t"], {"__p": previous(F.col("t"))}, "t")
    read = F.coalesce(F.col("sampled"), F.lit(False)) | F.col("value").isNotNull()
    out = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(F.when(read, 1)).alias("sampled_rows"),
        F.count(F.when(F.col("timing_measured"), 1)).alias("timing_measured_rows"),
        F.count(F.when(F.col("updated"), 1)).alias("__upd"), F.count("updated").alias("__has"),
        F.min_by("update_every", "t").alias("__every"), F.avg("urgency").alias("mean_urgency"),
        F.bool_or(F.coalesce(F.col("t") - F.col("__p") != 1, F.lit(False))).alias("sparse_ticks"),
        F.bool_or(F.col("value").isNull()).alias("sparse_values"))
    fallback = F.when(F.coalesce("__every", F.lit(1)) <= 1, F.col("sampled_rows")).otherwise(
        F.lit(1) + F.floor(F.col("sampled_rows") / F.col("__every")))
    updated = F.when((F.col("__upd") == 0) & (F.col("__has") == 0), fallback).otherwise(F.col("__upd"))
    return out.select(
        *by, "total_rows", "sampled_rows", "timing_measured_rows",
        (F.col("timing_measured_rows") / F.col("total_rows")).alias("timing_measured_fraction"),
        updated.cast("long").alias("updated_rows"), "mean_urgency", "sparse_ticks", "sparse_values")


def representative_run(runs: DataFrame, by: Sequence[str], repeat: str, preferred: object) -> DataFrame:
    """Rows of the preferred repeat where a workload has it, else of its first."""
    by = list(by)
    pick = runs.groupBy(*by).agg(
        F.when(F.bool_or(F.col(repeat) == preferred), F.lit(preferred)).otherwise(F.min(repeat)).alias(repeat))
    return runs.join(pick, by + [repeat], "left_semi")


def thinned_points(ticks: DataFrame, tick: str, skip: int, step: int, seconds_per_tick: float) -> DataFrame:
    """Every ``step``-th tick after the warm-up, ticks as seconds, values as whole numbers."""
    at = F.rint((F.col(tick) + 1) * F.lit(seconds_per_tick) * 10) / 10
    return ticks.where((F.col(tick) >= skip) & ((F.col(tick) - skip) % step == 0)).withColumn(
        "at_s", at).withColumn("value", F.rint("value").cast("long"))
