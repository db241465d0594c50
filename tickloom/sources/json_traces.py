"""JSON traces and event logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import finite
from tickloom.operators.scans import running_sum, scan

EVENT_ROW = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("pod", T.StringType()),
    T.StructField("pod_name", T.StringType()), T.StructField("namespace", T.StringType()),
    T.StructField("t", T.LongType()), T.StructField("value", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
    T.StructField("urgency", T.DoubleType()), T.StructField("interval", T.IntegerType()),
    T.StructField("sampled", T.BooleanType()), T.StructField("wall", T.DoubleType()),
])


def array_elements(text: Column) -> Column:
    """JSON array text -> array of element texts; one level of wrapping is removed."""
    outer = F.from_json(text, "array<string>")
    first = F.try_element_at(outer, F.lit(1))
    return F.when(F.ltrim(first).startswith("["), F.from_json(first, "array<string>")).otherwise(outer)


def json_values(docs: DataFrame, by: Sequence[str], text: str, field: str | None) -> DataFrame:
    """``by…, tick, value`` from one JSON array per row, strings read as numbers."""
    exploded = docs.select(*by, F.posexplode(array_elements(F.col(text))).alias("tick", "__e"))
    value = F.col("__e") if field is None else F.get_json_object("__e", f"$.{field}")
    return exploded.select(*by, F.col("tick").cast("long"), finite(value.try_cast("double")).alias("value"))


def detect_field(docs: DataFrame, text: str) -> str | None:
    """Dotted path of the first numeric leaf of the first element (None: flat array).

    One element decides, as for any schema inference; only that element is fetched.
    """
    row = docs.select(F.try_element_at(array_elements(F.col(text)), F.lit(1)).alias("e")).where(
        F.col("e").isNotNull()).first()
    return first_numeric(json.loads(row.e)) if row is not None else None


def first_numeric(sample: object) -> str | None:
    """Dotted path of the first numeric leaf of an element; None if it is no object."""
    if not isinstance(sample, dict):
        return None
    for path, leaf in _leaves(sample, ""):
        try:
            float(leaf)
        except (TypeError, ValueError):
            continue
        return path
    raise ValueError(f"no numeric field in {sorted(sample)}")


def _leaves(node: dict, prefix: str):
    for key, child in node.items():
        if isinstance(child, dict):
            yield from _leaves(child, f"{prefix}{key}.")
        else:
            yield f"{prefix}{key}", child


def parse_log_lines(lines: DataFrame, schema: T.StructType, line: str = "line") -> DataFrame:
    """JSON lines as typed columns; blank and corrupt lines are left out."""
    guarded = T.StructType(schema.fields + [T.StructField("__bad", T.StringType())])
    parsed = F.from_json(F.col(line), guarded, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rest = [c for c in lines.columns if c != line]
    rows = lines.where(F.trim(F.col(line)) != "").withColumn("__r", parsed)
    return rows.where(F.col("__r").isNotNull() & F.col("__r.__bad").isNull()).select(
        *rest, *[F.col(f"__r.{f.name}").alias(f.name) for f in schema.fields])


def read_event_log(spark: SparkSession, path: str, schema: T.StructType = EVENT_ROW) -> DataFrame:
    """JSON-lines logs, plain or gzip, without blank and corrupt lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def is_reading() -> Column:
    return F.col("event").isNull() & F.col("value").isNotNull()


def member_readings(log: DataFrame, namespace: str, name_pattern: str | None = None) -> DataFrame:
    """Readings of members announced in ``namespace`` (and matching the name pattern)."""
    started = log.where((F.col("event") == "track_start") & (F.col("namespace") == namespace))
    if name_pattern is not None:
        started = started.where(F.col("pod_name").rlike(name_pattern))
    return log.where(is_reading()).join(started.select("pod"), "pod", "left_semi")


def list_column_trace(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: str,
                      stride: int, metric: int) -> DataFrame:
    """``by…, tick, value`` from flat lists holding (T x stride) matrices.

    The tick continues over the rows of a key in the given order; only the list
    lengths take part in that scan, the lists themselves stay where they are.
    """
    if not 0 <= metric < stride:
        raise ValueError(f"metric {metric} outside 0..{stride - 1}")
    steps = F.floor(F.size(values) / stride)
    wide = scan(rows.withColumn("__n", steps), by, list(order),
                {"__base": running_sum(F.col("__n"), inclusive=False)})
    # get() is zero-based and NULL past the end
    picked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1),
                         lambda i: F.get(F.col(values), (i * stride + metric).cast("int")).cast("double"))
    return wide.where(F.col("__n") > 0).select(
        *by, F.coalesce("__base", F.lit(0)).alias("__base"), F.posexplode(picked).alias("__p", "value")
    ).select(*by, (F.col("__base") + F.col("__p")).cast("long").alias("tick"), "value")


def read_list_column(spark: SparkSession, path: str, column: str, stride: int, metric: int,
                     task: int | None = None, max_points: int = 0) -> DataFrame:
    """Hive-partitioned list-column dataset: partition filter, one column, one metric."""
    rows = spark.read.parquet(path)
    if task is not None:
        rows = rows.where(F.col("tasks") == task)
    rows = rows.select("tasks", column, F.col("_metadata.file_path").alias("__f"),
                       F.col("_metadata.row_index").alias("__r"))
    trace = list_column_trace(rows, ["tasks"], ["__f", "__r"], column, stride, metric)
    return trace.where(F.col("tick") < max_points) if max_points > 0 else trace


# Values per time step of the known list columns.
STRIDES = {"tr_self": 54, "lin_self": 39, "td_self": 13, "tr_oth": 54, "lin_oth": 39, "td_oth": 13}


def tick_spine(bounds: DataFrame, low: Column, high: Column, name: str = "tick", step: int = 65536) -> DataFrame:
    """One row per integer in [low, high], made in two levels so no array gets long."""
    pieces = bounds.withColumn("__lo", low.cast("long")).withColumn("__hi", high.cast("long")).where(
        F.col("__hi") >= F.col("__lo")).withColumn(
        "__p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__hi") - F.col("__lo")) / step))))
    start = F.col("__lo") + F.col("__p") * step
    stop = F.least(F.col("__hi"), start + (step - 1))
    return pieces.withColumn(name, F.explode(F.sequence(start, stop))).drop("__lo", "__hi", "__p")


def densify(sparse: DataFrame, by: Sequence[str], tick: str = "t", value: str = "value") -> DataFrame:
    """Dense axis 0..max(t): missing ticks get a NULL value and ``sampled`` = false."""
    by = list(by)
    spine = tick_spine(sparse.groupBy(*by).agg(F.max(tick).alias("__max")), F.lit(0), F.col("__max"), tick)
    known = sparse.select(*by, tick, value)
    return spine.drop("__max").join(known, [*by, tick], "left").withColumn(
        "sampled", F.col(value).isNotNull())
