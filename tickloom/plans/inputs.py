"""Inputs of the registered queries, derived from the tables (and their SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import micros
from tickloom.session import note_short
from tickloom.sources.tables import table


def hour_of(ts: Column | str) -> Column:
    """Hours since the epoch."""
    return F.floor(micros(ts) / F.lit(3600000000)).cast("long")


def sec_of(ts: Column | str) -> Column:
    """Seconds since the epoch, with fraction."""
    return micros(ts) / F.lit(1e6)


HOUR = "CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT)"
SEC = "(epoch_us(ts) / 1e6::DOUBLE)"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def log_lines(spark, d, line: Column) -> DataFrame:
    """One log file per user, one line per event."""
    return events(spark, d).select(F.col("user_id").cast("string").alias("file"),
                                   F.col("event_id").alias("line_no"), line.alias("line"))


def lines_sql(line: str) -> str:
    return f"lines AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id AS line_no, {line} AS line, * FROM events)"


def phases(spark, d) -> DataFrame:
    """A load schedule per user: one phase per event, its type giving the direction."""
    from tickloom.operators.scans import number_rows
    from tickloom.sources.schedules import phase_bounds

    e = events(spark, d)
    direction = (
        F.when(F.col("event_type").isin("click", "signup"), "up")
        .when(F.col("event_type") == "purchase", "down").otherwise("stable"))
    rows = e.select(
        F.col("user_id").cast("string").alias("shape"), "event_id",
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("name"),
        (F.floor("value") + 1).cast("int").alias("duration_s"),
        F.floor(F.col("value") * 2).cast("int").alias("users"), direction.alias("direction"))
    return phase_bounds(number_rows(note_short(rows, "shape"), ["shape"], ["event_id"], "seq"))


PHASES = """raw_phases AS (
  SELECT CAST(user_id AS VARCHAR) AS shape, event_id, 'p' || event_id AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
    CAST(floor(value) + 1 AS INTEGER) AS duration_s, CAST(floor(value * 2) AS INTEGER) AS users,
    CASE WHEN event_type IN ('click', 'signup') THEN 'up' WHEN event_type = 'purchase' THEN 'down' ELSE 'stable' END AS direction
  FROM events),
phases AS (
  SELECT *, end_s - duration_s AS start_s FROM (
    SELECT *, CAST(sum(duration_s) OVER (PARTITION BY shape ORDER BY seq) AS DOUBLE) AS end_s FROM raw_phases))"""


def requests(spark, d) -> DataFrame:
    """Request rows: run = user_id mod 10, one second per hour since the first event."""
    e = events(spark, d).withColumn("__h", hour_of("ts"))
    first = e.agg(F.min("__h")).scalar()
    return e.select(
        (F.col("user_id") % 10).alias("run"), F.col("event_id").alias("event_index"),
        (F.col("__h") - first).alias("second"), F.col("event_type").alias("request_type"),
        (F.col("value") - 50.0).alias("delta"), F.rint(F.col("value") * 1e6).cast("long").alias("execution"))


REQUESTS = f"""requests AS (
  SELECT user_id % 10 AS run, event_id AS event_index, {HOUR} - (SELECT min({HOUR}) FROM events) AS second,
    event_type AS request_type, value - 50.0 AS delta, CAST(round_even(value * 1e6, 0) AS BIGINT) AS execution
  FROM events)"""
