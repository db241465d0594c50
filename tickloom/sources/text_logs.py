"""Benchmark and load-generator logs: numbered text lines in, typed rows out.

Input everywhere: ``by…, line_no, line`` with ``by`` naming one log file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.scans import last_known, number_rows, scan

# Line shapes of the supported tools.
PROGRESS = r"progress:\s*([0-9.]+)\s*s,\s*([0-9.]+)\s*tps"
FINAL_TPS = r"tps\s*=\s*([0-9.]+)"
REQUESTS = r"^[A-Z_]+:\s+([0-9.]+)\s+requests per second"
LAT_HEADER = r"(?i)^\s*lat percentiles \((nsec|usec|msec|sec)\):"
P99 = r"(?i)99(?:\.0+)?th=\[\s*([0-9.]+)\s*([kmg]?)\]"
STATS_ROW = r"Aggregated\s+(\d+)\s+(\d+)\("
LAST_SEC = r"last sec:\s*(\d+)"
OPERATIONS = r"Total operations:\s*(\d+)\s*;\s*Sec:\s*(\d+)"
TR_LONG = r"TR per second:\s*(\d+(?:\.\d+)?)"
TR_SHORT = r"^TR:\s*(\d+(?:\.\d+)?)\s*$"
LOG_TIME = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+\]"
USERS_SET = r"updating to (\d+) users"
UNIT_US = {"nsec": 1e-3, "usec": 1.0, "msec": 1e3, "sec": 1e6}
PREFIX = {"": 1.0, "k": 1e3, "m": 1e6, "g": 1e9}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of all text files matched by ``path``."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
        F.col("value").alias("line"))
    return number_rows(raw, ["file"], ["__start", "__id"], "line_no").select("file", "line_no", "line")


def group_of(pattern: str, group: int = 1, line: Column | None = None) -> Column:
    """The group of the first match, NULL when the line does not match."""
    line = F.col("line") if line is None else line
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def number_of(pattern: str, group: int = 1) -> Column:
    return group_of(pattern, group).try_cast("double")


def progress_series(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Throughput over time; files without progress lines fall back to final results."""
    by = list(by)
    parsed = lines.select(*by, "line_no", number_of(PROGRESS).alias("t"), number_of(PROGRESS, 2).alias("r"),
                          number_of(FINAL_TPS).alias("f"))
    primary = parsed.where(F.col("r").isNotNull()).select(*by, F.col("t").alias("x"), F.col("r").alias("y"))
    fallback = parsed.where(F.col("f").isNotNull()).join(primary.select(*by), by, "left_anti")
    numbered = number_rows(fallback, by, ["line_no"], "n").select(
        *by, (F.col("n") + 1).cast("double").alias("x"), F.col("f").alias("y"))
    return primary.unionByName(numbered)


def paired_requests(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Requests per second, consecutive results added in pairs."""
    found = lines.select(*by, "line_no", number_of(REQUESTS).alias("v")).where(F.col("v").isNotNull())
    return (
        number_rows(found, by, ["line_no"], "n")
        .groupBy(*by, (F.floor(F.col("n") / 2) + 1).cast("double").alias("x"))
        .agg(F.sum("v").alias("y"))
    )


def _scale(table: dict[str, float], key: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in table.items():
        out = F.when(key == name, F.lit(factor)).otherwise(out)
    return out


def latency_p99(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """p99 latencies in microseconds: the first p99 after each latency header."""
    by = list(by)
    unit = F.lower(group_of(LAT_HEADER))
    marker = F.when(unit.isNotNull(), F.struct(F.col("line_no").alias("at"), unit.alias("unit"))).when(
        F.col("line").contains("percentiles ("),
        F.struct(F.col("line_no").alias("at"), F.lit(None).cast("string").alias("unit")))
    wide = scan(lines, by, ["line_no"], {"m": last_known(marker)}, "line_no")
    value = number_of(P99) * _scale(PREFIX, F.lower(group_of(P99, 2))) * _scale(UNIT_US, F.col("m.unit"))
    hits = wide.where((F.col("m.at") < F.col("line_no")) & F.col("m.unit").isNotNull()).select(
        *by, F.col("m.at").alias("block"), "line_no", value.alias("v")).where(F.col("v").isNotNull())
    first = hits.groupBy(*by, "block").agg(F.min_by("v", "line_no").alias("y"))
    return number_rows(first, by, ["block"], "n").select(
        *by, (F.col("n") + 1).cast("double").alias("x"), "y")


def load_stats(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of the aggregated row that follows the statistics header."""
    by = list(by)
    header = F.col("line").startswith("Type     Name") & F.col("line").contains("req/s")
    heads = lines.where(header).groupBy(*by).agg(F.min("line_no").alias("head"))
    rates = F.split(F.trim(F.try_element_at(F.split("line", r"\|"), F.lit(3))), r"\s+")
    rows = lines.where(F.col("line").startswith("         Aggregated")).select(
        *by, "line_no",
        group_of(STATS_ROW).try_cast("long").alias("total_requests"),
        group_of(STATS_ROW, 2).try_cast("long").alias("total_failures"),
        F.try_element_at(rates, F.lit(1)).try_cast("double").alias("req_per_s"),
        F.try_element_at(rates, F.lit(2)).try_cast("double").alias("failures_per_s"),
    )
    out = ["total_requests", "total_failures", "req_per_s", "failures_per_s"]
    whole = F.col("failures_per_s").isNotNull() & F.col("req_per_s").isNotNull() & F.col("total_requests").isNotNull()
    best = rows.where(whole).join(heads, by).where(F.col("line_no") > F.col("head"))
    return best.groupBy(*by).agg(
        F.min_by(F.struct(*out), "line_no").alias("s")).select(*by, *[F.col(f"s.{c}").alias(c) for c in out])


def user_changes(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Load changes of logs without event rows: seconds since the first stamp, users."""
    by = list(by)
    stamped = lines.select(*by, "line_no", F.to_timestamp(group_of(LOG_TIME)).alias("at"),
                           group_of(USERS_SET).try_cast("int").alias("users")).where(F.col("at").isNotNull())
    first = stamped.groupBy(*by).agg(F.min_by("at", "line_no").alias("t0"))
    return stamped.where(F.col("users").isNotNull()).join(first, by).select(
        *by, (F.col("at").cast("long") - F.col("t0").cast("long")).alias("elapsed_s"), "users")


def _last(pattern: str, group: int, kind: str) -> Column:
    value = F.try_element_at(F.regexp_extract_all("line", F.lit(pattern), group), F.lit(-1))
    return F.max_by(value, F.when(F.col("line").rlike(pattern), F.col("line_no"))).try_cast(kind)


def run_summary(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wall seconds, operations, last bucket and throughput of a benchmark run log."""
    found = lines.groupBy(*by).agg(
        _last(LAST_SEC, 1, "long").alias("wall"),
        _last(OPERATIONS, 1, "long").alias("operations"),
        _last(OPERATIONS, 2, "long").alias("last_bucket"),
        _last(TR_LONG, 1, "double").alias("__tr"),
        _last(TR_SHORT, 1, "double").alias("__short"))
    return found.select(
        *by, "wall", "operations", "last_bucket",
        F.coalesce("__tr", "__short", F.try_divide(F.col("operations").cast("double"), F.col("wall")))
        .alias("throughput"))
