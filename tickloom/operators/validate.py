"""Named data-quality checks of a run, as a table ``run, check, ok``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.requests import telemetry


def run_checks(selected: DataFrame, markers: DataFrame, rate: float, horizon: int) -> DataFrame:
    """Totals, selection ratio, telemetry span and agreement, late requests, final marker."""
    totals = selected.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("selected"), 1)).alias("k"),
        F.count(F.when(F.col("second") > horizon, 1)).alias("late"))
    tele = telemetry(selected).groupBy("run").agg(
        F.min("second").alias("lo"), F.max("second").alias("hi"),
        F.max("population_size").alias("pop"), F.max("sample_size").alias("sam"))
    last = markers.groupBy("run").agg(F.max("marker").alias("last"))
    ratio = F.abs(F.col("k") / F.col("n") - rate)
    tolerance = F.greatest(F.lit(0.01), 6.0 * F.sqrt(F.lit(rate * (1.0 - rate)) / F.col("n")))
    checks = {
        "totals_valid": (F.col("n") > 0) & F.col("k").between(F.lit(0), F.col("n")),
        "ratio_within_tolerance": ratio <= tolerance,
        "telemetry_spans_run": (F.col("lo") <= 0) & (F.col("hi") >= horizon - 1),
        "population_agrees": F.col("pop") == F.col("n"),
        "sample_agrees": F.col("sam") == F.col("k"),
        "late_requests_bounded": F.col("late") <= F.greatest(F.lit(100), F.ceil(F.col("n") * 0.0001)),
        "final_marker_is_last": F.col("last") == F.col("hi"),
    }
    rows = totals.join(tele, "run").join(last, "run")
    return rows.select("run", F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), ok.alias("ok")) for name, ok in checks.items()])).alias("c")).select("run", "c.*")


def type_rule_checks(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Number of request types per run against an exact or minimum rule."""
    kinds = requests.groupBy("run").agg(F.count_distinct("request_type").alias("n_types"))
    ok = F.when(F.col("rule") == "exact", F.col("n_types") == F.col("type_count")).otherwise(
        F.col("n_types") >= F.col("type_count"))
    return kinds.join(rules, "run").select("run", "n_types", "rule", ok.alias("ok"))
