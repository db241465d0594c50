"""Writing traces, reports, sweeps and request outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.requests import rebuild_cycles, telemetry, type_summary


def write_trace(trace: DataFrame, path: str, fmt: str = "json", by: Sequence[str] = ("series_id",)) -> None:
    """``t, value`` rows, one folder per series."""
    trace.select(*by, F.col("tick").alias("t"), "value").write.partitionBy(*by).format(fmt).save(path)


def run_report(loss: DataFrame, dense: DataFrame, kept: DataFrame, config: Mapping[str, object],
               by: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per run: configuration, trace statistics, information loss and status counts."""
    by = list(by)
    stats = dense.groupBy(*by).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")).alias("trace_stats"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.struct(*[
            F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
            for s in ("INIT", "NORMAL", "OUTLIER", "DRIFT_RESET")]).alias(name))

    metrics = F.struct(*[c for c in loss.columns if c not in by]).alias("info_loss")
    shown = F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("config")
    return (
        loss.select(*by, shown, metrics).join(stats, by)
        .join(counts(dense, "dense_status"), by).join(counts(kept, "adaptive_status"), by)
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)


def write_sweep(sweep: DataFrame, path: str) -> None:
    """Flat records in ``records``, the label of every configuration in ``legend``."""
    sweep.write.parquet(f"{path}/records")
    sweep.select("config_id", "config_label").distinct().write.json(f"{path}/legend")


def write_comparison(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Flat comparison table with a header line."""
    rows.select(*columns).write.option("header", True).csv(path)


def write_request_outputs(selected: DataFrame, markers: DataFrame, path: str) -> None:
    """Summary, telemetry, cycles and markers of a request run."""
    save = lambda df, name: df.write.option("header", True).csv(f"{path}/{name}")
    save(type_summary(selected), "summary")
    save(telemetry(selected), "telemetry")
    save(rebuild_cycles(selected, markers), "cycles")
    save(markers, "markers")
