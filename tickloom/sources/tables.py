"""Traces derived from event-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.scans import number_rows
from tickloom.session import count_short, is_small, mark_short


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def build_trace(df: DataFrame, series: Column, ts: str, tie: str, value: Column,
                small: bool | None = None) -> DataFrame:
    """``(series_id, tick, ts, value)``: rows of a series numbered in time order."""
    rows = df.select(series.cast("string").alias("series_id"), F.col(ts).alias("ts"),
                     F.col(tie).alias("__tie"), value.cast("double").alias("value"))
    if small is None and not is_small(rows) and count_short(rows, ["series_id"]):
        numbered = number_rows(rows, ["series_id"], ["ts", "__tie"], "tick", small=True)
        return mark_short(numbered, ["series_id"]).select("series_id", "tick", "ts", "value")
    return number_rows(rows, ["series_id"], ["ts", "__tie"], "tick", small).select(
        "series_id", "tick", "ts", "value")


def event_trace(spark: SparkSession, folder: str) -> DataFrame:
    """One series per event type."""
    return build_trace(table(spark, folder, "events"), F.col("event_type"), "ts", "event_id",
                       F.col("value"))


def user_trace(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user."""
    return build_trace(table(spark, folder, "events"), F.col("user_id"), "ts", "event_id",
                       F.col("value"))


def revenue_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Daily revenue per return flag, aggregated before it is numbered."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    daily = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"),
                 F.date_trunc("day", "l_shipdate").alias("ts"))
        .agg((F.rint(F.sum(revenue) * 100) / 100).alias("value"))
    )
    return number_rows(daily, ["series_id"], ["ts"], "tick").select(
        "series_id", "tick", "ts", "value")
