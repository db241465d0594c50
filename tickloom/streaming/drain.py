"""Running a stream over everything that is there, into files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Process all available input once and read the written result back."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, "offsets")).option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_steps(steps: Sequence[DataFrame], stream_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Let rows arrive step by step and read back all that the stream gave.

    Every step is written by as many tasks as it has and processed as one micro-batch; state, watermark and offsets go on
    in the checkpoint folder. ``stream_of`` turns the stream of all rows into the stream to be written.
    """
    spark = steps[0].sparkSession
    rows, out, offsets = (scratch_path(spark, n) for n in ("arriving", "stream", "offsets"))
    schema = None
    for step in steps:
        step.write.mode("append").parquet(rows)
        stream = stream_of(spark.readStream.schema(steps[0].schema).parquet(rows))
        schema = stream.schema
        (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", offsets)
         .option("path", out).trigger(availableNow=True).start()).awaitTermination()
    return spark.read.schema(schema).parquet(out)
