"""Streams whose rows come out of order: counts closed by event-time timers with a side output, and alarms."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNTED = ["key", "bucket", "n", "capped", "late"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BucketCounts(StatefulProcessor):
    """Counts a key's rows by bucket. A timer closes a bucket; rows that come after that are passed on apart.

    Input: bucket (from 0 on). The bucket ``horizon`` also takes all rows past it, and closes ``grace_ms`` after its end.
    Spark's watermark lies ``late_ms`` behind the time at which buckets close: rows up to that old reach this operator
    and are marked late; older ones are dropped by Spark.
    """

    def __init__(self, origin_ms: int, width_ms: int, horizon: int, grace_ms: int, late_ms: int):
        self.origin, self.width, self.horizon, self.grace, self.late = origin_ms, width_ms, horizon, grace_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", "n long, capped long")

    def closing(self, bucket: int) -> int:
        """The watermark at which a bucket closes."""
        return self.origin + (bucket + 1) * self.width - self.late + (self.grace if bucket == self.horizon else 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            for bucket, n in part["bucket"].value_counts().items():
                own = min(int(bucket), self.horizon)
                if self.closing(own) <= now:
                    out.append((key[0], own, int(n), int(n) if bucket > self.horizon else 0, True))
                    continue
                before = self.open.getValue((own,)) if self.open.containsKey((own,)) else (0, 0)
                self.open.updateValue((own,), (int(before[0]) + int(n), int(before[1]) + (int(n) if bucket > self.horizon else 0)))
                self.handle.registerTimer(self.closing(own))
        if out:
            yield pd.DataFrame(out, columns=COUNTED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        bucket = self.horizon if at == self.closing(self.horizon) else (at + self.late - self.origin) // self.width - 1
        if self.open.containsKey((bucket,)):
            n, capped = self.open.getValue((bucket,))
            self.open.removeKey((bucket,))
            yield pd.DataFrame([(key[0], bucket, int(n), int(capped), False)], columns=COUNTED)

    def close(self) -> None:
        pass


def counts_with_late_rows(rows: DataFrame, by: str, bucket: str, ts: str, origin_ms: int, width_ms: int, horizon: int,
                          wait_ms: int, grace_ms: int, late_ms: int) -> DataFrame:
    """by, bucket, n, capped, late: the counts of closed buckets, and apart from them (``late``) the rows that missed theirs.

    A bucket closes ``wait_ms`` after its end has been seen. Needs the RocksDB state store (``state_in_rocksdb``).
    """
    kept = (rows.select(F.col(by).cast("long").alias("key"), F.col(bucket).cast("long").alias("bucket"), F.col(ts).alias("ts"))
            .withWatermark("ts", f"{wait_ms + late_ms} milliseconds"))
    counted = kept.groupBy("key").transformWithStateInPandas(
        BucketCounts(origin_ms, width_ms, horizon, grace_ms, late_ms),
        "key long, bucket long, n long, capped long, late boolean", "append", "EventTime")
    return counted.withColumnsRenamed({"key": by, "bucket": bucket})


def alarms(rows: DataFrame, by: Sequence[str], position: str, ts: str, over: Column, least: int) -> DataFrame:
    """by…, position, alarm: whether ``least`` rows in a row were over the threshold, up to this one.

    ``rows`` needs a watermark on ``ts``. A row waits until the watermark has passed it, so that rows are seen in
    the order of ``ts`` and ``position`` whatever micro-batch they came in; the length of the run is kept between batches.
    """
    by = list(by)

    def run(key, batches, state: GroupState):
        length, waiting = state.get if state.exists else (0, "[]")
        held = json.loads(waiting)
        if not state.hasTimedOut:
            for part in batches:
                held += list(map(list, zip(part["ms"].tolist(), part["at"].tolist(), part["hot"].tolist())))
        now = state.getCurrentWatermarkMs()
        held.sort()
        ready = [h for h in held if h[0] <= now]
        held = held[len(ready):]
        out = []
        for _, at, hot in ready:
            length = length + 1 if hot else 0
            out.append((*key, at, length >= least))
        state.update((length, json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(held[0][0], now) + 1)
        if out:
            yield pd.DataFrame(out, columns=[*by, position, "alarm"])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by) + f", {position} long, alarm boolean"
    kept = rows.select(*by, ts, F.col(position).cast("long").alias("at"), F.unix_millis(F.col(ts)).alias("ms"),
                       F.coalesce(over, F.lit(False)).alias("hot"))
    return kept.groupBy(*by).applyInPandasWithState(
        run, schema, "length long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, as transformWithState needs it; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
