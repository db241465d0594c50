"""Streams that arrive out of order give the rows of their batch twins, whatever the micro-batches are."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from tickloom.operators.counters import sustained
from tickloom.plans import load_all
from tickloom.plans.registry import QUERIES, SQL
from tickloom.streaming.drain import drain_steps
from tickloom.streaming.late import alarms

load_all()
FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if n.endswith("_streamed")]


@pytest.mark.parametrize("name", NAMES)
def test_streamed_queries_against_sql(spark, name):
    assert not compare(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER)


def test_some_rows_are_late(spark):
    con = connect(FOLDER)
    late, on_time = (con.execute(f"SELECT sum(requests) FROM ({SQL['str07_late_requests_streamed']}) WHERE {c}").fetchone()[0] for c in ("late", "NOT late"))
    assert late > 10 and on_time > 10


@pytest.mark.parametrize("n_steps", [1, 3, 20])
def test_alarm_does_not_depend_on_micro_batches(spark, n_steps):
    rng = random.Random(4)
    rows = [(s, i, rng.random() < 0.6) for s in ("a", "b", None) for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, tick long, hot boolean").withColumn("ts", F.timestamp_seconds(F.col("tick") + 10 ** 9))
    # ticks up to 12 places out of order, all within the watermark
    step = F.least(F.lit(n_steps - 1), F.floor((F.col("tick") + 4 * (F.col("tick") % 4)) * n_steps / 60))
    last = spark.createDataFrame([("end", 0, False)], "k string, tick long, hot boolean").withColumn("ts", F.timestamp_seconds(F.lit(4 * 10 ** 9)))
    steps = [frame.where(step == i).coalesce(2) for i in range(n_steps)] + [last]
    got = drain_steps(steps, lambda s: alarms(s.withWatermark("ts", "40 seconds"), ["k"], "tick", "ts", F.col("hot"), 3)).where("k is null or k <> 'end'")
    want = sustained(frame.select("k", "tick", "hot"), ["k"], "tick", F.col("hot"), 3).select("k", "tick", "alarm")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
