"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs whose leaf relations are together below this size are scanned with one
# plain window per series; everything above takes the chunked plans.
SMALL_INPUT_BYTES = 64 * 1024 * 1024
CHUNK_TICKS = 1 << 20
RANGE_BYTES = 128 * 1024 * 1024
MAX_RANGES = 100_000
UNKNOWN_BYTES = 1 << 60
# Keys of at most so many rows are scanned with one plain window per series, however many there are.
SHORT_ROWS = 1 << 16
SHORT = "tickloom.short"  # in the metadata of a tick or key column: the keys by which no series is longer


def local_session(cores: str = "8", app: str = "tickloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.default.parallelism", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable-checkpoint folder: the one that the cluster names.

    Only a single-machine session (a test, the benchmark) gets one of its own if none is set; on a cluster a
    folder of one machine would be missed by the others, so there the setting is needed.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written_bytes(spark: SparkSession, leaf) -> int | None:
    """Bytes of the files of a written result (``cut``); None for any other leaf of a plan."""
    file = leaf.rdd().getCheckpointFile() if leaf.nodeName() == "LogicalRDD" else None
    if file is None or not file.isDefined():
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
    return int(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the leaf relations below ``df`` (file sizes; no job is run).

    A session that shows no plan (a remote one) counts as unknown, that is large. A written result counts as the files
    it was written to: Spark keeps the estimate of the plan that made it, for a join the product of both sides.
    """
    if not hasattr(type(df), "_jdf") and "_jdf" not in df.__dict__:
        return 1 << 62
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        written = _written_bytes(df.sparkSession, leaves.apply(i))
        try:
            total += int(str(leaves.apply(i).stats().sizeInBytes())) if written is None else written
        except ValueError:  # an estimate may have any length
            return UNKNOWN_BYTES
    return total


def _setting(spark: SparkSession, key: str, default: str) -> str:
    return spark.conf.get(key, default)


def mark_short(df: DataFrame, by: Sequence[str], tick: str = "tick") -> DataFrame:
    """``df``, whose keys were counted and found short, with that noted on its tick column."""
    meta = {SHORT: list(by)}
    return df.select(*[F.col(c).alias(c, metadata=meta) if c == tick else F.col(c) for c in df.columns])


def is_short(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether a column says that no key of ``by`` is long. Results do not depend on it, only the plan."""
    return any(SHORT in f.metadata and set(f.metadata[SHORT]) <= set(by) for f in df.schema.fields)


def count_short(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether no key of ``df`` has more than ``spark.tickloom.shortRows`` rows; counts them unless a plan is forced."""
    if _setting(df.sparkSession, "spark.tickloom.path", "auto") != "auto":
        return False
    limit = int(_setting(df.sparkSession, "spark.tickloom.shortRows", str(SHORT_ROWS)))
    longest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (longest or 0) <= limit


def note_short(df: DataFrame, key: str) -> DataFrame:
    """``df``, with a note on the column ``key`` if it is large and its keys were counted and found short."""
    return mark_short(df, [key], key) if not is_small(df) and count_short(df, [key]) else df


def short_as(df: DataFrame, of: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df``, with no more rows of a key than ``of``, noted as short if ``of`` is."""
    return mark_short(df, by, by[0]) if is_short(of, by) else df


def is_small(df: DataFrame, by: Sequence[str] | None = None) -> bool:
    """Whether one series of ``df`` surely fits into one task.

    ``spark.tickloom.path`` = ``single`` or ``chunked`` forces a plan; the default
    compares the size of the input with ``spark.tickloom.smallInputBytes``. Larger inputs count
    as small too where the keys ``by`` are known to be short (``mark_short``).
    """
    spark = df.sparkSession
    path = _setting(spark, "spark.tickloom.path", "auto")
    if path != "auto":
        return path == "single"
    limit = int(_setting(spark, "spark.tickloom.smallInputBytes", str(SMALL_INPUT_BYTES)))
    return input_bytes(df) <= limit or (by is not None and is_short(df, by))


def is_small_union(both: DataFrame, sides: Sequence[DataFrame], by: Sequence[str]) -> bool:
    """``is_small`` of a union, which shows the notes of its first side only: its keys are short where those of all sides are."""
    return is_small(both) or all(is_short(s, by) and is_small(s, by) for s in sides)


def chunk_ticks(spark: SparkSession) -> int:
    return int(_setting(spark, "spark.tickloom.chunkTicks", str(CHUNK_TICKS)))


def reuse(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """``df`` for several uses: as it is when small, written once when not."""
    return df if is_small(df, by) else cut(df)


def task_count(df: DataFrame) -> int:
    """Tasks for costly work on few bytes, which adaptive execution would put together by size: four a core, at most the shuffle partitions."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(base, 4 * df.sparkSession.sparkContext.defaultParallelism)


def range_count(df: DataFrame) -> int:
    """Row ranges for ``df``: about ``RANGE_BYTES`` each, at least four a core (or the shuffle partitions, if fewer).

    Every range costs the driver some hundred sampled keys and the results of its tasks, so a setting of many shuffle
    partitions does not multiply them. ``spark.tickloom.maxRanges`` bounds them (ranges grow beyond that many); rows
    of unknown size, such as those that the driver made, take the shuffle partitions.
    """
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return base
    most = int(_setting(df.sparkSession, "spark.tickloom.maxRanges", str(MAX_RANGES)))
    return max(task_count(df), min(most, size // RANGE_BYTES))
