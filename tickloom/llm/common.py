"""Helpers of the operators: shared folders, written tables, column names, worker state."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ensure_checkpoint_dir


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and kept if executors are lost."""
    folder = fresh_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_class(key: Column, classes: int) -> Column:
    """crc32 of the key as text, modulo ``classes`` (a null key counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(classes).cast("bigint"))


def id_text(column: Column) -> Column:
    """A 64-bit id as text, for frames of Python workers: beside nulls a whole number there would become a float."""
    return column.cast("bigint").cast("string")


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it (``file:/x`` included)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def open_random(uri: str):
    """A file for reads at any offset: memory-mapped where the file system allows it."""
    fs, path = open_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path, "r") if fs.get_file_info(path).size else fs.open_input_file(path)
    return fs.open_input_file(path)


def worker_store() -> dict:
    """What a Python worker keeps between tasks (functions travel by value, their globals do not stay)."""
    return sys.modules.setdefault("tickloom_worker_store", types.ModuleType("tickloom_worker_store")).__dict__


def worker_object(key: tuple, make: Callable[[], object]) -> object:
    """What one operator keeps in a Python worker between tasks: made once, and dropped when another asks for its own.

    A worker serves the operators of a session one after another; it holds the tables and caches of one of them.
    """
    store = worker_store()
    if store.get("kept_key") != key:
        store.pop("kept", None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        store["kept_key"], store["kept"] = key, make()
    return store["kept"]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from batches sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        values = batch[keys].to_numpy()
        ended = np.flatnonzero((values != values[-1]).any(1))
        if len(ended):  # the last group may go on in the next batch
            rows = pd.concat(held, ignore_index=True)
            cut = size - len(batch) + int(ended[-1]) + 1
            yield rows.iloc[:cut].reset_index(drop=True)
            held = [rows.iloc[cut:]]
            size -= cut
    if held:
        yield pd.concat(held, ignore_index=True)
