"""Files that hold one JSON array each, read in byte ranges.

A trace file is often one line, so splitting at line ends would put it into one task. Here the text reader
splits at commas instead, which it can do from any byte on. Which commas separate elements is then known from
running sums over the pieces of a file: of quotes (a comma inside a string) and of brackets (one inside an
element). Each is an ordered scan, so no task needs a whole file; a task holds the pieces of single elements.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.operators.scans import number_rows, running_sum, scan
from tickloom.session import cut
from tickloom.sources.json_traces import first_numeric

HEAD_PIECES = 1 << 16  # pieces of a file's head that the detection of a field may fetch


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"), F.col("value").alias("__text"))


def _file_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, __file``: a number for every file, from the listing alone (no content is read)."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    return cut(names.withColumn("__file", F.monotonically_increasing_id()))


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def read_array_elements(spark: SparkSession, path: str, max_elements: int = 0) -> DataFrame:
    """``file, tick, element`` of JSON array files: the JSON text of every element.

    One level of wrapping is removed: of ``[[a, b], …]`` the elements are those of the first inner array. A file
    whose text is no array, and an empty array, give no row; files may be compressed (those cannot be split).
    """
    files = _file_ids(spark, path)  # pieces are short: a number is moved with them instead of a long path
    pieces = _pieces(spark, path).join(F.broadcast(files), "file").drop("file")  # one row per file of the listing
    rows = number_rows(pieces, ["__file"], ["__start", "__id"], "__at").drop("__start", "__id")
    text = F.col("__text")
    # an escape never reaches across a comma
    bare = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)
    rows = scan(rows, ["__file"], ["__at"], {"__quotes": running_sum(_count(bare, '"'), inclusive=False)}, "__at")
    inside = F.coalesce(F.col("__quotes"), F.lit(0)) % 2 == 1
    unquoted = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), bare), '"[^"]*("|$)', "")
    rest = F.when(inside | F.contains(bare, F.lit('"')), unquoted).otherwise(bare)
    first = F.col("__at") == 0
    rows = rows.withColumn("__inside", inside).withColumn("__rest", rest).withColumns({
        "__step": _count(F.col("__rest"), "[{") - _count(F.col("__rest"), "]}"),
        "__opens": F.when(first & F.col("__rest").rlike(r"^\s*\[\s*\["), 2).when(first & F.col("__rest").rlike(r"^\s*\["), 1).otherwise(0),
    }).drop("__rest", "__quotes")
    rows = scan(rows, ["__file"], ["__at"], {"__depth": running_sum(F.col("__step"), inclusive=False)}, "__at")
    border = lambda depth: (~F.col("__inside") & ~first & (F.col("__depth") == depth)).cast("long")
    rows = scan(rows, ["__file"], ["__at"], {
        "__outer": running_sum(border(1)), "__inner": running_sum(border(2)), "__base": running_sum(F.col("__opens"))}, "__at")
    wrapped = F.col("__base") == 2
    rows = rows.where((F.col("__base") > 0) & (~wrapped | (F.col("__outer") == 0))).withColumn(
        "tick", F.when(wrapped, F.col("__inner")).otherwise(F.col("__outer")))
    if max_elements > 0:
        rows = rows.where(F.col("tick") < max_elements)
    end = F.coalesce("__depth", F.lit(0)) + F.col("__step")
    whole = rows.groupBy("__file", "tick").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__text"))), lambda p: p["__text"]), ",").alias("__whole"),
        F.max("__base").alias("__base"), F.max_by(F.col("__base") - end, "__at").alias("__closed"))
    # the brackets of the array itself belong to its first and last element
    opened = F.when(F.col("tick") > 0, F.col("__whole")).when(
        F.col("__base") == 2, F.regexp_replace("__whole", r"^\s*\[\s*\[", "")).otherwise(F.regexp_replace("__whole", r"^\s*\[", ""))
    whole = whole.withColumn("__whole", opened)
    closed = F.when(F.col("__closed") >= 2, F.regexp_replace("__whole", r"\]\s*\]\s*$", "")).when(
        F.col("__closed") == 1, F.regexp_replace("__whole", r"\]\s*$", "")).otherwise(F.col("__whole"))
    element = F.regexp_replace(closed, r"^\s+|\s+$", "")
    return whole.select("__file", "tick", element.alias("element")).where(F.col("element") != "").join(
        F.broadcast(files), "__file").select("file", "tick", "element")


def detect_file_field(spark: SparkSession, path: str) -> str | None:
    """Dotted path of the first numeric leaf of the first element of the first file that has one.

    Like any schema inference this runs small jobs now: they stop as soon as the head of a file holds a whole element.
    """
    for file in sorted(spark.read.text(path).inputFiles()):
        head = _pieces(spark, file).where(F.col("__start") == 0).select("__text")
        some = 16
        while True:
            texts = [r[0] for r in head.limit(some).collect()]
            text = ",".join(texts).lstrip()
            for _ in range(2):
                text = text[1:].lstrip() if text.startswith("[") else text
            try:
                return first_numeric(json.JSONDecoder().raw_decode(text)[0])
            except json.JSONDecodeError:
                if len(texts) < some or text[:1] == "]":  # no element in this file
                    break
                if some >= HEAD_PIECES:
                    raise ValueError(f"the first element of {file} is not complete within {some} pieces; name the field") from None
                some *= 16
    return None


def read_json_trace(spark: SparkSession, path: str, field: str | None = None, max_points: int = 0) -> DataFrame:
    """``file, tick, value`` of JSON array files, strings read as numbers; the field is detected when not given.

    An element that is no number, or has none at the field, has a NULL value and keeps its tick.
    """
    if field is None:
        field = detect_file_field(spark, path)
    item = F.get(F.from_json(F.concat(F.lit("["), "element", F.lit("]")), "array<string>"), 0)
    value = item if field is None else F.get_json_object("element", f"$.{field}")
    return read_array_elements(spark, path, max_points).select("file", "tick", finite(value.try_cast("double")).alias("value"))
