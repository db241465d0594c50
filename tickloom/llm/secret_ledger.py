"""Secret scan over a ledger of blobs: every text is scanned once per rule version, wherever it occurs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import fresh_folder, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``at_least`` characters.

    ``hint`` is a (Java) pattern found in every text with a finding; other texts need no scan.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    at_least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "(?i:passw|secret|token|api_?key)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, "[0-9a-f]+", "[0-9a-f]{16}", 0, 16),
)
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; empty before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def scan_new_blobs(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Append to the ledger the findings of all blob and rule-version pairs that it does not hold yet.

    A blob is the SHA-256 of a whole text (null: empty). Copies of a text are one blob, however many rows
    hold it; of the texts only those that a rule's hint admits are shuffled and scanned, the others get
    empty findings. A batch that fails leaves the ledger as it was, and a repeated batch adds nothing.
    Returns the ledger.
    """
    spark = versions.sparkSession
    keys = [r.key for r in rules]
    text = F.coalesce(F.col(text_col), F.lit(""))
    admitted = F.lit(False)
    for rule in rules:
        admitted = admitted | text.rlike(rule.hint)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), F.when(admitted, text).alias("text"))
    done = (read_ledger(spark, ledger).filter(F.col("rule").isin(keys))
            .groupBy("blob").agg(F.collect_set("rule").alias("done")))
    todo = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce("done", F.array().cast("array<string>")))
    pending = (blobs.groupBy("blob").agg(F.first("text").alias("text")).join(done, "blob", "left")
               .select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {r.key: (re.compile(r.pattern, re.ASCII).finditer, r) for r in rules}
        for batch in batches:
            out = []
            for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"]):
                for key in todo:
                    find, rule = ready[key]
                    spans = [{"start": m.start(), "end": m.end()} for m in find(text)
                             if len(m.group(rule.group)) >= rule.at_least] if text else []
                    out.append((blob, key, spans))
            yield pd.DataFrame(out, columns=["blob", "rule", "spans"])

    pending.mapInPandas(scan, LEDGER).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def secret_findings(versions: DataFrame, path_cols: list[str], ledger: str | None = None,
                    rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All spans of every row of ``versions`` (a path, a version, its text): path columns, blob, spans.

    ``spans`` is an array of (start, ord, kind, end) by start, then by the order of the rules; offsets count
    code points and the end is exclusive. Repeated rows, null paths and null texts each keep their row; the
    spans of a null or empty text are empty. Other columns are not read.
    """
    spark = versions.sparkSession
    ledger = ledger or fresh_folder(spark, "ledger")
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("ord"), F.lit(r.kind).alias("kind")))])
    rows = (scan_new_blobs(versions, ledger, rules, text_col)
            .filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
            .withColumn("at", order[F.col("rule")]))
    found = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("at.ord").alias("ord"), F.col("at.kind").alias("kind"), s["end"].alias("end")))))).alias("spans"))
    found = written(found, "findings")  # both sides of the join are dealt anew, so that a blob of many paths can be split
    paths = versions.select(*path_cols, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return paths.join(found, "blob", "left").select(*path_cols, "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans):
    """Column ``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
