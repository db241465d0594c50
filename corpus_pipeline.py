"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. The result of a stage is written and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, jaccard_dedup, language_id, pii_surrogates, piece_viterbi
from tickloom.llm.common import free_name, written

LEAST_COSINE = 0.1  # below it a text has next to no trigram of any learned language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of ``lang``; those without letters or like none of them go."""
    name = free_name(docs, "language_found")
    found = language_id.identify(docs, language_id.learn_prototypes(docs), F.col("text"), name)
    kept = (F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_COSINE)
    return found.filter(kept).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more: the smallest doc_id."""
    return jaccard_dedup.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.filter(decontamination.is_clean(items, F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars follows the new text."""
    out = pii_surrogates.replace_entities(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip of all documents."""
    return piece_viterbi.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", tokens),
]

# No SQL: trigram vectors, XXH64 fingerprints and piece segmentation are beyond it; tests hold every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
