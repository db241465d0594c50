"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (block_topk, context_tree, decontamination, language_id, pii_surrogates, piece_viterbi,
                          ranked_search, secret_ledger, simhash_dedup, token_counts, token_files, warc_zip,
                          whitening)
from tickloom.llm.common import crc_class

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
END_ID = 2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    packages = warc_zip.write_packages(table(spark, folder, "pages"), min_bytes=0)
    return warc_zip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
      list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS words FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(flatten(list_transform(words, lambda w: list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((w >> s) & 31) + 1 AS BIGINT), 1)))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ledger.secret_findings(table(spark, folder, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secret_ledger.joined(F.col("spans"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _spans_sql(kind: str, order: int, pattern: str, group: int, at_least: int) -> str:
    """SQL for the spans of one kind: the pieces between the matches give their places."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, list_filter(list_transform(range(1, len(e) + 1), lambda i: {{
        'start': CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(e[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        'ord': {order}, 'kind': '{kind}', 'n': CAST(length(e[i]) AS BIGINT), 'g': CAST(length(g[i]) AS BIGINT)}}), lambda s: s.g >= {at_least}) AS s
      FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS e,
                   regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)"""


SQL["op3_secret_ledger"] = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (" + " UNION ALL ".join(
    _spans_sql(r.kind, i, r.pattern, r.group, r.at_least) for i, r in enumerate(secret_ledger.RULES)) + """),
a AS (SELECT doc_id, list_sort(flatten(list(s))) AS s FROM k GROUP BY doc_id),
j AS (SELECT doc_id, s, coalesce(list_aggregate(list_transform(s, lambda x: x.kind || ':' || x.start || ':' || (x.start + x.n)), 'string_agg', ','), '') AS spans FROM a)
SELECT doc_id, CAST(len(list_filter(s, lambda x: x.kind = 'assign')) AS BIGINT) AS n_assign,
  CAST(len(list_filter(s, lambda x: x.kind = 'access')) AS BIGINT) AS n_access,
  CAST(len(list_filter(s, lambda x: x.kind = 'hex')) AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM j"""


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii_surrogates.replace_entities(docs, count_col="n_replaced")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", crc_class(F.col("doc_id"), 4) == 2)
    learned = language_id.learn_prototypes(docs.filter("not held_out"))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), learned, F.col("text"), "found")
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    return block_topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op8_block_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query
def op9_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score_documents(table(spark, folder, "documents"), crc_class(F.col("doc_id"), 5) == 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_viterbi.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _terms_sql(table: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM {table} WHERE text IS NOT NULL")


SQL["op13_ranked_search"] = f"""
WITH d AS ({_terms_sql("documents", "doc_id")}), i AS ({_terms_sql("benchmark", "item_id")}),
a AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""
