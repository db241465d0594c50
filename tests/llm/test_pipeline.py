import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as passages
from tests.llm.test_jaccard_dedup import brute_kept
from tickloom.llm import language_id, piece_viterbi

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the result of every stage, written and read as run() does."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in cp.STAGES:
        result = cp.written(stage(spark, docs, FOLDER), "step")
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(spark, steps):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes
    assert all(result.dtypes == columns for _, result in steps[:-1]) and 4 <= len(cp.STAGES) <= 5


def test_language_keeps_clean_documents(steps):
    before, after = map(rows, steps[0])
    gone = [before[d].text for d in before.keys() - after.keys()]
    assert len(gone) <= 2 and all(len(re.sub(r"[\W\d_]", "", t)) < 10 for t in gone)


def test_one_of_each_group(steps):
    before, after = map(rows, steps[1])
    assert set(after) == brute_kept([(d, r.text) for d, r in before.items()])
    assert all(after[d] == before[d] for d in after)


def test_benchmark_passages_go(spark, steps):
    before, after = map(rows, steps[2])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {r[0] for r in passages([(d, r.text) for d, r in before.items()], items)}
    assert dirty and set(after) == before.keys() - dirty


def test_personal_data_is_replaced(steps):
    before, after = map(rows, steps[3])
    assert before.keys() == after.keys()
    changed = {d for d in before if before[d].text != after[d].text}
    assert changed and all(r.n_chars == len(r.text) for r in after.values())
    assert all((after[d].lang, after[d].source) == (before[d].lang, before[d].source) for d in before)
    emails = {e for r in before.values() for e in re.findall(r"[\w.]+@[\w.]+\w", r.text)}
    assert emails and not any(e in r.text for e in emails for r in after.values())


def test_tokens_give_the_texts_back(steps):
    docs, out = rows(steps[4][0]), steps[4][1]
    assert out.count() == len(docs) and out.filter("not round_trip").count() == 0
    back = out.select("doc_id", piece_viterbi.decoded(F.col("ids"), public_tokenizers.path("piece_bpe_32k.model")).alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == {d: r.text for d, r in docs.items()}


def test_odd_documents_and_empty_table(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the words of a text", "en", "s", 19), (2, "the words of a text", "en", "s", 19),
            (3, "12 34 !!", "xx", None, 8), (4, "les mots et encore " * 30_000, "fr", "s", 570_000), (5, "die Worte hier@mail.example.org", None, "s", 1)]
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, found string, digest int")
    for part in (docs, docs.filter("false")):
        for name, stage in cp.STAGES:
            part = cp.written(stage(spark, part, FOLDER), "odd")
            if name != cp.STAGES[-1][0]:
                assert part.columns == docs.columns
    assert part.count() == 0


def test_odd_documents_stage_by_stage(spark):
    rows = [(None, None, "en"), (1, "", "en"), (2, "the words of a text", "en"), (2, "the words of a text", "en"), (3, "12 34 !!", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = cp.language(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2]
    assert sorted((r.doc_id for r in cp.near_duplicates(spark, docs, FOLDER).collect()), key=str) == [1, 2, 3]
    assert cp.benchmark_passages(spark, docs, FOLDER).count() == cp.personal_data(spark, docs, FOLDER).count() == cp.tokens(spark, docs, FOLDER).count() == 5
    assert language_id.UNKNOWN == "und"
