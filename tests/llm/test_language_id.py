import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language_id as li
from tickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_bundle(p, text):
    """The definition: one bound vector per trigram occurrence, added up."""
    line = [0]
    for c in text:
        code = int(p.lower[ord(c)])
        if code or line[-1]:
            line.append(code)
    if line[-1]:
        line.append(0)
    total = np.zeros(p.dimensions)
    for a, b, c in zip(line, line[1:], line[2:]):
        total += np.roll(p._letter(a), 2).astype(int) * np.roll(p._letter(b), 1) * p._letter(c)
    return total


def test_counts_give_the_bundle_of_all_occurrences(monkeypatch):
    p = li.Profiler(256)
    for text in ["Straße, née É!", "a", "x  9 y", "漢字 と かな", "İstanbul ǅ"]:
        assert np.array_equal(p.bundle(*p.trigrams(text)), plain_bundle(p, text)), text
    monkeypatch.setattr(li, "PIECE", 7)  # pieces of a long text meet exactly
    text = "The quick brown fox -- jumps; over 13 lazy dogs!! " * 9
    assert np.array_equal(p.bundle(*p.trigrams(text)), plain_bundle(p, text))
    monkeypatch.setattr(li, "KNOWN_TRIGRAMS", 8192)
    many = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(9500))
    assert np.array_equal(p.bundle(*p.trigrams(many)), plain_bundle(p, many))


@pytest.mark.parametrize("folder,least", [(FOLDER, 0.9), ("/root/testdata/sf0.01", 0.97)])
def test_held_out_accuracy(spark, folder, least):
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, folder).join(truth, "doc_id").filter("held_out and lang is not null")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 20 and right >= least and 0 <= low <= high <= 1


def test_odd_rows(spark):
    train = [("abc def ghi " * 20, "x"), ("uvw rst opq " * 20, "y"), (None, "x"), ("zzz", None), ("", "y")]
    docs = spark.createDataFrame(train, "text string, lang string")
    learned = li.learn_prototypes(docs)
    assert list(learned) == ["x", "y"]
    rows = [(1, None), (2, ""), (3, "123 ?!"), (4, "abc"), (5, "opq"), (5, "opq"), (None, "ABC"), (7, "漢"), (8, "abc " * 300000)]
    asked = spark.createDataFrame([(*r, 0.5, "c") for r in rows], "doc_id long, text string, score double, lang string")
    got = {r.doc_id: (r.found.lang_pred, r.found.score) for r in li.identify(asked, learned, F.col("text"), "found").collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == got[None][0] == got[8][0] == "x" and got[5][0] == "y" and 0 <= got[7][1] <= 1
    assert li.identify(asked.filter("false"), learned, F.col("text"), "found").count() == 0
    none = li.learn_prototypes(docs.filter("false"))
    assert none == {} and {r.found.lang_pred for r in li.identify(asked, none, F.col("text"), "found").collect()} == {"und"}


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string")
    got = li.identify(docs, li.learn_prototypes(docs), F.col("text"), "found").collect()
    assert {r.found.lang_pred for r in got} == {"a"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([("a b", "1"), ("a b", "2"), ("a b", "3")], "text string, lang string")
    with pytest.raises(ValueError):
        li.learn_prototypes(docs)
