import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import token_files as tf

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "tab\tand\nlines\n\n  end ", "it 's we'll I'D 12,345 x<|endoftext|>y", "é à ü ñ Ωmega ЖЖ 漢字 🙂",
       "nbsp here \u0085 next", "a\x1cb \x1d c", "don't", "\n lead", "trail \n", "x" * 5000, "a b " * 3000, "³ ² ½ ᾳ ́ combining é"]


@pytest.fixture(scope="module")
def encoder():
    return tf.word_encoder(open(FILE, encoding="utf-8").read())


def test_words_give_the_ids_of_the_library(encoder, spark):
    library = Tokenizer.from_file(FILE)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        got = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text[:60]


def expected(rows, library):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(FILE)
    rows = [(i * 7 % 40 - 3, t) for i, t in enumerate(ODD)] + [(None, "no key"), (100, None), (101, "word " * 20000)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, start string, part int").repartition(5)
    manifest = tf.write_token_files(docs, FILE, 2, folder=str(tmp_path / "tokens"))
    got = [tuple(r) for r in tf.read_token_files(manifest).drop("shard").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, library)
    # the flat files themselves, one shard after the other
    flat = np.concatenate([np.fromfile(r.path + ".bin", "<u2") for r in manifest.orderBy("part").collect()])
    assert flat.tolist() == [i for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
                             for i in library.encode(t or "", add_special_tokens=False).ids + [2]]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    got = tf.read_token_files(tf.write_token_files(docs, FILE, 2)).orderBy("start").collect()
    assert len(got) == 3 and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert tf.read_token_files(tf.write_token_files(docs.filter("false"), FILE, 2)).count() == 0


def test_bases_are_prefix_sums(spark):
    m = spark.createDataFrame([(5, "b", 2, 7), (0, "a", 1, 3), (9, "c", 4, 1)], "part int, path string, n_docs long, n_tokens long")
    assert [r.base for r in tf.with_bases(m).orderBy("part").collect()] == [0, 3, 10]


def test_query_equals_brute_force(spark):
    from tickloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(FILE)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op2_token_files"](spark, folder).orderBy(F.col("doc_id")).collect()
    assert [tuple(r) for r in got] == expected(rows, library)


def test_large_ids_beside_nulls(spark):
    big = 2 ** 53
    docs = spark.createDataFrame([(big + 1, "a"), (None, "b"), (big + 3, "c"), (3, "d")], "doc_id long, text string").coalesce(1)
    got = tf.read_token_files(tf.write_token_files(docs, FILE, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, big + 1, big + 3]
