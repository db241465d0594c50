import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tickloom.llm import token_counts as tc
from tickloom.llm.queries import QUERIES

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=FILE)
ODD = ["", " ", "  ", "a", " a", "a ", "  two  spaces   here ", "tab\tand\nlines\n\n  end \n", "\n", "\n\n", "\nlead", "a\n b", "a \nb",
       "<s> </s> <unk> <0x0A> <pad> [INST]", "▁", "▁▁a▁ b", "é à ü ñ Ωmega ЖЖ 漢字 🙂🙂", " nbsp\u0085 x", "\x00nul\x00", "x" * 3000,
       "ab " * 2000, "é combining", "\r\nwin\r\n"]


@pytest.fixture(scope="module")
def mine():
    return tc.Counting("m.model", open(FILE, "rb").read())


def test_pre_tokens_count_as_whole_texts(mine):
    assert mine.by_word
    for text in ODD:
        assert mine.count(text, {}) == len(LIBRARY.encode(text)), repr(text[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t▁aeé<s>/0x漢🙂the "), max_size=40))
def test_any_text(text):
    mine = test_any_text.__dict__.setdefault("mine", tc.Counting("m.model", open(FILE, "rb").read()))
    assert mine.count(text, {}) == len(LIBRARY.encode(text))


def test_a_full_cache_starts_again(mine, monkeypatch):
    monkeypatch.setattr(tc, "CACHE_BYTES", 1000)
    small = tc.Counting("m.model", open(FILE, "rb").read())
    for text in ["one two three four five six seven eight nine"] * 3 + ["w" * 100 + " and so on"]:
        assert small.count(text, {" one": mine.exact(" one")}) == len(LIBRARY.encode(text))
        assert len(small.cache) < 8


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(LIBRARY.encode(d.text or ""))
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 4096)


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    big = 2 ** 53
    rows = [(big + 1, "a b"), (None, "c"), (big + 3, None), (big + 3, None), (3, ""), (None, None), (4, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows],
                                 "doc_id long, text string, n_tokens int, n_bytes string, over_limit boolean").coalesce(1)
    got = sorted(map(tuple, tc.token_counts(docs, FILE).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(LIBRARY.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=str)
    assert tc.token_counts(docs.filter("false"), FILE).count() == 0


def test_other_libraries_count_whole_texts(spark):
    docs = spark.createDataFrame([(1, "It's a test <|endoftext|> end"), (2, None)], "doc_id long, text string")
    file = public_tokenizers.path("byte_bpe_50k.json")
    want = len(Tokenizer.from_file(file).encode("It's a test <|endoftext|> end", add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(docs, file).collect()} == {1: want, 2: 0}
