import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tickloom.llm import piece_viterbi as pv

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "tab\tand\nlines", "🙂 漢字 Ωmega", "a ▁ mark", "é", "x" * 3000, "word " * 5000, "   ", "\x00 nul", "end▁ x"]


@pytest.fixture(scope="module")
def model():
    return pv.PieceModel(open(FILE, "rb").read())


def plain(model, line):
    """Viterbi over all substrings, without automaton."""
    pieces = {p: (model.automaton.get(p)[1], model.automaton.get(p)[2]) for p in model.automaton}
    longest = max(map(len, pieces))
    best = [0.0] + [float("-inf")] * len(line)
    for end in range(1, len(line) + 1):
        for begin in range(max(0, end - longest), end):
            piece = line[begin:end]
            if piece in pieces:
                best[end] = max(best[end], best[begin] + pieces[piece][0])
        if line[end - 1] not in model.alone:
            best[end] = max(best[end], best[end - 1] + model.penalty)
    return best[-1]


def test_best_scores_equal_plain_viterbi(model, spark):
    rng = random.Random(2)
    texts = [t[:300] for t in ODD] + ["".join(rng.choices("abcdehilnort ▁.é漢", k=60)) for _ in range(60)]
    for text in texts:
        line = model.normalised(text)
        ids, score = model.best_path(line)
        assert score == pytest.approx(plain(model, line)), text
    # word by word gives the same score as the whole line
    score_of = {model.automaton.get(p)[2]: model.automaton.get(p)[1] for p in model.automaton}
    for text in texts:
        ids = model.encode(text).tolist()
        whole = model.best_path(model.normalised(text))[0]
        assert [i in score_of for i in ids].count(False) == [i in score_of for i in whole].count(False)
        assert sum(score_of.get(i, 0) for i in ids) == pytest.approx(sum(score_of.get(i, 0) for i in whole))


def unigram(pieces, fallback=False):
    """A hand-made unigram model (not trained)."""
    spec = sentencepiece_model_pb2.ModelProto()
    kinds = spec.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)] + pieces:
        spec.pieces.add(piece=piece, score=score, type=kind)
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, fallback
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix = "identity", True
    spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = False, True
    return spec


@pytest.mark.parametrize("fallback", [False, True])
def test_equals_the_library_on_a_unigram_model(fallback):
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcd▁", k=rng.randint(1, 5))) for _ in range(120)} | set("abc▁"))
    pieces = [(w, -rng.randint(1, 4000) / 256, kinds.NORMAL) for w in words]
    if fallback:
        pieces = [(f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256)] + pieces
    proto = unigram(pieces, fallback).SerializeToString()
    ours, library = pv.PieceModel(proto), SentencePieceProcessor(model_proto=proto)
    for _ in range(400):
        text = "".join(rng.choices("abcdé ", k=rng.randint(0, 40)))
        got = ours.encode(text).tolist()
        assert got == library.encode(text), text
        assert ours.decode(np.array(got)) == library.decode(got)


def test_decoding_equals_the_library(model):
    library = SentencePieceProcessor(model_file=FILE)
    for text in ODD:
        ids = model.encode(text)
        assert model.decode(ids) == library.decode(ids.tolist())
        assert model.returns(text, ids)
        assert model.decode(ids) == text.replace("▁", " ")


def test_documents(spark, model):
    rows = list(enumerate(ODD)) + [(None, "no id"), (50, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, [1], "x") for r in rows], "doc_id long, text string, ids array<int>, n_pieces string").repartition(3)
    got = pv.encode_documents(docs, FILE)
    expected = sorted([(d, model.encode(t).tolist()) for d, t in rows], key=str)
    assert sorted([(r.doc_id, r.ids) for r in got.collect()], key=str) == expected
    assert got.filter("not round_trip or n_pieces <> size(ids)").count() == 0
    back = got.select("doc_id", pv.decoded(F.col("ids"), FILE).alias("text")).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(d, (t or "").replace("▁", " ")) for d, t in rows], key=str)
    assert pv.encode_documents(docs.filter("false"), FILE).count() == 0


def test_query_round_trips(spark):
    from tickloom.llm.queries import QUERIES

    got = QUERIES["op10_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.filter("not round_trip").count() == 0


def test_large_ids_beside_nulls(spark):
    big = 2 ** 53
    docs = spark.createDataFrame([(big + 1, "a"), (None, "b"), (big + 3, "c")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in pv.encode_documents(docs, FILE).collect()} == {big + 1, None, big + 3}


def test_two_generations_of_words(monkeypatch):
    monkeypatch.setattr(pv, "CACHE_BYTES", 2000)
    small, large = (pv.PieceModel(open(FILE, "rb").read()) for _ in range(2))
    large.room = 1 << 20
    for text in ["one two three four five six seven", "  two  one", "one", " one \u2581", "x\u2581one two"] * 3:
        assert small.encode(text).tolist() == large.encode(text).tolist()
        assert len(small.words) + len(small.older) < 12
