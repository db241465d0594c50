"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position its output links list the pieces that end there, longest
first, and each relaxes the best score of the position. A character that is no piece costs the lowest piece
score less ten and is written as byte pieces (or the unknown piece). Of equal scores the longest piece wins.

Where no piece goes on from another character into the space mark, the best path of a text is the
concatenation of the best paths of its words, so distinct words are searched once and remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, worker_object

SPACE = "▁"
CACHE_BYTES = 48 << 20  # of remembered words, in two generations: when one is full, the older one goes
LONG_WORD = 64  # longer words are not remembered
BATCH_CHARS = 4_000_000
STRANGE = (1, 0.0, -1)  # a character that is no piece


class PieceModel:
    """Pieces, scores and normalisation of a SentencePiece model file."""

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        self.prefix = norm.add_dummy_prefix
        self.library = SentencePieceProcessor(model_proto=proto) if norm.precompiled_charsmap or norm.remove_extra_whitespaces else None
        kinds = type(spec.pieces[0])
        self.automaton = ahocorasick.Automaton()
        self.alone: set[str] = set()
        self.bytes_ids: list[int | None] = [None] * 256
        self.text: list[bytes] = []
        self.unknown = 0
        low, crosses = 0.0, False
        for i, p in enumerate(spec.pieces):
            shown = p.piece.encode("utf-8")
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.automaton.add_word(p.piece, (len(p.piece), float(p.score), i))
                if len(p.piece) == 1:
                    self.alone.add(p.piece)
                low = min(low, p.score)
                crosses = crosses or SPACE in p.piece.lstrip(SPACE)
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes_ids[value], shown = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.unknown, shown = i, b" \xe2\x81\x87 "
            else:
                shown = b""
            self.text.append(shown)
        self.automaton.make_automaton()
        self.penalty = low - 10.0
        self.by_word = not crosses
        self.fallback = spec.trainer_spec.byte_fallback and None not in self.bytes_ids
        self.dtype = np.dtype("<u2" if len(self.text) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = CACHE_BYTES // 2

    def normalised(self, text: str) -> str:
        """``text`` as the pieces see it."""
        if self.library is not None:
            return self.library.normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def best_path(self, line: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a normalised line."""
        n, low = len(line), float("-inf")
        best, back = [low] * (n + 1), [STRANGE] * (n + 1)
        best[0] = 0.0
        if self.alone.issuperset(line):  # every end can be reached by pieces
            for last, piece in self.automaton.iter(line):
                end = last + 1
                score = best[end - piece[0]] + piece[1]
                if score > best[end]:
                    best[end], back[end] = score, piece
        else:
            alone, penalty, done = self.alone, self.penalty, 0

            def strange(upto: int, done: int) -> int:
                """Relax the ends done + 1 .. upto by the characters that are no pieces."""
                while done < upto:
                    if line[done] not in alone:
                        score = best[done] + penalty
                        if score > best[done + 1]:
                            best[done + 1], back[done + 1] = score, STRANGE
                    done += 1
                return done

            for last, piece in self.automaton.iter(line):
                if last > done:
                    done = strange(last, done)
                score = best[last + 1 - piece[0]] + piece[1]
                if score > best[last + 1]:
                    best[last + 1], back[last + 1] = score, piece
            strange(n, done)
        ids: list[int] = []
        at = n
        while at:
            length, _, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.fallback:
                ids.extend(self.bytes_ids[b] for b in reversed(line[at - 1].encode("utf-8", "surrogatepass")))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)  # a run of unknown characters is one unknown piece
            at -= length
        ids.reverse()
        return ids, best[n]

    def _word(self, word: str, key: str) -> bytes:
        """The ids of a stretch of text, remembered under ``key`` (which leaves out a single space mark before it)."""
        ids = self.words.get(key)
        if ids is None:
            ids = self.older.get(key) or array(self.code, self.best_path(word)[0]).tobytes()
            if len(word) <= LONG_WORD:
                self.room -= 240 + 4 * len(word) + len(ids)  # a dictionary entry, its text and its ids, as an upper bound
                if self.room < 0:
                    self.words, self.older, self.room = {}, self.words, CACHE_BYTES // 2
                self.words[key] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        line = self.normalised(text or "")
        if not line:
            return np.empty(0, self.dtype)
        if not self.by_word:
            return np.array(self.best_path(line)[0], self.dtype)
        word = self._word
        if line[0] == SPACE and line[-1] != SPACE and SPACE * 2 not in line:
            get = self.words.get
            return np.frombuffer(b"".join([get(w) or word(SPACE + w, w) for w in line[1:].split(SPACE)]), self.dtype)
        out = []
        for part in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line):
            single = part[0] == SPACE and part[1:2] not in ("", SPACE)
            # other spacing is kept apart by a mark that no key without it begins with
            out.append(word(part, part[1:] if single else part if part[0] == SPACE else SPACE + "\0" + part))
        return np.frombuffer(b"".join(out), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement marks."""
        text = self.text
        line = b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return line[1:] if self.prefix and line[:1] == " " else line

    def returns(self, text: str | None, ids: np.ndarray) -> bool:
        """Whether decoding gives the text back (as normalised; a space mark in the text reads as a space)."""
        line = self.normalised(text or "").replace(SPACE, " ")
        return self.decode(ids) == (line[1:] if self.prefix and line[:1] == " " else line)


def piece_model(proto: bytes) -> PieceModel:
    import zlib

    return worker_object(("pieces", zlib.crc32(proto), len(proto)), lambda: PieceModel(proto))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces, round_trip of every row.

    A null or empty text has no piece and comes back as the empty text. Repeated rows and null ids keep their
    rows; other columns are not read. ``round_trip`` tells whether decoding the ids gives the whole text.
    """
    proto = open(model_file, "rb").read()  # about 0.5 MB, shipped with the function

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(proto)
        for batch in batches:
            begin, chars = 0, 0
            ids: list[np.ndarray] = []
            same: list[bool] = []
            for i, text in enumerate(batch["text"]):
                found = model.encode(text)
                ids.append(found.astype(np.int32))
                same.append(model.returns(text, found))
                chars += len(text or "")
                if chars > BATCH_CHARS or i + 1 == len(batch):
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[begin:i + 1].reset_index(drop=True), "ids": ids,
                                        "n_pieces": [len(x) for x in ids], "round_trip": same})
                    begin, chars, ids, same = i + 1, 0, [], []

    return (docs.select(id_text(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(encode, "doc_id string, ids array<int>, n_pieces long, round_trip boolean")
            .withColumn("doc_id", F.col("doc_id").cast("bigint")))


def decoded(ids: Column, model_file: str) -> Column:
    """Text column of a column of piece ids (null for null)."""
    proto = open(model_file, "rb").read()

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = piece_model(proto)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode(np.asarray(x)) for x in batch], dtype=object)

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decode, "string")(ids)
