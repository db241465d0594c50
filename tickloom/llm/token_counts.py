"""Token counts of whole texts by a two-tier look-up of pre-tokens on the map side.

A pre-token is a stretch of text that no merge of the vocabulary can leave, so the count of a text is the sum
over its pre-tokens. The counts of the frequent ones travel to every executor in one broadcast table of at
most ``TABLE_WORDS`` entries; a miss asks the worker's own cache of bounded size, and only a miss there runs
the library. No pre-token is ever shuffled: a task turns its texts into numbers.

The table only saves time. It is filled from the first rows of the first partitions (``SAMPLE_ROWS`` texts of a
partition, ``SAMPLE_WORDS`` entries in all), and a text whose words are not in it gets the same count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import worker_object

SPACE = "▁"
TABLE_WORDS = 32_768  # entries of the broadcast table
LONG_WORD = 64  # characters; longer pre-tokens are in no table and no cache
SAMPLE_ROWS = 256
SAMPLE_WORDS = 131_072  # rows that the driver may receive for the table
WORDS_EACH = 4_096  # of them from one partition
CACHE_BYTES = 48 << 20


class Counting:
    """Counts tokens as the library of a tokenizer file does; ``split`` and ``count`` work on pre-tokens."""

    def __init__(self, name: str, spec: bytes):
        self.cache: dict[str, int] = {}
        self.room = CACHE_BYTES
        self.by_word = False
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(spec.decode("utf-8"))
            library.no_truncation()
            library.no_padding()
            self.whole = lambda text: len(library.encode(text, add_special_tokens=False).ids)
            return
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        library = SentencePieceProcessor(model_proto=spec)
        self.whole = lambda text: len(library.encode(text, add_bos=False, add_eos=False))
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(spec)
        kinds = type(model.pieces[0])
        shown = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        norm, trainer = model.normalizer_spec, model.trainer_spec
        # A pre-token ends where no piece goes on: before a space mark, and before a line feed if that is alone.
        self.by_word = not (
            norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
            or trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2) or SPACE not in shown
            or any(p.type == kinds.USER_DEFINED for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in shown))
        self.prefix = norm.add_dummy_prefix
        alone = not any("\n" in p and len(p) > 1 for p in shown) and (trainer.byte_fallback or "\n" in shown)
        self.split = re.compile(" +[^ \n]*|\n+[^ \n]*|[^ \n]+" if alone else " +[^ ]*|[^ ]+").findall

    def words(self, text: str) -> list[str]:
        return self.split((" " if self.prefix else "") + text.replace(SPACE, " "))

    def exact(self, word: str) -> int:
        """Tokens of one pre-token, by the library; its own space mark before a text is taken off again."""
        if not self.prefix:
            return self.whole(word)
        return self.whole(word[1:]) if word[0] == " " and len(word) > 1 else 1 if word == " " else self.whole(word) - 1

    def count(self, text: str | None, frequent: dict[str, int]) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.whole(text)
        total, cache = 0, self.cache
        for word, n in Counter(self.words(text)).items():
            tokens = frequent.get(word)
            if tokens is None:
                tokens = cache.get(word)
                if tokens is None:
                    tokens = self.exact(word)
                    if len(word) <= LONG_WORD:
                        self.room -= 160 + 4 * len(word)  # a dictionary entry and its text, as an upper bound
                        if self.room < 0:
                            cache.clear()
                            self.room = CACHE_BYTES
                        cache[word] = tokens
            total += n * tokens
        return total


def counting(name: str, spec: bytes) -> Counting:
    return worker_object(("token_counts", name.rpartition(".")[2], zlib.crc32(spec), len(spec)), lambda: Counting(name, spec))


def frequent_words(texts: DataFrame, name: str, spec: bytes) -> list[tuple[str, int]]:
    """Frequent pre-tokens and their counts, from a bounded sample of the string column ``text``."""
    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, seen, rows = counting(name, spec), Counter(), 0
        for batch in batches:
            for text in batch["text"].iloc[:SAMPLE_ROWS - rows]:
                if text and mine.by_word:
                    seen.update(w for w in mine.words(text) if len(w) <= LONG_WORD)
            rows += len(batch)
            if rows >= SAMPLE_ROWS:
                break
        best = seen.most_common(WORDS_EACH)
        yield pd.DataFrame({"word": [w for w, _ in best], "n": [n for _, n in best]})

    if not counting(name, spec).by_word:
        return []
    found: Counter = Counter()
    for row in texts.select("text").mapInPandas(sample, "word string, n long").take(SAMPLE_WORDS):
        found[row.word] += row.n
    mine = counting(name, spec)
    return [(w, mine.exact(w)) for w, _ in found.most_common(TABLE_WORDS)]


def token_count(spark: SparkSession, tokenizer_file: str, text: Column, table: list[tuple[str, int]]) -> Column:
    """The number of tokens of a text column as a long; 0 for null."""
    spec = open(tokenizer_file, "rb").read()  # 0.5 to 1.7 MB, shipped with the function
    name = tokenizer_file.rpartition("/")[2]
    sent = spark.sparkContext.broadcast(table)  # at most TABLE_WORDS words of LONG_WORD characters

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        mine, frequent = counting(name, spec), dict(sent.value)
        for batch in texts:
            yield pd.Series([mine.count(t, frequent) for t in batch], dtype="int64")

    count.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has no byte and no token. Repeated rows and null ids keep their rows; columns other
    than the two are not read, whatever they are called. An empty table gives an empty one. A text of any
    length is counted whole; its pre-tokens are counted once a text. Tokenizers whose vocabulary has pieces across
    spaces, or that normalise texts, and all of the other library, count whole texts.
    """
    spec, name = open(tokenizer_file, "rb").read(), tokenizer_file.rpartition("/")[2]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = token_count(docs.sparkSession, tokenizer_file, F.col("text"), frequent_words(rows, name, spec))
    return (rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                        counted.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
