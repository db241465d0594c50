"""Flat token-id files with 64-bit document offsets, written in key order and memory-mapped for reading.

A shard is two files. ``.bin`` holds the ids of its documents one after another as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32). ``.idx`` holds a header of five 64-bit integers
(magic, version, bytes per id, documents, tokens), the document ids, a null flag per document and
documents + 1 offsets, all 64-bit integers. Shards follow each other in key order; the place of a shard in
the whole sequence is the prefix sum of the token counts in the manifest.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import fresh_folder, id_text, open_random, open_uri, shuffle_partitions, worker_object, written

MAGIC, VERSION, HEAD = 0x544B4C4D, 1, 5
CACHE_WORDS = 1_000_000  # a worker forgets its cached words beyond this number
BLOCK_DOCS = 2048  # documents per unit of reading
# The splitting pattern of byte-level vocabularies (fixed by the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordEncoder:
    """Encodes whole texts with a tokenizer of the ``tokenizers`` library, each distinct word once.

    A single space between two characters that are no white space always begins a new piece of a
    byte-level pattern, so the ids of a text are the ids of its space-separated words, which are cached.
    Texts with other spacing, characters beyond the scripts below or special tokens, and tokenizers of
    other kinds, are passed to ``encode`` whole.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        kind = json.loads(spec)
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = (
            kind.get("model", {}).get("type") == "BPE" and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not kind.get("normalizer")
            and not kind["model"].get("dropout") and not kind["model"].get("ignore_merges"))
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.whole.model.tokenize
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.pieces = regex.compile(PATTERN).findall
        # visible characters below U+0530, and line feeds inside the word
        self.plain = regex.compile("[!-~¡-¬®-ԯ](?:[\n!-~¡-¬®-ԯ]*[!-~¡-¬®-ԯ])?").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes | None] = {}
        self.first: dict[str, bytes | None] = {}
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            mapped = piece.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()
            self.known[piece] = ids
        return ids

    def _learn(self, cache: dict, word: str, lead: str) -> bytes | None:
        stem = word.rstrip(".,")
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0530"):  # letters are one piece, the marks after them another
            ids = self._piece(lead + stem)
            if len(stem) < len(word):
                ids += self._piece(word[len(stem):])
        elif not self.plain(word) or any(s in word for s in self.special):
            ids = None
        else:
            ids = b"".join([self._piece(p) for p in self.pieces(lead + word)])
        cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian integers."""
        if not text:
            return b""
        if self.by_word:
            head, *rest = text.split(" ")
            words = self.words
            try:
                parts = [words[w] for w in rest]
            except KeyError:
                if len(words) + len(self.known) > CACHE_WORDS:
                    for cache in (words, self.first, self.known):
                        cache.clear()
                parts = [words[w] if w in words else self._learn(words, w, " ") for w in rest]
            begin = self.first[head] if head in self.first else self._learn(self.first, head, "")
            if begin is not None and None not in parts:
                return begin + b"".join(parts)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def word_encoder(spec: str) -> WordEncoder:
    """The worker's encoder for this tokenizer, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_object(("encoder", zlib.crc32(spec.encode()), len(spec)), lambda: WordEncoder(spec))


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and write shards in ascending key order; returns the manifest table.

    Null texts count as empty; a null key sorts first; rows with equal keys are ordered by their text.
    Every row is a document of its own, so repeated rows are written as often as they occur. An empty
    table gives an empty manifest. A task names its files anew at each attempt, and only the files in the
    committed manifest are read, so lost executors leave nothing but unused files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    spec = open(tokenizer_file, encoding="utf-8").read()  # about 1.5 MB, shipped with the function
    tie = F.xxhash64("text")
    ranged = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
        .select(id_text(F.col("doc_id")).alias("doc_id"), "text"))

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyspark import TaskContext

        encoder = word_encoder(spec)
        dtype = encoder.dtype if end_id < 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
        keys, nulls, sizes, out = [], [], [], None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                fs, path = open_uri(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path + ".bin")
            for text in batch["text"]:
                ids = encoder.encode(text)
                if dtype != encoder.dtype:
                    ids = np.frombuffer(ids, encoder.dtype).astype(dtype).tobytes()
                out.write(ids + end)
                sizes.append(len(ids) // dtype.itemsize + 1)
            nulls.append(batch["doc_id"].isna().to_numpy())
            keys.append(np.array([int(k) for k in batch["doc_id"].fillna("0")], "<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype="<i8")]).astype("<i8")
        head = np.array([MAGIC, VERSION, dtype.itemsize, len(sizes), offsets[-1]], "<i8")
        with fs.open_output_stream(path + ".idx") as index:
            for block in (head, np.concatenate(keys), np.concatenate(nulls).astype("<i8"), offsets):
                index.write(block.tobytes())
        yield pd.DataFrame({"part": [part], "path": [name], "n_docs": [len(sizes)], "n_tokens": [int(offsets[-1])]})

    return written(ranged.mapInPandas(shard, "part int, path string, n_docs long, n_tokens long"), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with the place of each shard's first token: one row per shard, so a single window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def read_documents(path: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, null flags, offsets and tokens of the documents ``first`` to ``last`` (exclusive) of a shard."""
    with open_random(path + ".idx") as index:
        magic, version, width, docs, _ = np.frombuffer(index.read_at(8 * HEAD, 0), "<i8")
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path}.idx is no token index")
        part = lambda begin, n: np.frombuffer(index.read_at(8 * n, 8 * int(begin)), "<i8")
        n = last - first
        keys, nulls = part(HEAD + first, n), part(HEAD + docs + first, n)
        offsets = part(HEAD + 2 * docs + first, n + 1)
    with open_random(path + ".bin") as ids:
        at, size = int(offsets[0] * width), int((offsets[-1] - offsets[0]) * width)
        tokens = np.frombuffer(ids.read_at(size, at), f"<u{width}")
    return keys, nulls, offsets, tokens


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, and nothing of the input."""
    spark = manifest.sparkSession
    units = with_bases(manifest).select(
        "part", "path", "n_docs", "base",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(BLOCK_DOCS).cast("bigint"))).alias("first"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys, nulls, offsets, tokens = read_documents(row.path, row.first, min(row.n_docs, row.first + BLOCK_DOCS))
                at = offsets - offsets[0]
                wide = tokens.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pd.DataFrame({
                    "doc_id": pd.array(keys, "Int64").copy() if not nulls.any() else pd.array(
                        [None if z else int(k) for k, z in zip(keys, nulls)], "Int64"),
                    "start": row.base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": crcs,
                    "shard": np.full(len(keys), row.part)})

    return units.repartition(shuffle_partitions(spark), "path", "first").mapInPandas(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
