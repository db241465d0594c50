"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (a function of seed and code point). A trigram's vector binds
the permuted vectors of its letters: ``roll(v1, 2) * roll(v2, 1) * v3``. A text's vector and a language's
prototype are sums (bundles) of trigram vectors; the language with the highest cosine wins. Vectors are
added, so partial prototypes of any partition of the corpus merge exactly, and their size does not depend
on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import worker_object

DIMENSIONS = 1024
SEED = 20240229
UNKNOWN = "und"
MAX_LANGUAGES = 1024  # prototypes travel to every task: at most this many vectors
PIECE = 1 << 19  # characters handled at once, so that a long text needs little memory
KNOWN_TRIGRAMS = 1 << 15  # trigram vectors that a worker keeps


class Profiler:
    """Trigram counts and bundled vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        codes = range(0x110000)
        self.lower = np.zeros(0x110000, "<u4")
        for c in codes:
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                self.lower[c] = ord(low) if len(low) == 1 else c
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((1 << 10, self.dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def _vectors(self, keys: np.ndarray) -> np.ndarray:
        """The trigram vectors of (at most KNOWN_TRIGRAMS) keys."""
        names = keys.tolist()
        missing = [k for k in names if k not in self.rows]
        if len(self.rows) + len(missing) > KNOWN_TRIGRAMS:
            self.forget()
            missing = names
        while len(self.rows) + len(missing) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        for k in missing:
            a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
            row = self.rows[k] = len(self.rows)
            self.table[row] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return self.table[[self.rows[k] for k in names]]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of lower-case letters and their counts; a run of other characters is one gap (0)."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts, carry = [], [], np.zeros(1, np.int64)
        for at in range(0, len(text), PIECE):
            raw = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
            codes = np.concatenate([carry, self.lower[raw].astype(np.int64)])
            if at + PIECE >= len(text):
                codes = np.append(codes, 0)
            keep = np.ones(len(codes), bool)
            keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
            codes = codes[keep]
            if len(codes) > 2:
                k, n = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
                keys.append(k)
                counts.append(n)
            carry = codes[-2:]
        return merged(keys, counts)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigram vectors, exact in doubles."""
        total = np.zeros(self.dimensions)
        for at in range(0, len(keys), 4096):
            n, vectors = counts[at:at + 4096], self._vectors(keys[at:at + 4096])
            kind = np.float32 if n.sum() < 1 << 24 else np.float64  # whole numbers below 2^24 add up exactly in float32
            total += n.astype(kind) @ vectors.astype(kind)
        return total


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def profiler(dimensions: int, seed: int) -> Profiler:
    return worker_object(("profiler", dimensions, seed), lambda: Profiler(dimensions, seed))


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Language -> prototype from all rows with text and language; rows without either teach nothing.

    A task sends one partial vector per language. More than MAX_LANGUAGES languages are refused.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = profiler(dimensions, seed)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list] = {}
        size = 0

        def settle() -> None:
            for lang, found in waiting.items():
                before = [sums[lang]] if lang in sums else []
                sums[lang] = merged([k for k, _ in before + found], [n for _, n in before + found])
            waiting.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                found = p.trigrams(text)
                waiting.setdefault(lang, []).append(found)
                size += len(found[0])
                if size > 1 << 21:
                    settle()
                    size = 0
        settle()
        for lang, found in sums.items():
            vector = np.zeros(dimensions)
            for at in range(0, len(found[0]), 4096):  # counts of a task fit into float32 only in parts
                part = p._vectors(found[0][at:at + 4096]).astype(np.float64)
                vector += found[1][at:at + 4096].astype(np.float64) @ part
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dimensions), "value": vector.astype(np.int64)})

    rows = (docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .filter("text is not null and lang is not null")
            .mapInPandas(partial, "lang string, dim int, value long")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
            .limit(MAX_LANGUAGES * dimensions + 1).collect())
    if len(rows) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    for row in rows:
        found.setdefault(row.lang, np.zeros(dimensions))[row.dim] = row.value
    return {lang: found[lang] for lang in sorted(found)}


def predictor(prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED):
    """A function text column -> struct (lang_pred string, score double).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learned. The score is the cosine, cut at 0; ties go to the language that sorts first.
    """
    names = list(prototypes)
    unit = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]).reshape(len(names), dimensions)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = profiler(dimensions, seed)
        for batch in texts:
            langs, scores = [], []
            for text in batch:
                keys, counts = p.trigrams(text)
                vector = p.bundle(keys, counts)
                norm = np.linalg.norm(vector)
                if not names or not len(keys) or not norm:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = unit @ vector / norm
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    predict.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: Column, name: str,
             dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` with the struct column ``name`` (lang_pred, score); all rows and columns stay."""
    return docs.withColumn(name, predictor(prototypes, dimensions, seed)(text))
