"""Language-model scores by context-tree weighting over bytes, beside a smoothed word model.

A text is its UTF-8 bytes and an end symbol (0xFF). Every byte is eight binary decisions; in every context of
0 to DEPTH preceding bytes each decision has a Krichevsky-Trofimov estimate, and the context tree mixes the
estimates of all depths, each depth weighted by how well it coded the training texts. Counts of all nodes
follow from the counts of the (DEPTH + 1)-byte grams, which are summed over the corpus.

Documents are dealt into chunks once. A chunk sends each of its distinct words and grams once, with its
training count; they meet their corpus-wide count or probability in a join and come back to the chunk, so
neither the vocabulary nor the tree has to fit into one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh_folder, id_text, shuffle_partitions, whole_groups, worker_store, written

DEPTH = 3
END = 0xFF
CHUNK_CHARS = 12_000_000  # a chunk is closed beyond this many characters
PIECE = 1 << 20
TABLED = 1 << 16


def grams(text: bytes, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (depth context bytes, then the byte) of a text with its end symbol, and their counts.

    Zero bytes stand before the text. The most distant byte is the highest.
    """
    keys, counts = [], []
    raw = np.frombuffer(bytes(depth) + text + bytes([END]), np.uint8)
    for at in range(0, len(raw) - depth, PIECE):
        part = raw[at:at + PIECE + depth].astype(np.int64)
        key = np.zeros(len(part) - depth, np.int64)
        for i in range(depth + 1):
            key = key << 8 | part[i:len(part) - depth + i]
        k, n = np.unique(key, return_counts=True)
        keys.append(k)
        counts.append(n)
    return summed(keys, counts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def words_of(text: bytes) -> list[bytes]:
    """Words of lower-cased (A-Z) text, cut at ASCII white space."""
    return text.lower().split()


# ---- the tree ------------------------------------------------------------------------------------------

def log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """lgamma(n + plus) of counts, from a table below TABLED."""
    store, key = worker_store(), ("lgamma", plus)
    if key not in store:
        store[key] = np.array([math.lgamma(i + plus) for i in range(TABLED)])
    n = n.astype(np.int64)
    out = store[key][np.minimum(n, TABLED - 1)]
    for at in zip(*np.nonzero(n >= TABLED)):
        out[at] = math.lgamma(int(n[at]) + plus)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of so many zeros and ones."""
    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def node_counts(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 255) zeros and ones of the binary decisions, from (rows, 256) byte counts; node 2^b - 1 + prefix."""
    zeros, ones = [], []
    for b in range(8):
        split = histogram.reshape(len(histogram), 1 << b, 2, -1).sum(-1)
        zeros.append(split[:, :, 0])
        ones.append(split[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def histograms(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts and their (contexts, 256) byte counts."""
    u, at = np.unique(context, return_inverse=True)
    return u, np.bincount(at * 256 + byte, n, len(u) * 256).reshape(len(u), 256)


HALF = math.log(0.5)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of nodes (below: summed over their children; None at the leaves) and the weight of stopping."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones_like(own)
    whole = np.logaddexp(HALF + own, HALF + below)
    return whole, np.exp(HALF + own - whole)


def subtree(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[tuple]:
    """Levels ``depth`` down to ``top`` of grams that share their nearest ``top`` bytes.

    Each level: (contexts, zeros, ones, stopping weight, log probability), by the nearest ``level`` bytes.
    """
    levels, below, under = [], None, None
    for d in range(depth, top - 1, -1):
        contexts, hist = histograms((key >> 8) & ((1 << 8 * d) - 1), key & 255, n)
        zeros, ones = node_counts(hist)
        if below is not None:
            at = np.searchsorted(contexts, under & ((1 << 8 * d) - 1))
            gathered = np.zeros(zeros.shape)
            np.add.at(gathered, at, below)
            below = gathered
        below, weight = weighted(zeros, ones, below)
        levels.append((contexts, zeros, ones, weight, below))
        under = contexts
    return levels


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 8) node numbers and bits of bytes."""
    nodes = np.stack([(1 << b) - 1 + (byte >> (8 - b)) for b in range(8)], 1)
    return nodes, np.stack([(byte >> (7 - b)) & 1 for b in range(8)], 1)


def mixed(probability: np.ndarray | None, level: tuple, row: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The decisions' probabilities at one depth, mixing in those of the depth below."""
    _, zeros, ones, weight, _ = level
    z, o = zeros[row[:, None], nodes], ones[row[:, None], nodes]
    own = (np.where(bits == 1, o, z) + 0.5) / (z + o + 1)
    if probability is None:
        return own
    w = weight[row[:, None], nodes]
    return w * own + (1 - w) * probability


def gram_scores(key: np.ndarray, n: np.ndarray, depth: int, top: int, upper: list[tuple]) -> np.ndarray:
    """log10 probability of each gram's last byte; ``upper``: the levels top - 1 to 0 of the whole tree."""
    nodes, bits = decisions(key & 255)
    p = None
    for d, level in zip(range(depth, -1, -1), subtree(key, n, depth, top) + upper):
        row = np.searchsorted(level[0], (key >> 8) & ((1 << 8 * d) - 1))
        p = mixed(p, level, row, nodes, bits)
    return np.log10(p).sum(1)


def upper_levels(by_nearest: pd.DataFrame, below: pd.DataFrame) -> list[tuple]:
    """Levels 1 and 0 of the tree: from byte counts by nearest byte and the summed log probabilities of level 2.

    At most 256 x 256 and 256 x 255 rows, however large the corpus is.
    """
    key = by_nearest["nearest"].to_numpy(np.int64) << 8 | by_nearest["byte"].to_numpy(np.int64)
    contexts, hist = histograms(key >> 8, key & 255, by_nearest["n"].to_numpy(np.float64))
    zeros, ones = node_counts(hist)
    sums = np.zeros(zeros.shape)
    np.add.at(sums, (np.searchsorted(contexts, below["nearest"].to_numpy()), below["node"].to_numpy()), below["logp"].to_numpy())
    whole, weight = weighted(zeros, ones, sums)
    zeros0, ones0 = node_counts(hist.sum(0, keepdims=True))
    whole0, weight0 = weighted(zeros0, ones0, whole.sum(0, keepdims=True))
    return [(contexts, zeros, ones, weight, whole), (np.zeros(1, np.int64), zeros0, ones0, weight0, whole0)]


def learn_tree(gram_counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10p) of all grams (gram, n), n being the training count (0 for grams seen elsewhere only).

    Grams with the same two nearest bytes form a group (at most 256^(depth - 1) rows): their part of the tree
    is theirs alone. Only the two top levels are put together on the driver, of bounded size.
    """
    nearest = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    keyed = (gram_counts.withColumn("nearest", nearest)
             .repartition(shuffle_partitions(gram_counts.sparkSession), "nearest").sortWithinPartitions("nearest"))

    def level_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["nearest"]):
            contexts, *_, logp = subtree(rows["gram"].to_numpy(), rows["n"].to_numpy(np.float64), depth, 2)[-1]
            at, node = np.nonzero(logp)
            yield pd.DataFrame({"nearest": contexts[at] & 255, "node": node, "logp": logp[at, node]})

    below = (keyed.mapInPandas(level_two, "nearest int, node int, logp double")
             .groupBy("nearest", "node").agg(F.sum("logp").alias("logp")).toPandas())
    by_nearest = (gram_counts.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFF).alias("nearest"), F.col("gram").bitwiseAND(0xFF).alias("byte"))
                  .agg(F.sum("n").alias("n")).toPandas())
    if not len(by_nearest):
        return gram_counts.select("gram", F.lit(0.0).alias("log10p"))
    upper = upper_levels(by_nearest, below)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["nearest"]):
            key = rows["gram"].to_numpy()
            yield pd.DataFrame({"gram": key, "log10p": gram_scores(key, rows["n"].to_numpy(np.float64), depth, 2, upper)})

    return keyed.mapInPandas(score, "gram long, log10p double")


# ---- documents -----------------------------------------------------------------------------------------

def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    The models learn from the rows where ``held_out`` is false. A null or empty text has one token and one
    symbol, the end. Repeated rows count and are scored as often as they occur. With no training row the base
    score is that of an empty vocabulary, (0.5 / 0.5) a token, and the tree gives every bit one half. Depth
    is 2 at least and 6 at most.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    folder = fresh_folder(spark, "lm")
    schema = ("kind string, chunk long, word binary, gram long, n long, doc_id string, held_out boolean, text string")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        class Chunk:
            def __init__(self, number: int):
                self.name, self.size = TaskContext.get().partitionId() << 32 | number, 0
                self.train, self.other = Counter(), set()
                self.grams = {False: ([], []), True: ([], [])}
                self.waiting = 0

            def settle(self):
                for k, (keys, counts) in self.grams.items():
                    if keys:
                        a, b = summed(keys, counts)
                        self.grams[k] = ([a], [b])
                self.waiting = 0

            def add(self, text: bytes, out: bool):
                (self.other if out else self.train).update(words_of(text))
                keys, counts = self.grams[out]
                k, n = grams(text, depth)
                keys.append(k)
                counts.append(n)
                self.waiting += len(k)
                self.size += len(text)
                if self.waiting > 1 << 20:
                    self.settle()

            def named(self, kind: str, rows: int, **values) -> pd.DataFrame:
                own = {"kind": np.full(rows, kind, object), "chunk": np.full(rows, self.name, np.int64)}
                return pd.DataFrame(own | values).reindex(columns=columns).astype({"word": object, "doc_id": object, "text": object})

            def rows(self):
                self.settle()
                unseen = [w for w in self.other if w not in self.train]
                words = list(self.train) + unseen
                yield self.named("word", len(words), word=pd.Series(words, dtype=object), n=list(self.train.values()) + [0] * len(unseen))
                (k, n), (k0, _) = (tuple(x[0] if x else np.empty(0, np.int64) for x in self.grams[o]) for o in (False, True))
                extra = np.setdiff1d(k0, k)
                yield self.named("gram", len(k) + len(extra), gram=np.concatenate([k, extra]), n=np.concatenate([n, np.zeros(len(extra), np.int64)]))

        columns = ["kind", "chunk", "word", "gram", "n", "doc_id", "held_out", "text"]
        number = 0
        chunk = Chunk(number)
        for batch in batches:
            begin = 0
            for i, (text, out) in enumerate(zip(batch["text"], batch["held_out"])):
                chunk.add(text.encode("utf-8", "surrogatepass"), bool(out))
                if chunk.size > CHUNK_CHARS or i + 1 == len(batch):
                    part = batch.iloc[begin:i + 1].reset_index(drop=True)
                    yield chunk.named("doc", len(part), **{c: part[c].astype(object) for c in ("doc_id", "held_out", "text")})
                    begin = i + 1
                if chunk.size > CHUNK_CHARS:
                    yield from chunk.rows()
                    number += 1
                    chunk = Chunk(number)
        yield from chunk.rows()

    slim = docs.select(id_text(F.col(id_col)).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim.mapInPandas(deal, schema).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    dealt = lambda kind, *columns: spark.read.schema(schema).parquet(folder).filter(F.col("kind") == kind).select(*columns)
    texts = dealt("doc", "chunk", "doc_id", "held_out", "text")
    words, grams_ = dealt("word", "chunk", "word", "n"), dealt("gram", "chunk", "gram", "n")

    vocabulary = written(words.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    distinct, running = vocabulary.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = texts.filter("not held_out").count()
    total, kinds = running + ends, distinct + (ends > 0)
    scored = learn_tree(grams_.groupBy("gram").agg(F.sum("n").alias("n")), depth)
    # what comes back to a chunk: the corpus count of a word, the log probability of a gram
    known = (words.select("chunk", "word").join(vocabulary, "word")
             .select("chunk", "word", F.lit(None).cast("bigint").alias("gram"), F.col("n").cast("double").alias("value"))
             .unionByName(grams_.select("chunk", "gram").join(scored, "gram")
                          .select("chunk", F.lit(None).cast("binary").alias("word"), "gram", F.col("log10p").alias("value"))))

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        is_word = known["word"].notna().to_numpy()
        counts = dict(zip(known["word"][is_word], known["value"][is_word]))
        key, value = known["gram"][~is_word].to_numpy(np.int64), known["value"][~is_word].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        norm = math.log10(total + 0.5 * (kinds + 1))
        out = []
        for text in texts["text"]:
            raw = text.encode("utf-8", "surrogatepass")
            c = np.array([counts[w] for w in words_of(raw)] + [ends], np.float64)
            k, n = grams(raw, depth)
            tree = float((value[np.searchsorted(key, k)] * n).sum())
            out.append((len(c), int((c > 0).sum()), float(np.log10(c + 0.5).sum() - len(c) * norm), tree, len(raw)))
        a = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score", "n_bytes"])
        return pd.concat([texts[["doc_id", "held_out"]].reset_index(drop=True), a], axis=1)

    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    ).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("train_tokens", F.lit(total).cast("bigint"))
