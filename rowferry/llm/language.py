"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of the most frequent n-grams (one to three letters, words
padded by a blank) of a language or a document, by falling frequency. The
distance is the sum over the document's n-grams of how far they are out of
place in the language's profile; an n-gram that is missing there counts as the
length of a profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.columns import fold
from rowferry.llm.flat import pieces

PROFILE = 300
BLOCK = 1 << 20
HELD_GRAMS = 500_000
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a letter), and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for first in range(0, len(codes), BLOCK):
        # blocks overlap by a letter on either side: n-grams go with their middle
        block = codes[max(0, first - 1) : first + BLOCK + 1]
        block = np.where(letters()[block], block, 0).astype(np.int64)
        if first == 0:
            block = np.r_[0, block]
        if first + BLOCK >= len(codes):
            block = np.r_[block, 0, 0]
        a, b, c = block[:-2], block[1:-1], block[2:]
        one = b[b > 0]
        pair = (a > 0) | (b > 0)
        triple = (b > 0)
        keys = np.concatenate([one, (a | b << 21)[pair] | 1 << 62, (a | b << 21 | c << 42)[triple]])
        found.append(np.unique(keys, return_counts=True))
    return found[0] if len(found) == 1 else merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order; ties by the key."""
    return keys[np.lexsort((keys, -counts))[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language of all rows with text and language.

    Counts are summed in each task first; the driver gets `size` n-grams of each
    language. Languages are few by their nature; rows of any size do not matter.
    """
    data = docs.select(docs[lang].alias("lang"), docs[text].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            keys, counts = merged(held.pop(name))
            sizes.pop(name)
            return pa.record_batch([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for names, texts in pieces(batches):
            for name, data_ in zip(names.to_pylist(), texts):
                part = grams(data_.decode())
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + len(part[0])
                if sizes[name] > HELD_GRAMS:
                    held[name] = [merged(held[name])]
                    sizes[name] = len(held[name][0][0])
                    if sizes[name] > HELD_GRAMS // 2:
                        yield flush(name)
        for name in list(held):
            yield flush(name)

    counts = data.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    out: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Profiles:
    """Ranks of all known n-grams in all languages."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, profiles[name]), column] = np.arange(len(profiles[name]))

    def nearest(self, text: str) -> tuple[str, float]:
        """The language of least distance (ties: the first by name) and a score."""
        keys, counts = grams(text)
        if not len(keys) or keys[0] >= 1 << 62 or not self.names:
            return UNKNOWN, 0.0
        mine = top(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == mine)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine))[:, None])).sum(0)
        near = 1 - apart / (self.size * len(mine))
        best = int(np.argmin(apart))
        total = near.sum()
        return self.names[best], float(near[best] / total) if total > 0 else 1 / len(self.names)


def identify(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the share of the best language in all nearness).

    `und` and 0 for a null text, a text without letters, or without profiles.
    """
    data = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value)
        for keys, texts in pieces(batches):
            found = [known.nearest(t.decode()) for t in texts]
            yield pa.record_batch([keys, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return data.mapInArrow(run, f"doc_id {data.schema[0].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows outside fold 0 and predicts every row; held_out marks fold 0."""
    profiles = learn(docs.filter(fold(docs["doc_id"], folds) != 0))
    found = identify(docs, profiles)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
