"""Toxic spans by a linear-chain conditional random field.

Words that mark toxic documents are found from the labelled rows; in toxic rows
they are the toxic tokens, everything else is clean. The field has one weight
per marking word and the transitions between both tags, fitted on windows of
labelled tokens. Forward-backward marginals give the spans, and a logistic
curve over a document's marginals gives its score.

The fit uses at most `max_rows` labelled documents (those of lowest hash) and
`max_windows` different windows with their numbers, so what reaches the driver is
bounded, and goes through them block by block; scoring reads every whole text. Runs of unmarked words longer than 2 * REACH are stepped over:
the messages have reached their fixed point there to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import fold, pair
from rowferry.llm.decontaminate import SEPARATORS
from rowferry.llm.flat import LOWER, pieces, prefix_hash, span_hash, tidy, word_spans

MAX_ROWS = 20_000
MAX_WINDOWS = 100_000
MAX_WORDS = 1024
LEAST_GAIN = 15.0
LEAST_DOCS = 3
WINDOW = 7
# windows that the fit holds unpacked at a time
FIT_BLOCK = 4096
REACH = 40


@dataclass
class Tagger:
    """Marking words (sorted hashes), their factors, transitions and the score's curve."""

    words: np.ndarray
    factors: np.ndarray  # of the toxic tag for each word; the last is that of other words
    moves: np.ndarray  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
    curve: np.ndarray

    def step(self, odds):
        cc, ct, tc, tt = self.moves
        return (odds * tt + ct) / (odds * tc + cc)

    def step_back(self, odds):
        cc, ct, tc, tt = self.moves
        return (odds * tt + tc) / (odds * ct + cc)

    def rest(self, step) -> float:
        """The fixed point of messages over other words."""
        odds = 0.0
        for _ in range(200):
            odds = step(odds * self.factors[-1])
        return odds


def numbered(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted words, or their number."""
    if not len(words):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, len(words))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the joined texts, and the text's bounds in words."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_spans(data, SEPARATORS)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hash(prefix_hash(data), starts, ends), starts, ends, np.searchsorted(starts, places)


def marginals(model: Tagger, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words near a marking word, and their marginals of the toxic tag.

    All stretches of all texts advance together, longest first.
    """
    hits = np.flatnonzero(ids < len(model.words))
    if not len(hits):
        return hits, np.zeros(0)
    text = np.searchsorted(bounds, hits, "right") - 1
    low = np.maximum(hits - REACH, bounds[text])
    high = np.minimum(hits + REACH + 1, bounds[text + 1])
    heads = np.r_[True, (low[1:] > high[:-1]) | (text[1:] != text[:-1])]
    firsts, lasts = low[heads], high[np.r_[heads[1:], True]]
    at_start, at_end = firsts == bounds[text[heads]], lasts == bounds[text[np.r_[heads[1:], True]] + 1]
    order = np.argsort(firsts - lasts, kind="stable")
    firsts, lasts, at_start, at_end = firsts[order], lasts[order], at_start[order], at_end[order]
    sizes = lasts - firsts
    offsets = np.cumsum(sizes) - sizes
    places = np.repeat(firsts - offsets, sizes) + np.arange(sizes.sum())
    factor = model.factors[ids[places]]
    longest, live = int(sizes[0]), np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "left")
    ahead, behind = np.zeros(len(places)), np.zeros(len(places))
    for backwards, out in ((False, ahead), (True, behind)):
        step = model.step_back if backwards else model.step
        edge = 1.0 if backwards else 0.0
        # before the first word the tag is clean; after the last one both are open
        message = np.where(at_end if backwards else at_start, edge if backwards else model.step(0.0), step(model.rest(step) * model.factors[-1]))
        for t in range(longest):
            k = live[t]
            spot = offsets[:k] + (sizes[:k] - 1 - t if backwards else t)
            out[spot] = message[:k]
            message = step(message[:k] * factor[spot])
    odds = ahead * behind * factor
    return places, odds / (1 + odds)


def figures(model: Tagger, texts: list[bytes]) -> tuple[np.ndarray, list]:
    """For each text: largest marginal, sum and share of marginals over 1/2; and its spans."""
    hashes, starts, ends, bounds = tokens(texts)
    places, chance = marginals(model, numbered(hashes, model.words), bounds)
    order = np.argsort(places)
    places, chance = places[order], chance[order]
    text = np.searchsorted(bounds, places, "right") - 1
    count = len(texts)
    most = np.zeros(count)
    np.maximum.at(most, text, chance)
    total = np.bincount(text, chance, count)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bad = chance >= 0.5
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    last = -2
    for place, owner, p in zip(places[bad], text[bad], chance[bad]):
        a, b = int(starts[place] - begin[owner]), int(ends[place] - begin[owner])
        if place == last + 1 and spans[owner]:
            a, _, q = spans[owner].pop()
            p = max(p, q)
        spans[owner].append((a, b, float(p)))
        last = place
    return np.stack([np.ones(count), most, np.log1p(total)], 1), spans


def windows(texts: list[bytes], toxic: list[int], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows around marking words, and the first words of each text: ids and tags."""
    hashes, _, _, bounds = tokens(texts)
    ids = numbered(hashes, words)
    hits = np.flatnonzero(ids < len(words))
    centers = np.unique(np.r_[hits, bounds[:-1][np.diff(bounds) > 0]])
    text = np.searchsorted(bounds, centers, "right") - 1
    at = centers[:, None] + np.arange(-WINDOW, WINDOW + 1)
    inside = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None])
    picked = np.where(inside, ids[np.clip(at, 0, max(len(ids) - 1, 0))], len(words)) if len(ids) else np.zeros((0, 2 * WINDOW + 1), np.int64)
    tags = (picked < len(words)) & (np.array(toxic)[text] == 1)[:, None]
    return picked, tags


def packed(ids: np.ndarray, tags: np.ndarray) -> pa.Array:
    """Each window as bytes: two for the place of a word, then one for each tag."""
    flat = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(ids.astype("<i2")).view(np.uint8), tags.astype(np.uint8)], axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (16 bits each) and tags of packed windows."""
    length = 2 * WINDOW + 1
    flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 3 * length)
    return np.ascontiguousarray(flat[:, : 2 * length]).view("<i2"), flat[:, 2 * length :].astype(bool)


def expected(ids: np.ndarray, number: np.ndarray, factor: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected toxic tags of each word, then moves, over windows that occur `number` times."""
    length = ids.shape[1]
    local = np.stack([np.ones(ids.shape), factor[ids]], 2)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = local[:, 0]
    for t in range(1, length):
        ahead[:, t] = (ahead[:, t - 1] / ahead[:, t - 1].sum(1, keepdims=True)) @ m * local[:, t]
    for t in range(length - 2, -1, -1):
        back = (behind[:, t + 1] * local[:, t + 1]) @ m.T
        behind[:, t] = back / back.sum(1, keepdims=True)
    both = ahead * behind
    chance = number[:, None] * both[..., 1] / both.sum(2)
    joint = ahead[:, :-1, :, None] * m * (local[:, 1:] * behind[:, 1:])[:, :, None, :]
    joint *= (number[:, None] / joint.sum((2, 3)))[..., None, None]
    return np.r_[np.bincount(ids.ravel(), chance.ravel(), len(factor)), joint.sum((0, 1)).ravel()]


def fit_field(ids: np.ndarray, tags: np.ndarray, size: int, number: np.ndarray | None = None, rounds: int = 150, rate: float = 0.15, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Factors and moves of greatest penalised likelihood, by Adam over all windows.

    A window counts `number` times, or once. Each round adds up blocks of
    windows, so their messages are never held for all of them.
    """
    theta = np.zeros(size + 1 + 4)
    theta[size] = -3.0
    if not len(ids):
        return np.exp(theta[: size + 1]), np.exp(theta[size + 1 :])
    number = np.ones(len(ids)) if number is None else number.astype(float)
    move = tags[:, :-1] * 2 + tags[:, 1:]
    each = lambda x: np.repeat(number, x.shape[1])
    seen = np.r_[np.bincount(ids.ravel(), each(ids) * tags.ravel(), size + 1), np.bincount(move.ravel(), each(move), 4)]
    total = number.sum()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        factor = np.exp(np.clip(theta[: size + 1], -30, 30))
        m = np.exp(np.clip(theta[size + 1 :], -30, 30)).reshape(2, 2)
        wanted = sum(expected(ids[a : a + FIT_BLOCK], number[a : a + FIT_BLOCK], factor, m) for a in range(0, len(ids), FIT_BLOCK))
        slope = (seen - wanted - ridge * theta * 0.1) / total
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    theta = np.clip(theta, -30, 30)
    return np.exp(theta[: size + 1]), np.exp(theta[size + 1 :])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 5.0 if len(y) and y.min() == 1 else -5.0
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS) -> Tagger:
    """Fits the tagger on labelled rows outside fold 0.

    Of several labels of a document the largest counts; null labels and ids are
    left out. Without a row of either class every score is under 1/2.
    """
    chosen = labels.select("doc_id", "toxic").filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != 0)
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows pairs of numbers
    sample = pair(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in pieces(batches):
            hashes, _, _, bounds = tokens(texts)
            flags = np.array(toxic.to_pylist(), np.int64)
            word_text = np.repeat(np.arange(len(texts)), np.diff(bounds))
            once = np.unique(np.stack([hashes.view(np.int64), word_text], 1), axis=0)
            words, place = np.unique(once[:, 0], return_inverse=True)
            bad = np.bincount(place, flags[once[:, 1]], len(words)).astype(np.int64)
            yield pa.record_batch([pa.array(words), pa.array(bad), pa.array(np.bincount(place, minlength=len(words)))], ["word", "bad", "n"])

    sizes = chosen.agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    bad, n = sizes["bad"] or 0, sizes["n"]
    if not 0 < bad < n:
        return Tagger(np.zeros(0, np.uint64), np.full(1, np.exp(-3.0)), np.ones(4), np.array([-5.0, 0, 0]))
    share = F.lit(bad / n)
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (F.col("n") * share)) + F.when(
        F.col("bad") < F.col("n"), (F.col("n") - F.col("bad")) * F.log((F.col("n") - F.col("bad")) / (F.col("n") * (1 - share)))
    ).otherwise(0.0))
    marked = sample.select("toxic", "text").mapInArrow(tidy(count), "word long, bad long, n long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n")
    ).filter((F.col("bad") >= LEAST_DOCS) & (F.col("bad") > 2 * F.col("n") * share)).withColumn("gain", gain).filter(
        F.col("gain") > LEAST_GAIN
    ).orderBy(F.desc("gain"), "word").limit(MAX_WORDS).select("word").toArrow()
    words = np.sort(marked["word"].to_numpy().astype(np.int64).view(np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in pieces(batches):
            ids, tags = windows(texts, toxic.to_pylist(), words)
            yield pa.record_batch([packed(ids, tags)], ["cut"])

    # equal windows meet before the bound, so it holds for different ones
    found = sample.mapInArrow(tidy(cut), "cut binary").groupBy("cut").agg(F.count("*").alias("n")).orderBy(F.xxhash64("cut"), "cut").limit(max_windows).toArrow()
    ids, tags = unpacked(found["cut"].to_pylist())
    model = Tagger(words, *fit_field(ids, tags, len(words), found["n"].to_numpy()), np.zeros(3))
    del found, ids, tags

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in pieces(batches):
            x, _ = figures(model, texts)
            yield pa.record_batch([toxic.cast(pa.int64()), pa.array(x[:, 1]), pa.array(x[:, 2])], ["toxic", "most", "total"])

    seen = sample.mapInArrow(tidy(measure), "toxic long, most double, total double").toArrow()
    x = np.stack([np.ones(len(seen)), seen["most"].to_numpy(), seen["total"].to_numpy()], 1)
    model.curve = fit_curve(x, seen["toxic"].to_numpy().astype(float))
    return model


SPANS = "array<struct<start:int,end:int,chance:double>>"


def score(docs: DataFrame, model: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and the toxic spans (bytes of the UTF-8 text) of every row.

    Null and empty texts get the score of a text without a marking word.
    """
    data = pair(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
        for keys, texts in pieces(batches):
            x, spans = figures(shared.value, texts)
            chance = 1 / (1 + np.exp(-np.clip(x @ shared.value.curve, -30, 30)))
            rows = [[{"start": a, "end": b, "chance": p} for a, b, p in s] for s in spans]
            yield pa.record_batch([keys, pa.array(chance), pa.array(rows, kind)], ["doc_id", "score", "spans"])

    return data.mapInArrow(tidy(run), f"doc_id {data.schema[0].dataType.simpleString()}, score double, spans {SPANS}")


def predict(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Learns outside fold 0 and scores every document: held_out, score, predicted, spans."""
    found = score(docs, train(docs, labels, folds))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def drop_toxic(docs: DataFrame, model: Tagger) -> DataFrame:
    """The documents with a score under 1/2, all their columns kept; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.record_batch([batch.column(place), batch.column(place)], ["id", "text"])
            keep = np.concatenate([figures(shared.value, texts)[0] @ shared.value.curve < 0 for _, texts in pieces(iter([only]))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
