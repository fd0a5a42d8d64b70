"""Language-model scores from quantised n-gram counts in a Bloom filter.

Bigrams of all training texts are counted exactly, dealt out by their first
word. Each part then enters what it has counted into its own slice of the
filter: a count c on a logarithmic scale, as one key per level, so that probing
the levels in turn gives back the quantised count. The filter holds all bigrams,
from level 1 for those met once, and the number of bigrams of each history.

Probabilities are smoothed by that number:
    p(w | h) = (c(h, w) + T(h) * p(w)) / (C(h) + T(h))
with C the exact count of h, T the number of its distinct bigrams, and p(w) the
additively smoothed share of w. Exact word counts do not fit into
a broadcast: blocks of documents send their distinct words to the parts that
counted them and get the counts back.

Slices go to the workers in waves of at most `wave_bytes`, so a broadcast never
grows with the corpus; a token is scored in the wave of its history's slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import fold
from rowferry.llm.flat import mix, pieces, planes, unplanes, word_hashes
from rowferry.llm.shared import Workspace

BEGIN = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
GROWTH = 1.5
BITS = 14
PROBES = 4
SMOOTH = 0.1
FLUSH = 2_000_000
# tokens that are probed at once
STEP = 200_000
WAVE_BYTES = 64 << 20
CUT = np.uint64((1 << 40) - 1)
TYPES = np.uint64(0x452821E638D01377)


def chains(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and token of every position, and the bounds of each text; the end is a token."""
    words, bounds = word_hashes(texts)
    last = bounds[1:]
    token = np.insert(words, last, END)
    history = np.insert(words, bounds[:-1], BEGIN)
    return history, token, bounds + np.arange(len(bounds))


def quantise(counts: np.ndarray) -> np.ndarray:
    """Level of each count, from 1 on."""
    return (np.log(counts) / np.log(GROWTH) + 1e-9).astype(np.int64) + 1


def restored(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's whole counts, so 1 for level 1; 0 for level 0."""
    return np.where(levels > 0, (np.ceil(GROWTH ** (levels - 1.0)) + np.ceil(GROWTH**levels) - 1) / 2, 0.0)


def spots(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of (key, level) in a slice of `size` bits."""
    value = mix(keys + mix(np.asarray(level, np.uint64) + np.uint64(77)))
    second = mix(value) | np.uint64(1)
    for k in range(PROBES):
        yield ((value + np.uint64(k) * second) % np.asarray(size, np.uint64)).astype(np.int64)


def build_slice(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A slice's bits, packed, with all levels up to each key's own."""
    each, upto = np.repeat(keys, levels), np.cumsum(levels)
    level = np.arange(len(each)) - np.repeat(upto - levels, levels) + 1
    size = max(64, -(-len(each) * BITS // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for at in spots(each, level, size):
        bits[at] = 1
    return np.packbits(bits, bitorder="little")


class Slices:
    """The slices of one wave in one array."""

    def __init__(self, rows: dict[int, bytes], parts: int) -> None:
        self.parts = parts
        self.begin, self.size = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        bodies, at = [], 0
        for part, body in rows.items():
            self.begin[part], self.size[part] = at, len(body) * 8
            bodies.append(body)
            at += len(body) * 8
        self.bits = np.frombuffer(b"".join(bodies), np.uint8)

    def levels(self, history: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Quantised count of each key, by probing one level after the other."""
        out = np.zeros(len(keys), np.int64)
        part = (history % np.uint64(self.parts)).astype(np.int64)
        begin, size, left, level = self.begin[part], np.maximum(self.size[part], 1), np.flatnonzero(self.size[part] > 0), 1
        while len(left):
            hit = np.ones(len(left), bool)
            for at in spots(keys[left], level, size[left]):
                spot = at + begin[left]
                hit &= self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0
            left = left[hit]
            out[left] = level
            level += 1
        return out


def pair_key(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0x9E3779B97F4A7C15) + (token & CUT))


def _counts(data: DataFrame, parts: int) -> DataFrame:
    """Packed bigram counts of each task: part, histories, successors of each, tokens, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            history = np.concatenate([h for h, _ in held])
            token = np.concatenate([t for _, t in held]) & CUT
            part = history % np.uint64(parts)
            order = np.lexsort((token, history, part))
            history, token, part = history[order], token[order], part[order]
            heads = np.flatnonzero(np.r_[True, (history[1:] != history[:-1]) | (token[1:] != token[:-1])])
            counts = np.diff(np.r_[heads, len(history)])
            history, token, part = history[heads], token[heads], part[heads]
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                firsts = np.flatnonzero(np.r_[True, history[a + 1 : b] != history[a : b - 1]])
                rows.append((int(part[a]), planes(history[a:b][firsts], 8), planes(np.diff(np.r_[firsts, b - a]), 4), planes(token[a:b], 5), planes(counts[a:b], 4)))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], ["part", "histories", "each", "tokens", "counts"])

        for _, texts in pieces(batches):
            history, token, _ = chains(texts)
            held.append((history, token))
            size += len(token)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return data.mapInArrow(run, "part int, histories binary, each binary, tokens binary, counts binary")


def _learn(packed: DataFrame) -> DataFrame:
    """One row per part: exact word counts and the slice of the filter."""

    def work(table: pa.Table) -> pa.Table:
        history, token, counts = [], [], []
        for row in table.select(["histories", "each", "tokens", "counts"]).to_pylist():
            history.append(np.repeat(unplanes(row["histories"], 8), unplanes(row["each"], 4).astype(np.int64)))
            token.append(unplanes(row["tokens"], 5))
            counts.append(unplanes(row["counts"], 4).astype(np.int64))
        h, t, c = np.concatenate(history), np.concatenate(token), np.concatenate(counts)
        order = np.lexsort((t, h))
        h, t, c = h[order], t[order], c[order]
        heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
        c = np.add.reduceat(c, heads)
        h, t = h[heads], t[heads]
        firsts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        words, total = h[firsts], np.add.reduceat(c, firsts)
        types = np.diff(np.r_[firsts, len(h)])
        keys, levels = np.concatenate([pair_key(h, t), words ^ TYPES]), quantise(np.concatenate([c, types]))
        return pa.table({
            "part": pa.array([table["part"][0].as_py()], pa.int32()), "words": pa.array([planes(words, 8)], pa.binary()),
            "totals": pa.array([planes(total, 8)], pa.binary()), "bits": pa.array([build_slice(keys, levels).tobytes()], pa.binary()),
            "n_tokens": pa.array([int(total.sum())], pa.int64()), "n_words": pa.array([len(words)], pa.int64()),
        })

    return packed.groupBy("part").applyInArrow(work, "part int, words binary, totals binary, bits binary, n_tokens long, n_words long")


def _vocabulary(texts: list[bytes]) -> np.ndarray:
    """Distinct tokens, and the begin that stands for the end's count."""
    held = [np.array([BEGIN, END])]
    for _, some in pieces(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["i", "t"])])):
        held.append(np.unique(word_hashes(some)[0]))
    return np.unique(np.concatenate(held))


def score(docs: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Scores of every row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `train` holds (default: all). Null and
    empty texts consist of the end alone; equal rows are counted and scored each.
    Without training texts every probability is that of an unseen word.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * blocks
    data = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), *([train.alias("train")] if train is not None else []))
    learning = data.filter("train") if train is not None else data
    model = space.keep(_learn(_counts(learning.select("doc_id", "text"), parts)), "model")
    sizes = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v"), F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bits")).first()
    # histories are all words and the begin, tokens all words and the end: as many
    total, distinct, waves = sizes["n"], sizes["v"], max(1, -(-sizes["bits"] // wave_bytes))

    rows = data.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def ask(table: pa.Table) -> pa.Table:
        words = _vocabulary(table["text"].cast(pa.binary()).to_pylist())
        part = words % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        words, part = words[order], part[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        return pa.table({
            "part": pa.array([int(part[a]) for a in cuts[:-1]], pa.int32()), "block": pa.array([table["block"][0].as_py()] * (len(cuts) - 1), pa.int32()),
            "words": pa.array([planes(words[a:b], 8) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x, 8) for x in known["words"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x, 8) for x in known["totals"].to_pylist())])
        out = []
        for body in asked["words"].to_pylist():
            wanted = unplanes(body, 8)
            at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
            found = np.where(words[at] == wanted, counts[at], 0) if len(words) else np.zeros(len(wanted), np.uint64)
            out.append(planes(found, 8))
        return pa.table({"part": asked["part"], "block": asked["block"], "counts": pa.array(out, pa.binary())})

    requests = rows.groupBy("block").applyInArrow(ask, "part int, block int, words binary")
    known = model.select("part", "words", "totals")
    answers = requests.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "part int, block int, counts binary")

    shared = []
    for wave in range(waves):
        slices = {r["part"]: bytes(r["bits"]) for r in model.filter(F.col("part") % waves == wave).select("part", "bits").toLocalIterator()}
        shared.append(spark.sparkContext.broadcast(slices))
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(shared, parts, total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return found.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scorer(shared: list, parts: int, total: int, distinct: int):
    """The function that scores a block with the counts of its words.

    The texts are cut into tokens once; the tokens are sorted by the wave that
    holds their history, also of histories that learned nothing. The waves are
    gone through one after the other, each loaded, probed and dropped, so the
    work grows with the tokens and memory holds one wave at a time.
    """
    waves = len(shared)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        bodies = table["text"].cast(pa.binary()).to_pylist()
        words = _vocabulary(bodies)
        part = (words % np.uint64(parts)).astype(np.int64)
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(part, kind="stable")
        got = {r["part"]: r["counts"] for r in answers.select(["part", "counts"]).to_pylist()}
        for p in np.unique(part):
            counts[order[np.searchsorted(part[order], p) : np.searchsorted(part[order], p, "right")]] = unplanes(got[int(p)], 8).astype(np.int64)
        counts[np.searchsorted(words, END)] = counts[np.searchsorted(words, BEGIN)]
        floor = total + SMOOTH * (distinct + 1)
        names = ["n_tokens", "n_known", "base_score"]
        out: dict[str, list] = {n: [] for n in names}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = 0
        rows = pa.record_batch([pa.array(range(len(bodies))), pa.array(bodies, pa.binary())], ["i", "t"])
        for _, texts in pieces(iter([rows])):
            history, token, bounds = chains(texts)
            h, t = np.searchsorted(words, history).astype(np.int32), np.searchsorted(words, token).astype(np.int32)
            sizes = np.diff(bounds)
            held.append((h, t, np.repeat(np.arange(done, done + len(texts), dtype=np.int32), sizes)))
            done += len(texts)
            out["n_tokens"].append(sizes)
            out["n_known"].append(np.add.reduceat((counts[t] > 0).astype(np.int64), bounds[:-1]))
            out["base_score"].append(np.add.reduceat(np.log10((counts[t] + SMOOTH) / floor), bounds[:-1]))
        if not bodies:
            return pa.table({"doc_id": table["doc_id"], **{n: pa.array([], pa.int64() if n[0] == "n" else pa.float64()) for n in (*names, "score")}})
        h, t, doc = (np.concatenate(x) for x in zip(*held))
        wave_of = part % waves
        order = np.argsort(wave_of[h].astype(np.int32), kind="stable").astype(np.int32)
        cuts = np.r_[0, np.cumsum(np.bincount(wave_of[h], minlength=waves))]
        score, types = np.zeros(len(bodies)), np.zeros(len(words))
        for wave in range(waves):
            slices = Slices(shared[wave].value, parts)
            mine = np.flatnonzero((wave_of == wave) & (counts > 0))
            types[mine] = np.minimum(restored(slices.levels(words[mine], words[mine] ^ TYPES)), counts[mine])
            for a in range(int(cuts[wave]), int(cuts[wave + 1]), STEP):
                at = order[a : min(a + STEP, int(cuts[wave + 1]))]
                x, y = h[at], t[at]
                share = (counts[y] + SMOOTH) / floor
                levels = np.zeros(len(at), np.int64)
                may = np.flatnonzero((types[x] > 0) & (counts[y] > 0))
                levels[may] = slices.levels(words[x[may]], pair_key(words[x[may]], words[y[may]]))
                seen = counts[x] + types[x]
                chance = np.where(seen > 0, (restored(levels) + types[x] * share) / np.maximum(seen, 1), share)
                score += np.bincount(doc[at], np.log10(np.clip(chance, 1e-300, 1.0)), len(bodies))
            del slices
            if waves > 1:
                # the worker's copy, which it reads again from disk for the next block
                vars(shared[wave]).pop("_value", None)
        columns = {n: pa.array(np.concatenate(out[n])) for n in names}
        return pa.table({"doc_id": table["doc_id"], **columns, "score": pa.array(score)})

    return run


def predict(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Learns outside fold 0, scores every row; held_out marks fold 0."""
    found = score(docs, fold(docs["doc_id"], folds) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
