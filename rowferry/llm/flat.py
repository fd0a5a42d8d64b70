"""Texts of an Arrow batch as flat byte arrays, and hashes of their words.

The functions here run inside tasks. Texts are UTF-8 bytes, so the separators
of a word are bytes below 0x80 and every byte from 0x80 on belongs to a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of runs of rows whose texts hold about `limit` bytes.

    The first column is the id, the second the text; a null text is empty. One
    text longer than the limit is a run of its own.
    """
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        texts, held, first = [], 0, 0
        for row in range(batch.num_rows):
            text = column[row].as_buffer()
            data = b"" if text is None else text.to_pybytes()
            if texts and held + len(data) > limit:
                yield ids.slice(first, row - first), texts
                texts, held, first = [], 0, row
            texts.append(data)
            held += len(data)
        if texts:
            yield ids.slice(first), texts


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which hands Arrow's free memory back at the end.

    Python workers go on to other tasks and would keep the most that any of them took.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def mix(values: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input moves every bit."""
    out = np.atleast_1d(values) + np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below `count` at least."""
    held = _powers.get("up")
    if held is None or len(held) < count:
        size = max(count, PIECE_BYTES + (1 << 16))
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of each prefix of bytes or 64-bit values; one longer than the data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUES[data] if data.dtype == np.uint8 else data
    np.cumsum(values * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, from the hashes of the prefixes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no separators."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(texts: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and where each text's words begin (one more)."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_spans(data, separators)
    hashes = span_hash(prefix_hash(data), starts, ends)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, bounds)


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The number of its text for each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of 64-bit values, byte plane after byte plane.

    Planes of high bytes are nearly constant and cost nothing once compressed.
    """
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    """The values of planes(), as unsigned 64-bit numbers."""
    flat = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()
