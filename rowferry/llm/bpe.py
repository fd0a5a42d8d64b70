"""BPE encoding and decoding with a public vocabulary file.

A tokenizer file is read once per Python worker. Texts are cut into pieces by
the file's own rules, and the distinct pieces of a batch are merged together:
their symbols lie in one flat array, each round looks neighbouring pairs up in
the sorted pair keys by binary search and merges the pair of lowest rank of
every piece.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame

from rowferry.llm.columns import pair
from rowferry.llm.flat import pieces, tidy

NO_RANK = np.int64(1 << 40)
_loaded: dict[str, WordBpe] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary whose last symbol of a piece has a suffix.

    Expects what the file of a word-level public tokenizer states: normal form C,
    white space and case folded, a split pattern whose matches are the pieces,
    bytes as letters, added tokens taken from the raw text, and no decoder, so
    that decoding joins the tokens by one space.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(rf"\n|ADDED\d+|{split['pattern']['Regex']}", regex.V0)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, number in chain(vocab.items(), self.added.items()):
            self.tokens[number] = token
        self.names = pa.array(self.tokens, pa.string())
        self.numbers = pa.array(map(str, range(len(self.tokens))), pa.string())
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)

    def normalize(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # letter by letter where the context of a letter would count
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def blanked(self, text: str) -> str:
        """The normalised text with single blanks wherever no piece can go on.

        Line ends become blanks, and an added token becomes a word of its own in
        upper case, which no normalised text contains.
        """
        if not any(t in text for t in self.added):
            return self.normalize(text).replace("\n", " ")
        out, at = [], 0
        for found in self.added_pattern.finditer(text):
            out += [self.normalize(text[at : found.start()]).replace("\n", " "), f"ADDED{self.added[found[0]]}"]
            at = found.end()
        return " ".join([*out, self.normalize(text[at:]).replace("\n", " ")])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array and where each word's begin (one more).

        All words, none of them empty, are merged together round by round.
        """
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(data), np.uint8)
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(data)), sizes)
        # the rank of the pair that begins at each symbol; none at a word's end
        ranks = np.full(len(ids), NO_RANK)
        begins = np.flatnonzero(word[:-1] == word[1:])
        ranks[begins] = self.rank(ids[begins], ids[begins + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[firsts, len(ids)])
            least = np.repeat(np.minimum.reduceat(ranks, firsts), lengths)
            open_ = least < NO_RANK
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, ranks, least = ids[open_], word[open_], ranks[open_], least[open_]
            # of overlapping equal pairs (aaa) the first, third, ... are merged
            spots = np.flatnonzero(ranks == least)
            runs = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
            inside = np.arange(len(spots)) - np.repeat(runs, np.diff(np.r_[runs, len(spots)]))
            spots = spots[inside % 2 == 0]
            ids[spots] = self.merged[ranks[spots]]
            keep = np.ones(len(ids), bool)
            keep[spots + 1] = False
            touched = np.zeros(len(ids) + 1, bool)
            touched[spots] = True
            ids, word, ranks, touched = ids[keep], word[keep], ranks[keep], touched[:-1][keep]
            # a merged symbol gets new pairs with both neighbours
            touched[:-1] |= touched[1:]
            anew = np.flatnonzero(touched)
            ranks[anew] = NO_RANK
            anew = anew[anew < len(ids) - 1]
            anew = anew[word[anew] == word[anew + 1]]
            ranks[anew] = self.rank(ids[anew], ids[anew + 1])
        words_of = np.concatenate([w for w, _ in done])
        ids_of = np.concatenate([i for _, i in done])
        counts = np.bincount(words_of, minlength=len(words))
        return ids_of[np.argsort(words_of, kind="stable")], np.r_[0, np.cumsum(counts)]

    def encode_batch(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of the distinct chunks of all texts (a list array), and the texts in chunks.

        Text i consists of the chunks number[bounds[i]:bounds[i + 1]]; chunks
        without ids are left out.
        """
        lists = pc.split_pattern(pa.array(map(self.blanked, texts), pa.string()), " ")
        coded = lists.values.dictionary_encode()
        # a line end closes each chunk, and counts as a piece without ids
        found = pa.array(self.pattern.findall("\n".join(coded.dictionary.to_pylist()) + "\n"), pa.string()).dictionary_encode()
        words = found.dictionary.to_pylist()
        flat, starts = self.merge(words)
        starts, sizes = starts[:-1].copy(), np.diff(starts)
        for place, word in enumerate(words):
            if word == "\n":
                sizes[place] = 0
            elif word.startswith("ADDED"):
                starts[place], sizes[place] = len(flat), 1
                flat = np.r_[flat, int(word[5:])]
        number = found.indices.to_numpy()
        lengths = sizes[number]
        until = np.cumsum(lengths)
        spots = np.repeat(starts[number] - (until - lengths), lengths) + np.arange(until[-1])
        closed = until[number == words.index("\n")]
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, closed], pa.int32()), pa.array(flat[spots], pa.int32()))
        number = coded.indices.to_numpy()
        filled = np.diff(ids.offsets.to_numpy())[number] > 0
        bounds = np.r_[0, np.cumsum(filled)][lists.offsets.to_numpy()]
        return ids, number[filled], bounds

    def join(self, names: pa.Array, ids: pa.Array, number: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The names of the ids of each text, joined by one space."""
        blank = pa.scalar(" ")
        chunks = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.values)), blank)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chunks.take(pa.array(number))), blank)

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens of the ids, joined by one space; an unknown id is left out."""
        known = len(self.tokens)
        return " ".join([self.tokens[i] for i in ids if 0 <= i < known])


def _encoder(shared) -> WordBpe:
    """The tokenizer of a broadcast file text, built once per worker."""
    text = shared.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(text)
    return _loaded[key]


def _share(docs: DataFrame, path: str):
    """The vocabulary file, a few MB whatever the corpus, sent to the workers."""
    context: SparkContext = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as file:
        return context.broadcast(file.read())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of runs of rows of a few MB."""
    for keys, texts in pieces(batches, 12 << 20):
        yield keys, [t.decode() for t in texts]


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text. A null or empty text has no ids; equal rows stay."""
    shared = _share(docs, tokenizer_path)
    data = pair(docs, key, text)

    def run(batches):
        bpe = _encoder(shared)
        for keys, texts in _runs(batches):
            ids, number, bounds = bpe.encode_batch(texts)
            taken = ids.take(pa.array(number))
            lists = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[bounds]), taken.values)
            yield pa.record_batch([keys, lists], ["doc_id", "ids"])

    return data.mapInArrow(tidy(run), f"doc_id {data.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of every id list. A null or empty list gives an empty text."""
    shared = _share(encoded, tokenizer_path)
    data = encoded.select(encoded[key].alias("doc_id"), encoded[ids].alias("ids"))

    def run(batches):
        bpe = _encoder(shared)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return data.mapInArrow(tidy(run), f"doc_id {data.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass and returns digests.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the decoded text). Null and empty texts have 0 tokens and
    the digest of nothing; repeated rows give repeated results.
    """
    shared = _share(docs, tokenizer_path)
    data = pair(docs, key, text)

    def run(batches):
        bpe = _encoder(shared)
        for keys, texts in _runs(batches):
            ids, number, bounds = bpe.encode_batch(texts)
            counts = np.r_[0, np.cumsum(np.diff(ids.offsets.to_numpy())[number])]
            yield pa.record_batch(
                [
                    keys,
                    pa.array(counts[bounds[1:]] - counts[bounds[:-1]], pa.int64()),
                    _digests(bpe.join(bpe.numbers, ids, number, bounds)),
                    _digests(bpe.join(bpe.names, ids, number, bounds)),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return data.mapInArrow(tidy(run), f"doc_id {data.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
