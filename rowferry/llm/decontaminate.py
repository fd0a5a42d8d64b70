"""Benchmark decontamination with one automaton over the test items.

Items are normalised to words joined by one space. Every window of an item is a
pattern " w1 w2 ... w10 " of one Aho-Corasick automaton; a document, normalised
the same way, is read once. A match ends at a character, a binary search over
the ends of the normalised words gives its last word, and the words' places in
the original text give the offsets.

The automaton goes to the workers by broadcast. Test sets are small, but their
size is checked: beyond `group_bytes` of text the items are dealt into groups by
a hash, and each group is scanned in a pass of its own that adds to the row what
it finds. Nothing is merged by key, so every row keeps its own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import pair
from rowferry.llm.flat import LOWER, tidy, word_spans
from rowferry.llm.shared import Workspace

WINDOW = 10
GROUP_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TO_LOWER = {c: c + 32 for c in range(65, 91)}
SPAN = ("first", "last", "start", "end")
HITS = "doc_id {key},{text} n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, item_ids array<string>"


def windows(text: str, size: int = WINDOW) -> list[str]:
    """The windows of an item as normalised patterns; a short item is one window."""
    words = WORD.findall(text.translate(TO_LOWER))
    count = max(1, len(words) - size + 1) if words else 0
    return [f" {' '.join(words[i : i + size])} " for i in range(count)]


def automaton(items: list[tuple[str, str]], size: int = WINDOW) -> tuple:
    """The automaton of (item id, text) rows; a pattern carries its items and its length in words."""
    owners: dict[str, set[str]] = {}
    for item, text in items:
        for pattern in windows(text, size):
            owners.setdefault(pattern, set()).add(item)
    machine = ahocorasick.Automaton()
    for pattern, names in owners.items():
        machine.add_word(pattern, (pattern.count(" ") - 1, tuple(names)))
    machine.make_automaton()
    return machine, bool(owners)


def scan(text: bytes, machine, filled: bool) -> tuple[int, list[tuple[int, int, int, int]], set[str]]:
    """(number of words, hit runs, items) of one text.

    A run is (first word, last word, start byte, end byte), ends exclusive for
    the bytes of the original text.
    """
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = word_spans(data, SEPARATORS)
    if not len(starts) or not filled:
        return len(starts), [], set()
    # one space instead of each run of separators, one at either end
    keep = ~SEPARATORS[data]
    keep[starts[1:] - 1] = True
    lead = starts[0]
    squeezed = np.where(SEPARATORS[data], np.uint8(32), data)[lead : ends[-1]][keep[lead : ends[-1]]]
    normal = f" {squeezed.tobytes().decode()} "
    places, items = [], set()
    for at, (count, names) in machine.iter(normal):
        places.append((at, count))
        items.update(names)
    if not places:
        return len(starts), [], items
    spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
    found = np.array(places)
    last = np.searchsorted(spaces, found[:, 0]) - 1
    first = last - found[:, 1] + 1
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, last + 1, -1)
    turns = np.diff(np.r_[0, (np.cumsum(mark)[:-1] > 0).astype(np.int8), 0])
    heads, tails = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1
    return len(starts), [(int(a), int(b), int(starts[a]), int(ends[b])) for a, b in zip(heads, tails)], items


def joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Maximal runs of the hit words of several passes."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1] + 1:
            a, b = out[-1], span
            out[-1] = (a[0], max(a[1], b[1]), a[2], max(a[3], b[3]))
        else:
            out.append(span)
    return out


def _scan_group(docs: DataFrame, items: list[tuple[str, str]], size: int, last: bool) -> DataFrame:
    """The rows (doc_id, text and, from the second pass on, the hits so far) with the hits of the items.

    The last pass leaves the text out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, filled = automaton(shared.value, size)
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in SPAN]))
        for batch in batches:
            counts, spans, names = [], [], []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_buffer()
                count, found, items = scan(b"" if text is None else text.to_pybytes(), machine, filled)
                if batch.num_columns > 2:
                    found = joined(found + [tuple(x[n] for n in SPAN) for x in batch.column(3)[row].as_py()])
                    items = items.union(batch.column(4)[row].as_py())
                counts.append(count)
                spans.append([dict(zip(SPAN, x)) for x in found])
                names.append(sorted(items))
            texts = {} if last else {"text": batch.column(1)}
            yield pa.record_batch(
                [batch.column(0), *texts.values(), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", *texts, "n_words", "spans", "item_ids"],
            )

    return docs.mapInArrow(tidy(run), HITS.format(key=docs.schema[0].dataType.simpleString(), text="" if last else " text string,"))


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = WINDOW, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Hit words of every text: doc_id, n_words, spans, item_ids (sorted as strings).

    A span is a maximal run of hit words: its first and last word and its bytes
    in the original UTF-8 text. Null and empty texts have no words; null or
    empty items have no window, a null item id counts as "null"; equal items
    are listed both. Every row has its own result, whether or not its key is
    null or there more than once, and however many groups the items need.
    """
    data = pair(docs, key, text)
    tests = items.select(F.coalesce(items[item_key].cast("string"), F.lit("null")).alias("item"), F.coalesce(items[item_text], F.lit("")).alias("text"))
    held = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-held // group_bytes))
    tests = tests.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    # between two passes the rows are written, so that no task holds two automata
    space, found = Workspace(docs.sparkSession), data
    for part in range(groups):
        rows = [(r.item, r.text) for r in tests.filter(F.col("part") == part).select("item", "text").toLocalIterator()]
        found = _scan_group(found, rows, size, part == groups - 1)
        if part < groups - 1:
            found = space.keep(found, "leaks")
            space.clear(found)
    return found


def hit_count(spans):
    """Distinct words in spans, which may overlap where several passes found them."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(-1).alias("upto"))

    def step(seen, s):
        first = F.greatest(s["first"], seen["upto"] + 1)
        return F.struct(
            (seen["hit"] + F.greatest(s["last"] - first + 1, F.lit(0))).cast("long").alias("hit"),
            F.greatest(s["last"], seen["upto"]).alias("upto"),
        )

    return F.aggregate(ordered, start, step, lambda seen: seen["hit"])


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every text."""
    found = find_leaks(docs, items, **options)
    return found.select(
        "doc_id", "n_words", hit_count(F.col("spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any hit word, all their columns kept.

    The scan runs next to the row: documents are not shuffled. A null text stays.
    """
    tests = items.select(F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    held = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-held // GROUP_BYTES))
    tests = tests.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(groups)))
    kept = docs
    for part in range(groups):
        rows = [("", r.text) for r in tests.filter(F.col("part") == part).toLocalIterator()]
        kept = _drop_group(kept, rows, size)
    return kept


def _drop_group(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, filled = automaton(shared.value, size)
        for batch in batches:
            texts = ((batch.column(place)[i].as_buffer()) for i in range(batch.num_rows))
            clean = [t is None or not scan(t.to_pybytes(), machine, filled)[1] for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
