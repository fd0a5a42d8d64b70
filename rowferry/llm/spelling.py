"""Groups of spellings: words one edit apart, and the frequent form that each stands for.

The vocabulary (distinct words with their number of occurrences) is split so
that two words one edit apart meet: the edit of a pair leaves either the first
or the last half of the shorter word whole, so each word is entered under both
halves, once as the shorter and once as the longer word of a pair. A group that
stays larger than GROUP words is split in the same way by the halves of what is
still open between its common ends, which ends at groups that differ in one
code point and so are bounded by the alphabet.

In a task, the words of whole groups form one sorted list (reversed words where
the common part is at the end). The words of the list are sought in it all at
once, depth by depth: words with a common prefix, which the common prefixes of
neighbours (LCP) delimit, are one range of the list and share one row of the
edit matrix, of which the three cells around the diagonal are kept. A range
whose row has no cell of one edit or less is skipped with all its words.

Null texts have no words, a null key counts as an empty one, repeated rows
count each time. Of near words of equal number the smallest in code-point order
is taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import pair
from rowferry.llm.flat import LOWER
from rowferry.llm.shared import Workspace
from rowferry.operators.skew import group_for_join

RUN = r"[a-zÀ-ÿ]"
MIN_LENGTH = 6
MIN_COUNT = 5
# a form is so many times as frequent as the word it stands for
RATIO = 5
# one in so many runs of a document loses a code point
SLIP = 199
GROUP = 20_000
HELD_WORDS = 400_000
BATCH_WORDS = 40_000
QUERIES = 4096
FAR = 2
_TABLE = LOWER.tobytes()


def words_of(key: str, text: bytes, slip: int = SLIP, shortest: int = MIN_LENGTH) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text; the runs that the checksum picks out lose a code point."""
    found = Counter(re.findall(f"{RUN}{{{shortest},}}", text.translate(_TABLE).decode("utf-8", "ignore")))
    base = zlib.crc32(f"{key}:".encode())
    for run, count in found.items():
        check = zlib.crc32(run.encode(), base)
        if slip and check % slip == 0:
            at = check % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, count


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n) of all words with at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    named = pair(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column(1)[row].as_buffer()
                if body is None:
                    continue
                for word, count in words_of(batch.column(0)[row].as_py(), body.to_pybytes(), slip):
                    held[word] = held.get(word, 0) + count
                if len(held) > HELD_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    counted = named.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _part(length: Column, front: Column, back: Column) -> Column:
    """A group key: length of the shorter word, and what its words have in common at both ends."""
    word = F.col("word")
    return F.struct(
        length.cast("int").alias("length"), front.cast("int").alias("front"), back.cast("int").alias("back"),
        F.substring(word, F.lit(1), front).alias("head"), F.when(back > 0, F.right(word, back)).otherwise("").alias("tail"),
    )


def grouped(words: DataFrame) -> DataFrame:
    """Each word under the first and the last half of the shorter word of a pair: (word, n, key)."""
    size, none = F.char_length("word"), F.lit(0)
    roles = [size, size - 1]
    keys = [_part(r, *ends) for r in roles for ends in ((F.floor(r / 2), none), (none, F.floor(r / 2)))]
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("key"))
    return rows.filter(F.col("key.length") >= MIN_LENGTH)


def halved(rows: DataFrame) -> DataFrame:
    """The same under longer common ends; what is open between them is halved."""
    key = F.col("key")
    half = F.floor((key["length"] - key["front"] - key["back"]) / 2)
    keys = [_part(key["length"], key["front"] + half, key["back"]), _part(key["length"], key["front"], key["back"] + half)]
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("key"))


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all pairs of a list of distinct words that are one edit apart, as places in the list."""
    order = sorted(range(len(words)), key=words.__getitem__)
    listed = [words[k] for k in order]
    size = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
    # one place beyond a word may be read, its value is masked
    flat = np.r_[flat, np.zeros(2, np.uint32)]
    offset = np.cumsum(size) - size
    shared = common_prefixes(flat, offset, size)
    found = [_descend(flat, offset, size, shared, np.arange(a, min(a + QUERIES, len(listed)))) for a in range(0, len(listed), QUERIES)]
    place = np.asarray(order, np.int64)
    if not found:
        return place, place
    return place[np.concatenate([f[0] for f in found])], place[np.concatenate([f[1] for f in found])]


def common_prefixes(flat: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code points that each word of a sorted list shares with the one before."""
    shared = np.zeros(len(size), np.int64)
    open_ = np.arange(1, len(size))
    depth = 0
    while len(open_):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[flat[offset[open_] + depth] == flat[offset[open_ - 1] + depth]]
        depth += 1
        shared[open_] = depth
    return shared


def _descend(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, shared: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeks the queries in the sorted list: a state is a query, a range of the list and the range's matrix row.

    The row has the edits between the range's common prefix, of `depth` code
    points, and the first depth - 1, depth and depth + 1 of the query.
    """
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(size), np.int64)
    left, mid, right = np.full(len(query), FAR, np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0

    def differs(who: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < size[who])
        return np.where(inside, flat[np.where(inside, offset[who] + at, 0)] != code, FAR).astype(np.int8)

    while len(query):
        # ranges of one code point more, and those of each state
        breaks = np.flatnonzero(shared <= depth)
        heads = breaks[size[breaks] > depth]
        begin, end = np.searchsorted(heads, low), np.searchsorted(heads, high)
        count = end - begin
        state = np.repeat(np.arange(len(query)), count)
        child = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        query, stop = query[state], high[state]
        low = heads[child]
        following = np.searchsorted(breaks, low, "right")
        high = np.minimum(stop, np.r_[breaks, len(size)][following])
        code = flat[offset[low] + depth]
        a, b, c = left[state], mid[state], right[state]
        left = np.minimum(a + differs(query, depth - 1, code), b + 1)
        mid = np.minimum(np.minimum(b + differs(query, depth, code), c + 1), left + 1)
        right = np.minimum(c + differs(query, depth + 1, code), mid + 1)
        right = np.where(size[query] < depth + 2, FAR, right).astype(np.int8)
        mid = np.where(size[query] < depth + 1, FAR, mid).astype(np.int8)
        depth += 1
        near = np.minimum(np.minimum(left, mid), right) < FAR
        query, low, high, left, mid, right = (x[near] for x in (query, low, high, left, mid, right))
        # the first word of a range may end here
        gap = size[query] - depth
        edits = np.select([gap == -1, gap == 0, gap == 1], [left, mid, right], FAR)
        hit = (size[low] == depth) & (edits == 1)
        hits.append((query[hit], low[hit]))
    if not hits:
        return query, query
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _scan(rows: DataFrame, parts: int) -> DataFrame:
    """(word, near, near_n) within the groups; a pair may come several times."""
    backward = F.col("key.front") < F.col("key.back")
    dealt = rows.select(backward.alias("backward"), "key", "word", "n").repartition(parts, "backward", "key").sortWithinPartitions("backward", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        group, turned = None, False

        def work() -> pa.RecordBatch:
            words = list(held)
            counts = np.fromiter(held.values(), np.int64, len(held))
            query, near = near_pairs([w[::-1] for w in words] if turned else words)
            names = pa.array(words, pa.string())
            return pa.record_batch([names.take(pa.array(query)), names.take(pa.array(near)), pa.array(counts[near])], ["word", "near", "near_n"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for backward, key, word, n in zip(*columns):
                if held and (backward != turned or (len(held) >= BATCH_WORDS and key != group)):
                    yield work()
                    held.clear()
                group, turned = key, backward
                held[word] = n
        if held:
            yield work()

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def near_words(space: Workspace, words: DataFrame) -> DataFrame:
    """Distinct (word, near, near_n) of the words one edit apart."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found = grouped(words), []
    while True:
        counts = group_for_join(rows, {"key": F.col("key")}, F.count("*").alias("size"))
        open_ = F.col("key.length") - F.col("key.front") - F.col("key.back")
        large = space.keep(counts.filter((F.col("size") > GROUP) & (open_ > 1)).select("key"), "large")
        if not large.limit(1).count():
            found.append(_scan(rows, parts))
            break
        found.append(_scan(rows.join(large, "key", "left_anti"), parts))
        rows = space.keep(halved(rows.join(large, "key", "left_semi")), "halved")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(space: Workspace, links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of links (word, form), which has no cycles.

    Each round doubles the steps taken; chains are short, since the numbers
    grow by RATIO a step.
    """
    held = space.keep(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = space.keep(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        held = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return held


def group_spellings(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n)."""
    space = Workspace(words.sparkSession)
    words = space.keep(words, "vocabulary")
    near = near_words(space, words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("name"))).alias("best")
    )
    most = -F.col("best.minus")
    fits = most >= RATIO * F.col("n")
    forms = space.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.name")).alias("form"), F.when(fits, most).alias("form_n")
    ), "forms")
    ends = roots(space, forms.filter("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spellings of the words of all texts."""
    return group_spellings(vocabulary(docs, key, text))
