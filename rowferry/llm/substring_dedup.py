"""Removal of word sequences that also start in an earlier document, by partitioned suffix trees.

The suffixes of the corpus are those that start at the words of its documents;
two of them share a window when their first WINDOW words are equal. They are
split by prefixes, the subtree under each prefix is built in one task, and the
nodes of it that are WINDOW words deep hold the repeats: every suffix of such a
node that is not of its smallest document starts a window to be removed.

* Which suffixes meet. Every window has a seed, its least hashed SEED-word
  string, and successive windows with the same seed make a run. Suffixes of a
  run share the run's seed as prefix key, so they stay in one group with all
  windows that can equal them. Equal whole runs are one leaf: only the smallest
  document of it goes on, the others are known to lose all of it. Copies thus
  leave one row per task and leaf before anything is shuffled.
* Prefixes of variable length. A group that holds more than GROUP runs is split
  by a longer key: windows with many words before the key take them into it,
  the others the words behind it, which halves the words left open each time.
  A key of WINDOW words is a window, a single leaf. So no group has to be held
  that is larger than GROUP runs, and none is cut.
* Subtrees are built from the root down: the suffixes of a node are parted by
  their next TOKEN words, and a node whose suffixes are of one document is left.

Words are runs of bytes between blanks, unchanged, and compared by 64-bit
hashes. A text is named by its key and a hash, so keys may repeat; equal keys
are no smaller than each other, and neither takes words from the other. A row
with a null key keeps all its words and takes none. Null and empty texts have
no words. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rowferry.llm.columns import pair
from rowferry.llm.flat import SPACE, mix, pieces, prefix_hash, span_hash, word_spans
from rowferry.llm.shared import Workspace
from rowferry.operators.skew import group_for_join

WINDOW = 50
SEED = 12
TOKEN = 10
# runs in a group that is built as one subtree
GROUP = 1000
# runs of which a task joins the equal ones before they are shuffled
COMBINE = 400_000
BATCH_BYTES = 4 << 20
_PLACE = np.uint64((1 << 30) - 1)

Runs = dict[str, np.ndarray]
RUN = "key long, span long, doc long, tid long, first int, lead int, size int, spread long"
BODY = "key long, span long, doc long, at int, lead int, size int, body binary"
LOST = "doc long, span long, first int, last int"


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_spans(data, SPACE)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, bounds)


def runs_of(words: np.ndarray, offsets: np.ndarray) -> Runs:
    """The runs of windows: row (of offsets), first (place in `words`), size, lead, key and span.

    `lead` is the number of words before the seed in the first window; `span`
    tells equal runs.
    """
    wide = WINDOW - SEED + 1
    if len(words) < WINDOW:
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "size", "lead", "key", "span")}
    prefix, places = prefix_hash(words), np.arange(len(words) - SEED + 1)
    grams = span_hash(prefix, places, places + SEED)
    # least hash of a window; the leftmost of equal ones
    least = grams & ~_PLACE | places.astype(np.uint64)
    width = 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    seed = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(seed))
    inside = starts + WINDOW <= offsets[1:][row[: len(seed)]]
    fresh = inside & np.r_[True, (seed[1:] != seed[:-1]) | ~inside[:-1]]
    heads = np.flatnonzero(fresh)
    # a run ends before the next head or the first window that leaves its text
    stops = np.flatnonzero(fresh | ~inside)
    ends = np.r_[stops, len(seed)][np.searchsorted(stops, heads, "right")]
    at = seed[heads]
    span = span_hash(prefix, heads, ends - 1 + WINDOW) + mix((at - heads).astype(np.uint64))
    return {"row": row[heads], "first": heads, "size": ends - heads, "lead": at - heads, "key": grams[at].view(np.int64), "span": span.view(np.int64)}


def joined(runs: Runs) -> Runs:
    """One row per key, span and document; all but the smallest document of a span are spread."""
    order = np.lexsort((runs["first"], runs["tid"], runs["doc"], runs["span"], runs["key"]))
    key, span, doc = (runs[k][order] for k in ("key", "span", "doc"))
    leaf = np.r_[True, (key[1:] != key[:-1]) | (span[1:] != span[:-1])]
    kept = leaf | np.r_[True, doc[1:] != doc[:-1]]
    # not zero for those that need nobody else
    spread = np.where(leaf, 0, mix(doc.view(np.uint64)).view(np.int64) | 1)
    return {**{k: v[order][kept] for k, v in runs.items()}, "spread": spread[kept]}


def _runs(data: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        count = 0

        def flush() -> pa.RecordBatch:
            rows = joined({k: np.concatenate([h[k] for h in held]) for k in held[0]})
            return pa.record_batch([pa.array(rows[n], pa.int32() if n in ("first", "lead", "size") else pa.int64()) for n in ("key", "span", "doc", "tid", "first", "lead", "size", "spread")],
                                   ["key", "span", "doc", "tid", "first", "lead", "size", "spread"])

        for ids, texts in pieces(batches):
            words, offsets = hashed_words(texts)
            found = runs_of(words, offsets)
            row = found.pop("row")
            found["first"] = found["first"] - offsets[row]
            found["doc"] = ids.field("doc").to_numpy(zero_copy_only=False)[row]
            found["tid"] = ids.field("tid").to_numpy(zero_copy_only=False)[row]
            held.append(found)
            count += len(row)
            if count > COMBINE:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    named = data.select(F.struct("doc", "tid").alias("id"), "text")
    return named.mapInArrow(run, RUN)


def _bodies(wanted: DataFrame, data: DataFrame) -> DataFrame:
    """The hashed words of the wanted runs, from their texts."""
    lists = group_for_join(wanted, {"doc": F.col("doc"), "tid": F.col("tid")}, F.collect_list(F.struct("key", "span", "first", "lead", "size")).alias("runs"))
    rows = lists.join(data, ["doc", "tid"]).select("doc", "text", "runs", "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for row in range(batch.num_rows):
                # repeated rows lie next to each other
                mine = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                if mine == before:
                    continue
                before = mine
                words, _ = hashed_words([batch.column(1)[row].as_buffer().to_pybytes()])
                runs = batch.column(2)[row].values
                first, size = runs.field("first").to_numpy(), runs.field("size").to_numpy()
                yield pa.record_batch(
                    [runs.field("key"), runs.field("span"), pa.array([batch.column(0)[row].as_py()] * len(first), pa.int64()), pa.array([0] * len(first), pa.int32()),
                     runs.field("lead"), runs.field("size"), pa.array([words[a : a + n + WINDOW - 1].tobytes() for a, n in zip(first, size)], pa.binary())],
                    ["key", "span", "doc", "at", "lead", "size", "body"],
                )

    return rows.mapInArrow(run, BODY)


def longer_keys(words: np.ndarray, lead: int, size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, new lead, new length) of the parts of a run under longer keys.

    The key is words[lead:lead + length], and the windows start at 0 to size - 1.
    """
    open_ = WINDOW - length
    half = (open_ + 1) // 2
    # windows with at least `half` words before the key take these into it
    before = min(size, lead - half + 1)
    if before > 0:
        yield 0, before, lead - half, length + half
    start = max(0, before)
    if start < size:
        yield start, size - start, lead - start, length + open_ - half + 1


def _split(bodies: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = np.frombuffer(r["body"], np.uint64)
                prefix = prefix_hash(words)
                for start, count, lead, size in longer_keys(words, r["lead"], r["size"], length):
                    body = words[start : start + count + WINDOW - 1]
                    spot = np.array([start + lead, start]), np.array([start + lead + size, start + len(body)])
                    key, same = span_hash(prefix, *spot).view(np.int64)
                    out.append((int(key), r["span"], r["doc"], r["at"] + start, lead, count, body.tobytes(), size, int(same)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(),) * 3 + (pa.int32(),) * 3 + (pa.binary(), pa.int32(), pa.int64()))],
                ["key", "span", "doc", "at", "lead", "size", "body", "length", "same"],
            )

    return bodies.mapInArrow(run, f"{BODY}, length int, same long")


def grow(words: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree over suffixes, from the root down: (suffix, node) of its nodes WINDOW words deep.

    Only nodes with suffixes of several documents are opened.
    """
    prefix = prefix_hash(words)
    held, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, WINDOW, TOKEN):
        begin = starts[held] + depth
        token = span_hash(prefix, begin, begin + min(TOKEN, WINDOW - depth))
        order = np.lexsort((token, node))
        held, node, token = held[order], node[order], token[order]
        if not len(held):
            break
        heads = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (token[1:] != token[:-1])])
        counts = np.diff(np.r_[heads, len(held)])
        mine = docs[held]
        several = np.minimum.reduceat(mine, heads) < np.maximum.reduceat(mine, heads)
        keep = np.repeat(several, counts)
        node = np.repeat(np.arange(len(heads)), counts)[keep]
        held = held[keep]
    return held, node


def lost_windows(batch: dict[str, np.ndarray], bodies: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows (doc, span, first, last) of a batch of whole groups that start in a smaller document as well."""
    words = np.frombuffer(b"".join(bodies), np.uint64)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 8
    offset, count = np.cumsum(sizes) - sizes, batch["size"]
    entry = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    held, node = grow(words, offset[entry] + place, batch["doc"][entry])
    if not len(held):
        return {k: np.zeros(0, np.int64) for k in ("doc", "span", "first", "last")}
    docs = batch["doc"][entry[held]]
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.r_[heads, len(node)]))
    gone = np.sort(held[docs > least])
    if not len(gone):
        return {k: np.zeros(0, np.int64) for k in ("doc", "span", "first", "last")}
    e, p = entry[gone], place[gone]
    heads = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (p[1:] != p[:-1] + 1)])
    tails = np.r_[heads[1:], len(gone)] - 1
    at = batch["at"][e[heads]]
    return {"doc": batch["doc"][e[heads]], "span": batch["span"][e[heads]], "first": p[heads] + at, "last": p[tails] + at}


def _subtrees(bodies: DataFrame, parts: int) -> DataFrame:
    """Builds the subtree of every group; a batch holds whole groups."""
    dealt = bodies.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            columns = {n: table[n].to_numpy().astype(np.int64) for n in ("span", "doc", "at", "size")}
            lost = lost_windows(columns, table["body"].to_pylist())
            return pa.record_batch([pa.array(lost["doc"], pa.int64()), pa.array(lost["span"], pa.int64()), pa.array(lost["first"], pa.int32()), pa.array(lost["last"], pa.int32())], ["doc", "span", "first", "last"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > BATCH_BYTES:
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield work(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                size = 0
        if sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, LOST)


def lost_of(data: DataFrame) -> tuple[Workspace, DataFrame]:
    """Windows to remove, as places within the runs of their document; data has doc, tid and text."""
    spark = data.sparkSession
    space, parts = Workspace(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaf = Window.partitionBy("key", "span", "spread")
    runs = _runs(data.filter(F.octet_length("text") >= 2 * WINDOW - 1)).withColumns({
        "least": F.min("doc").over(leaf), "nth": F.row_number().over(leaf.orderBy("doc", "tid", "first")),
    })
    runs = space.keep(runs.filter("spread <> 0 OR doc > least OR nth = 1").withColumn("done", F.expr("spread <> 0 OR doc > least")).drop("spread", "least", "nth"), "runs")
    lost = [runs.filter("done").select("doc", "span", F.lit(0).alias("first"), (F.col("size") - 1).alias("last"))]
    leaves = runs.filter("NOT done")
    groups = group_for_join(leaves, {"key": F.col("key")}, F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    wanted = leaves.join(groups.filter("low < high").select("key", "n"), "key")
    bodies = space.keep(_bodies(wanted.drop("n"), data), "bodies")
    groups_of_one_length = {SEED: bodies}
    while groups_of_one_length:
        length = min(groups_of_one_length)
        rows = groups_of_one_length.pop(length)
        sizes = group_for_join(rows, {"key": F.col("key")}, F.count("*").alias("n"))
        large = space.keep(sizes.filter(F.col("n") > GROUP), "large") if length < WINDOW else None
        if large is None or not large.limit(1).count():
            lost.append(_subtrees(rows, parts))
            continue
        lost.append(_subtrees(rows.join(large, "key", "left_anti"), parts))
        half = (WINDOW - length + 1) // 2
        # equal words of one document are one row, and the smallest document is found before rows of equal words meet
        cut = space.keep(_split(rows.join(large, "key", "left_semi"), length).dropDuplicates(["key", "same", "doc", "span", "at"]), "longer")
        least = group_for_join(cut, {"key": F.col("key"), "same": F.col("same")}, F.min("doc").alias("least"))
        cut = space.keep(cut.join(least, ["key", "same"]), "least")
        lost.append(cut.filter("doc > least").select("doc", "span", F.col("at").alias("first"), (F.col("at") + F.col("size") - 1).alias("last")))
        # several runs of the smallest document may hold the same words: all of them stay, one is enough to compare
        for longer in {length + half, WINDOW - half + 1}:
            more = cut.filter(f"length = {longer} AND doc = least").select(*bodies.columns)
            held = groups_of_one_length.get(longer)
            groups_of_one_length[longer] = more if held is None else held.unionByName(more)
    found = lost[0]
    for more in lost[1:]:
        found = found.unionByName(more)
    return space, space.keep(found.distinct(), "lost")


def kept_words(text: bytes, lost: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words of a text and those that are left; `lost` names windows of its runs."""
    held = text.split()
    if not lost:
        return len(held), held
    by_span = defaultdict(list)
    for r in lost:
        by_span[r["span"]].append((r["first"], r["last"]))
    runs = runs_of(*hashed_words([text]))
    gone = np.zeros(len(held) + 1, np.int64)
    for first, span in zip(runs["first"].tolist(), runs["span"].tolist()):
        for a, b in by_span.get(span, ()):
            gone[first + a] += 1
            gone[first + b + WINDOW] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return len(held), [w for w, c in zip(held, covered.tolist()) if not c]


def _applied(docs: DataFrame, key: str, text: str, schema: str, work: Callable[[pa.RecordBatch, list[tuple[int, list[bytes]] | None]], pa.RecordBatch]) -> DataFrame:
    """mapInArrow over the rows of docs with the number of words and the kept words of each (None for a null text)."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} has to be a whole number, not {kind.simpleString()}")
    data = docs.select(docs[key].cast("long").alias("doc"), F.xxhash64(docs[text]).alias("tid"), docs[text].alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    _, lost = lost_of(data)
    mine, held = "_doc", "_lost"
    while mine in docs.columns or held in docs.columns:
        mine, held = f"_{mine}", f"_{held}"
    lists = group_for_join(lost, {mine: F.col("doc")}, F.collect_list(F.struct("span", "first", "last")).alias(held))
    rows = docs.withColumn(mine, docs[key].cast("long")).join(lists, mine, "left").drop(mine)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for row in range(batch.num_rows):
                buffer, gone = batch.column(place)[row].as_buffer(), batch.column(batch.num_columns - 1)[row].as_py()
                words.append(None if buffer is None else kept_words(buffer.to_pybytes(), gone))
            yield work(batch, words)

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, parted by one space) of every row."""
    rows = pair(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digests(batch: pa.RecordBatch, words: list[tuple[int, list[bytes]] | None]) -> pa.RecordBatch:
        found = [w or (0, []) for w in words]
        return pa.record_batch(
            [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(kept) for n, kept in found], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(kept)).hexdigest() for _, kept in found], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return _applied(rows, "doc_id", "text", f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", digests)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the kept words of their texts, parted by one space; all columns stay, a null text too."""
    place, schema = docs.columns.index(text), docs.schema

    def texts(batch: pa.RecordBatch, words: list[tuple[int, list[bytes]] | None]) -> pa.RecordBatch:
        left = pa.array([None if w is None else b" ".join(w[1]).decode() for w in words], pa.string())
        return pa.record_batch([left if k == place else batch.column(k) for k in range(len(schema))], schema.names)

    return _applied(docs, key, text, schema, texts)
