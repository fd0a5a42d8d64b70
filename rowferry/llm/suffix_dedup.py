"""Removal of byte strings that occur more than once, by a partitioned suffix sort.

A text is cut at anchors: the least hashed 100-byte string of each 400-byte
window. Equal windows have equal anchors at equal places, so only suffixes that
belong to an anchor which occurs more than once can have a partner. Runs of
windows with a common anchor whose whole stretch occurs again need no closer
look. The suffixes of the other runs are range-partitioned by their leading
token, the anchor's hash, with splitters that Spark samples; in each partition
they are sorted token by token (eight fingerprints of 50 bytes), going on only
with those still equal to another one, as multikey quicksort does. A leading
token never spans a boundary between partitions, so boundaries need no repair.

The elements of a text are its bytes or, for a length in words, the hashes of
its words between blanks; anchor and token are a quarter and an eighth of the
length, so 100 and 50 bytes for windows of 400. Offsets are bytes of the UTF-8
text. Rows are told apart by a hash of key and text, so keys may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.columns import pair
from rowferry.llm.flat import SPACE, mix, pieces, prefix_hash, span_hash, tidy, word_spans
from rowferry.llm.shared import Workspace, maybe_among

LENGTH = 400
BLOCK = 1 << 22
# anchors of which a task combines the copies before they are shuffled
COMBINE = 500_000
STEP_WINDOWS = 1_000_000


def elements(text: bytes, words: bool) -> np.ndarray:
    """The bytes of a text, or the hashes of its words."""
    data = np.frombuffer(text, np.uint8)
    return span_hash(prefix_hash(data), *word_spans(data, SPACE)) if words else data


def runs_of(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch hash, first and last window and lead of each run of windows.

    The lead is the distance of the anchor from the first window.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    parts = [_block(data[a : a + BLOCK + length - 1], a, length) for a in range(0, len(data) - length + 1, BLOCK)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block(data: np.ndarray, base: int, length: int) -> tuple[np.ndarray, ...]:
    prefix, size = prefix_hash(data), max(1, length // 4)
    places = np.arange(len(data) - size + 1)
    grams = span_hash(prefix, places, places + size)
    # least hash of a window; the leftmost of equal ones
    least = grams & ~np.uint64((1 << 24) - 1) | places.astype(np.uint64)
    width, wanted = 1, length - size + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    tails = np.r_[heads[1:], len(anchor)] - 1
    at = anchor[heads]
    stretch = span_hash(prefix, heads, tails + length) + mix((at - heads).astype(np.uint64))
    return grams[at].view(np.int64), stretch.view(np.int64), heads + base, tails + base, at - heads


def combined(columns: tuple[np.ndarray, ...], owner: np.ndarray) -> dict[str, np.ndarray]:
    """One row per anchor and stretch with their number n; the other rows of it have n = 0.

    Those are known to be repeated, so they are dealt out by a hash of their
    place and do not meet under their anchor.
    """
    gram, span, first, last, lead = columns
    order = np.lexsort((first, owner, span, gram))
    gram, span, first, last, lead, owner = (x[order] for x in (gram, span, first, last, lead, owner))
    fresh = np.r_[True, (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])]
    heads = np.flatnonzero(fresh)
    count = np.zeros(len(gram), np.int32)
    count[heads] = np.diff(np.r_[heads, len(gram)])
    gram = np.where(fresh, gram, mix(owner.view(np.uint64) + first.astype(np.uint64)).view(np.int64))
    return {"gram": gram, "span": span, "uid": owner, **{k: v.astype(np.int32) for k, v in (("first", first), ("last", last), ("lead", lead))}, "n": count}


def _anchors(data: DataFrame, length: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(combined(tuple(np.concatenate([f[k] for f in found]) for k in range(5)), np.concatenate(owners)))

        for uids, texts in pieces(batches):
            for uid, text in zip(uids.to_pylist(), texts):
                found.append(runs_of(elements(text, words), length))
                owners.append(np.full(len(found[-1][0]), uid, np.int64))
                held += len(owners[-1])
                if held > COMBINE:
                    yield flush()
                    found, owners, held = [], [], 0
        if held:
            yield flush()

    return data.mapInArrow(tidy(run), "gram long, span long, uid long, first int, last int, lead int, n int")


def refine(flat: np.ndarray, starts: np.ndarray, groups: np.ndarray, prefix: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the suffixes that equal another one of their group in `length` elements.

    One round per token: the suffixes still tied are sorted by it.
    """
    tied, group, size = np.arange(len(starts)), groups, max(1, length // 8)
    for token in range(0, length, size):
        begin = starts[tied] + token
        value = span_hash(prefix, begin, begin + min(size, length - token))
        order = np.lexsort((value, group))
        tied, group, value = tied[order], group[order], value[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])] if len(tied) else np.zeros(0, bool)
        group = np.cumsum(fresh)
        keep = np.bincount(group)[group] > 1 if len(group) else fresh
        tied, group = tied[keep], group[keep]
    return tied


def _equal_windows(batch: dict[str, np.ndarray], bodies: list[bytes], length: int, words: bool) -> Iterator[tuple[int, int, int]]:
    """(uid, first, last) of the runs of repeated windows among whole groups of anchors.

    Equal windows have the same distance from their anchor, so the distances are
    gone through in steps of bounded size.
    """
    flat = np.frombuffer(b"".join(bodies), np.uint64 if words else np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // flat.itemsize
    offset = np.cumsum(sizes) - sizes
    prefix = prefix_hash(flat)
    high, low = batch["lead"], batch["lead"] - (batch["last"] - batch["first"])
    step = max(1, STEP_WINDOWS // len(bodies))
    found_entry, found_place = [], []
    for near in range(int(low.min()), int(high.max()) + 1, step):
        # windows whose distance from the anchor is in [near, near + step)
        head = np.maximum(high - (near + step - 1), 0)
        tail = np.minimum(high - near, high - low)
        count = np.maximum(tail - head + 1, 0)
        entry = np.repeat(np.arange(len(bodies)), count)
        place = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(count.sum())
        # grouped by anchor and distance, which a hash of both tells
        group = mix(batch["gram"][entry].view(np.uint64) + (high[entry] - place).astype(np.uint64))
        hit = refine(flat, offset[entry] + place, group, prefix, length)
        found_entry.append(entry[hit])
        found_place.append(place[hit])
    entry, place = np.concatenate(found_entry), np.concatenate(found_place)
    order = np.lexsort((place, entry))
    entry, place = entry[order], place[order]
    if not len(entry):
        return
    heads = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (place[1:] != place[:-1] + 1)])
    tails = np.r_[heads[1:], len(entry)] - 1
    for a, b in zip(heads, tails):
        e = entry[a]
        yield int(batch["uid"][e]), int(batch["first"][e] + place[a]), int(batch["first"][e] + place[b])


def _cut_bodies(wanted: DataFrame, data: DataFrame, length: int, words: bool) -> DataFrame:
    """The elements of the wanted runs, from their texts."""
    rows = wanted.groupBy("uid").agg(F.collect_list(F.struct("gram", "first", "last", "lead")).alias("runs")).join(data, "uid").select("uid", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                body, uid = elements(batch.column(1)[row].as_buffer().to_pybytes(), words), batch.column(0)[row].as_py()
                runs = batch.column(2)[row].as_py()
                yield pa.record_batch(
                    [pa.array([r["gram"] for r in runs]), pa.array([uid] * len(runs)), *(pa.array([r[k] for r in runs], pa.int32()) for k in ("first", "last", "lead")),
                     pa.array([body[r["first"] : r["last"] + length].tobytes() for r in runs], pa.binary())],
                    ["gram", "uid", "first", "last", "lead", "body"],
                )

    return rows.mapInArrow(tidy(run), "gram long, uid long, first int, last int, lead int, body binary")


def _sorted_suffixes(bodies: DataFrame, parts: int, length: int, words: bool) -> DataFrame:
    """Range-partitions the suffixes by their leading token and finds repeats in each partition."""
    ranged = bodies.repartitionByRange(parts, "gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            columns = {n: table[n].to_numpy().astype(np.int64) for n in ("gram", "uid", "first", "last", "lead")}
            rows = list(_equal_windows(columns, table["body"].to_pylist(), length, words))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["uid", "first", "last"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size > 2 << 20:
                table = pa.concat_tables(held)
                grams = table["gram"].to_numpy()
                cut = int(np.searchsorted(grams, grams[-1], "left"))
                if cut:
                    yield work(table.slice(0, cut))
                    held = [table.slice(cut)]
                    size = held[0].nbytes
        if held and sum(t.num_rows for t in held):
            yield work(pa.concat_tables(held))

    return ranged.mapInArrow(tidy(run), "uid long, first int, last int")


def row_id(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text)


def repeated_windows(data: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """Runs of starts (uid, first, last) whose `length` elements also start elsewhere; data has uid and text.

    The runs are written, so the texts that were shuffled for them are off the
    disk when the next ones are.
    """
    space = Workspace(data.sparkSession)
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies are combined before the one shuffle of the anchors, so a gram gets a
    # row for each stretch and COMBINE anchors; an anchor with a single stretch
    # has nothing else to meet
    anchors = _anchors(data, length, words).repartition(parts, "gram")
    gram, stretch = Window.partitionBy("gram"), Window.partitionBy("gram", "span")
    marked = anchors.withColumns({
        "whole": F.sum("n").over(stretch) != 1,
        "several": F.min("span").over(gram) < F.max("span").over(gram),
        "place": F.row_number().over(stretch.orderBy("uid", "first")),
    }).select("gram", "uid", "first", "last", "lead", "whole", (F.col("several") & (F.col("n") > 0) & (F.col("place") == 1)).alias("wanted"))
    marked = space.keep(marked.filter("whole OR wanted"), "anchors")
    bodies = _cut_bodies(marked.filter("wanted").select("gram", "uid", "first", "last", "lead"), data, length, words)
    found = space.keep(marked.filter("whole").select("uid", "first", "last").unionByName(_sorted_suffixes(bodies, parts, length, words)), "repeats")
    space.clear(found)
    return found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans [start, end) that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def spans_of(text: bytes, runs: list[dict] | None, words: int = 0) -> list[tuple[int, int]]:
    """Maximal byte spans of a text that its runs of windows cover, in bytes or in words."""
    spans = [(r["first"], r["last"] + LENGTH) for r in runs or [] if not r["words"]]
    if counted := [r for r in runs or [] if r["words"]]:
        starts, ends = word_spans(np.frombuffer(text, np.uint8), SPACE)
        spans += [(int(starts[r["first"]]), int(ends[r["last"] + words - 1])) for r in counted]
    return merge_spans(spans)


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def _with_runs(docs: DataFrame, key: str, text: str, words: int = 0) -> DataFrame:
    """All columns of docs, and last the runs of each row's repeated windows; the texts without any are not shuffled."""
    uid = row_id(docs[key], docs[text])
    data = docs.select(uid.alias("uid"), docs[text].alias("text"))
    mine, held = "_uid", "_runs"
    while mine in docs.columns or held in docs.columns:
        mine, held = f"_{mine}", f"_{held}"
    found = repeated_windows(data.filter(F.octet_length("text") >= LENGTH)).withColumn("words", F.lit(False))
    if words:
        # so many words and the blanks between them
        counted = repeated_windows(data.filter(F.octet_length("text") >= 2 * words - 1), words, True)
        found = found.unionByName(counted.withColumn("words", F.lit(True)))
    runs = found.distinct().groupBy(F.struct("uid").alias("k")).agg(F.collect_list(F.struct("first", "last", "words")).alias(held)).select(F.col("k.uid").alias(mine), held)
    some, rest = maybe_among(docs.withColumn(mine, uid), F.col(mine), found.select("uid"))
    return some.join(runs, mine, "left").drop(mine).unionByName(rest.drop(mine).withColumn(held, F.lit(None).cast(runs.schema[held].dataType)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Null and empty texts have 0 bytes; the copy of a row counts as another text,
    so both lose what they share. With `words`, three columns follow that leave
    those before them as they are: n_words, the n_passage_words of them covered
    by a run of that many words which also starts anywhere else, however short
    in bytes, and n_passages, the maximal runs of such words.
    """
    rows = _with_runs(pair(docs, key, text), "doc_id", "text", words).select("doc_id", "text", "_runs")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_words", "n_passage_words", "n_passages"] * bool(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                buffer, runs = batch.column(1)[row].as_buffer(), batch.column(2)[row].as_py() or []
                body = b"" if buffer is None else buffer.to_pybytes()
                spans = spans_of(body, [r for r in runs if not r["words"]])
                digest = [len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut_out(body, spans)).hexdigest()]
                if words:
                    passages = merge_spans([(r["first"], r["last"] + words) for r in runs if r["words"]])
                    digest += [len(body.split()), sum(b - a for a, b in passages), len(passages)]
                out.append(digest)
            yield pa.record_batch([batch.column(0), *(pa.array([o[k] for o in out], pa.string() if n == "kept_sha256" else pa.int64()) for k, n in enumerate(names[1:]))], names)

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names[1:]))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """The documents without the repeated bytes, all their columns kept.

    With `words`, equal runs of that many words or more go as well, however
    short in bytes; words are parted by blanks and compared exactly. Bytes of a character that is only partly left are dropped with it.
    """
    rows = _with_runs(docs, key, text, words)
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in range(batch.num_rows):
                buffer, runs = batch.column(place)[row].as_buffer(), batch.column(batch.num_columns - 1)[row].as_py()
                body = None if buffer is None else buffer.to_pybytes()
                texts.append(None if body is None else cut_out(body, spans_of(body, runs, words)).decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(len(schema))]
            yield pa.record_batch(columns, schema.names)

    return rows.mapInArrow(tidy(run), schema)
