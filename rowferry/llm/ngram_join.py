"""Exact Jaccard join of documents as sets of word n-grams.

The universe of shingles is cut into segments by a hash. Two sets of similarity
t differ in at most H shingles, so of more than H segments at least one is the
same in both. Sets are dealt into size bands; a band has H + 1 segments and some
spare ones, and each set is entered under the hash of its part in every segment,
for its own bands and those of its smaller partners.

Costs decide which segments count: an empty part costs most and is never used,
and a part that more than `GROUP` unlinked classes share is passed over as long
as enough others are left (a skipped segment may hide one difference less). Sets
for which too few are left are entered once more with the one-deletion
neighbourhoods of their parts, where a segment counts for two differences, and
those that still lack segments are compared by their rarest single shingles, or,
where many documents hold these, by all their common shingles as one set. So no
pair is lost. Candidates are verified on the whole sets of 64-bit shingle hashes.

Large groups of near copies do not become pairs: each member is first held
against one partner; afterwards only members of different components are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import pair
from rowferry.llm.flat import doc_of, mix, pieces, planes, tidy, unplanes, word_hashes
from rowferry.llm.shared import Workspace, components, maybe_among

SIZE = 5
SHARE = 75  # percent
RATIO = 1.75
GROUP = 32
# documents that may meet under one shingle; links by shingles of more come from sets of them
OFTEN = 64
# sets of common shingles on each side of a tile
TILE = 512
# cells of the table of how many documents hold a shingle, a byte each, broadcast
CELLS = 1 << 24
CELL_BLOCK = 1 << 18
# signatures that a task holds before it writes them
FLUSH = 500_000
# parts of a partition that are sorted one after the other
SLICES = 16
# low bytes of a signature of a part that are shuffled: equal ones are candidates
# only; signatures of whole sets, which stand for the set, go whole
SIG_BYTES = 6
WHOLE = 62
RUNS = "gid long, doc long, pivot long, band int, mult long"


def bands(upto: int) -> list[tuple[int, int, int, int]]:
    """(least size, most size, most size of a larger partner, H) of each band."""
    out, low = [], 1
    while low <= upto:
        high = max(low, int(low * RATIO) - 1)
        larger = high * 100 // SHARE
        # 100 * common >= SHARE * (sum - common) bounds the difference by sum * (100 - SHARE) / (100 + SHARE)
        out.append((low, high, larger, (high + larger) * (100 - SHARE) // (100 + SHARE)))
        low = high + 1
    return out


def segments(h: int) -> int:
    """Segments of a band: one more than the differences, and spare ones."""
    return 1 if h == 0 else h + 1 + 2 + (h + 1) // 5


def needed(size, high: int):
    """Segments that must count for a set of this size, or sets of these sizes: its own H and one."""
    partner = np.where(size <= high, size * 100 // SHARE, high)
    return (size + partner) * (100 - SHARE) // (100 + SHARE) + 1


def shingles(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The set of each text: sorted hashes of its distinct word n-grams.

    Fewer words than `size` make one shingle; no words make none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    if not len(words):
        return [words] * len(texts)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    out = []
    for first, count in zip(bounds[:-1], counts):
        if count >= size:
            out.append(np.unique(rolled[first : first + count - size + 1]))
        elif count:
            part = words[first : first + count] * factors[:count]
            out.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(count)], np.uint64)))
        else:
            out.append(words[:0])
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums for each set, none of them empty, that tell sets apart."""
    items, firsts = np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets[:-1])])
    return np.stack([np.add.reduceat(mix(x), firsts) for x in (items, items ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)


def placed(items: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and value of each shingle in a band."""
    value = mix(items + np.uint64((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    place = ((value >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    return place, mix(value)


def parts(items: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment and value of each shingle in a band, and value and size of each segment."""
    place, value = placed(items, band, count)
    total = np.zeros(count, np.uint64)
    np.add.at(total, place, value)
    return place, value, total, np.bincount(place, minlength=count)


def in_bands(sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All sets of each band: band, its most size, their places in the list, their shingles
    in one array with the row of each, and its number of segments.

    A table of sets by segments is smaller than the shingles it is made of.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    for band, (low, high, larger, h) in enumerate(bands(int(sizes.max(initial=0)))):
        mine = np.flatnonzero((sizes >= low) & (sizes <= larger))
        if len(mine):
            yield band, high, mine, np.concatenate([sets[k] for k in mine]), np.repeat(np.arange(len(mine)), sizes[mine]), segments(h)


def keyed(total: np.ndarray, place: np.ndarray, band: int) -> np.ndarray:
    """Signatures; the lowest six bits hold the band."""
    return mix(total + mix(place.astype(np.uint64) + np.uint64(band << 40))) & ~np.uint64(63) | np.uint64(band)


def by_segments(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each band: the band, signatures of all sets in it, the place of the set of each, and the sets with too few filled parts."""
    for band, high, mine, items, row, count in in_bands(sets):
        place, value = placed(items, band, count)
        total = np.zeros(len(mine) * count, np.uint64)
        np.add.at(total, row * count + place, value)
        sizes = np.bincount(row * count + place, minlength=len(total))
        filled = np.flatnonzero(sizes)
        held = np.bincount(filled // count, minlength=len(mine))
        short = held < needed(np.bincount(row, minlength=len(mine)), high)
        yield band, keyed(total[filled], filled % count, band), mine[filled // count], mine[short]


def by_deletions(items: np.ndarray, wanted: set[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Signatures of each part of a set and of the part without one shingle."""
    size = len(items)
    for band, (low, high, larger, h) in enumerate(bands(size)):
        if band in wanted and low <= size <= larger:
            place, value, total, sizes = parts(items, band, segments(h))
            filled = np.flatnonzero(sizes)
            inner = sizes[place] > 1
            less = keyed(total[place[inner]] - value[inner], place[inner], band)
            room = 2 * int((sizes > 1).sum()) + int((sizes == 1).sum())
            yield np.r_[keyed(total[filled], filled, band), less], band if room < needed(size, high) else -1


def marks_of(keys: np.ndarray, band: int) -> np.ndarray:
    """Signatures that stand for documents, not for parts: band 63."""
    return mix((keys * 64 + band).view(np.uint64)) & ~np.uint64(63) | np.uint64(63)


def _entries(data: DataFrame, count: int, deletions: bool) -> DataFrame:
    """Rows (part, sigs, docs): packed signatures and their documents, by part.

    Copies of a set within one flush are entered once, under a common signature
    of the whole set that links them. A document whose parts do not suffice is
    entered as its own mark (signature 63 in the band bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, held, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            part = (sig >> np.uint64(6)) % np.uint64(count)
            # signatures of whole sets in rows of their own, all their bytes
            whole = (sig & np.uint64(63)) == WHOLE
            order = np.lexsort((sig, whole, part))
            sig, doc, part, whole = sig[order], doc[order], part[order], whole[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(part.view(np.int64) * 2 + whole)) + 1, len(part)]
            rows = [(int(part[a]), planes(sig[a:b], 8 if whole[a] else SIG_BYTES), planes(doc[a:b].view(np.uint64), 8)) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "sigs", "docs"])

        for batch in batches:
            bands_of, row = batch.column(2) if deletions else None, 0
            for ids, texts in pieces(iter([batch])):
                sets, keys = shingles(texts), ids.to_numpy()
                wanted = bands_of.slice(row, len(keys)).to_pylist() if deletions else None
                row += len(keys)
                some = [k for k, items in enumerate(sets) if len(items)]
                if not some:
                    continue
                sums = digests([sets[k] for k in some])
                names = [(len(sets[k]), *pair) for k, pair in zip(some, sums.tolist())]
                fresh = []
                for k, name in zip(some, names):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(k)
                here, owners = [mix(sums[:, 0] ^ sums[:, 1]) & ~np.uint64(63) | np.uint64(WHOLE)], [keys[some]]
                if deletions:
                    for k in fresh:
                        for sig, short in by_deletions(sets[k], set(wanted[k])):
                            here.append(sig)
                            owners.append(np.full(len(sig), keys[k]))
                            if short >= 0:
                                here.append(marks_of(keys[k : k + 1], short))
                                owners.append(keys[k : k + 1])
                elif fresh:
                    mine = keys[fresh]
                    for band, sig, at, short in by_segments([sets[k] for k in fresh]):
                        here += [sig, marks_of(mine[short], band)]
                        owners += [mine[at], mine[short]]
                sigs.append(np.concatenate(here))
                docs.append(np.concatenate(owners))
                held += len(sigs[-1])
                if held > FLUSH:
                    yield from flush()
                    sigs, docs, held, seen = [], [], 0, set()
        if held:
            yield from flush()

    return data.mapInArrow(tidy(run), "part int, sigs binary, docs binary")


def _runs(entries: DataFrame, count: int) -> DataFrame:
    """Groups of documents with a common signature: gid, doc, pivot, band, mult.

    Groups of the same members count once, with their number in `mult`. Marks
    come through with pivot = doc, band 63 and mult 0. A task holds one part of
    its partition at a time.
    """

    def groups(sigs: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]
        sig, doc = sig[fresh], doc[fresh]
        firsts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[firsts, len(sig)])
        band = (sig[firsts] & np.uint64(63)).astype(np.int32)
        gid = mix(np.add.reduceat(mix(doc.view(np.uint64)), firsts) + mix(band.astype(np.uint64))).view(np.int64)
        good = np.flatnonzero((sizes > 1) | (band == 63))
        _, index, mult = np.unique(gid[good], return_index=True, return_counts=True)
        good = good[index]
        lengths = sizes[good]
        places = np.repeat(firsts[good] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        again = lambda x: np.repeat(x, lengths)
        for a in range(0, len(places), 100_000):
            cut = slice(a, a + 100_000)
            yield pa.record_batch(
                [pa.array(again(gid[good])[cut]), pa.array(doc[places][cut]), pa.array(again(doc[firsts[good]])[cut]), pa.array(again(band[good])[cut]), pa.array(again(np.where(band[good] == 63, 0, mult))[cut])],
                ["gid", "doc", "pivot", "band", "mult"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, now = [], [], None
        for batch in batches:
            for part, sig, doc in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != now and sigs:
                    yield from groups(sigs, docs)
                    sigs, docs = [], []
                now, sig, doc = part, sig.as_py(), doc.as_py()
                sigs.append(unplanes(sig, 8 * len(sig) // len(doc)))
                docs.append(unplanes(doc, 8).view(np.int64))
        if sigs:
            yield from groups(sigs, docs)

    return entries.repartition(count, "part").sortWithinPartitions("part").mapInArrow(tidy(run), RUNS)


def members(data: DataFrame, count: int, deletions: bool = False) -> DataFrame:
    """All groups of a scheme, equal ones of different tasks together."""
    return _runs(_entries(data, count * SLICES, deletions), count).groupBy("gid", "doc", "band").agg(F.min("pivot").alias("pivot"), F.sum("mult").alias("mult"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole texts."""
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b"
    ).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                left, right = (shingles([(t or "").encode() for t in part.column(c).to_pylist()]) for c in (2, 3))
                keep = []
                for x, y in zip(left, right):
                    common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                    keep.append(common > 0 and 100 * common >= SHARE * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def _mixed(space: Workspace, groups: DataFrame, comps: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Members of the groups of several components, with their component and the number (classes) of these.

    Written once, as are the members of all groups, since several jobs start from
    them. With `shapes` also n, and filled and own of the group's band.
    """
    named = groups.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    if shapes is not None:
        brief = shapes.select("doc", "n", F.transform("bands", lambda x: F.struct(x.band.alias("band"), x.filled.alias("filled"), x.own.alias("own"))).alias("all"))
        named = named.join(brief, "doc").withColumn("x", F.get(F.filter("all", lambda x: x.band == F.col("band")), F.lit(0)))
        named = named.select(*groups.columns, "comp", "n", F.col("x.filled").alias("filled"), F.col("x.own").alias("own"))
    named = space.keep(named, "named")
    counts = named.select("gid", "comp").distinct().groupBy(F.struct("gid").alias("k")).agg(F.count("*").alias("classes")).select("k.gid", "classes")
    return space.keep(named.join(counts.filter("classes > 1"), "gid"), "mixed")


def _cross_pairs(mixed: DataFrame, limit: int | None) -> DataFrame:
    """Pairs (a, b) within a group of at most so many components and across these."""
    side = mixed.filter(f"classes <= {limit}") if limit else mixed
    left = side.select("gid", F.col("doc").alias("a"), F.col("comp").alias("ca"))
    right = side.select("gid", F.col("doc").alias("b"), F.col("comp").alias("cb"))
    return left.join(right, "gid").filter("ca < cb").select("a", "b").distinct()


def _near_pairs(space: Workspace, mixed: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs (a, b, band) across components whose sizes and number of common parts allow a link.

    They are taken in the band of the smaller set's size: there similar sets meet.
    Similar sets differ in H parts at most, so all other filled parts are in
    common, in those counted or in those passed over (`hot`).
    """
    # a key with several texts has the bands of its largest set alone
    side = mixed.filter(f"classes <= {GROUP} AND filled IS NOT NULL").join(hot.withColumnRenamed("mult", "hot"), ["doc", "band"], "left").fillna(0, ["hot"])
    side = space.keep(side.drop("classes"), "sides")
    left, right = (
        side.select("gid", F.col("doc").alias(doc), *(F.col(c).alias(f"{c}_{doc}") for c in ("comp", "n", "filled", "own", "hot")), *more)
        for doc, more in (("a", ("band", "mult")), ("b", ()))
    )
    met = left.join(right, "gid").filter(f"comp_a < comp_b AND own_a + own_b > 0 AND 100 * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)")
    differing = F.floor((F.col("n_a") + F.col("n_b")) * (100 - SHARE) / (100 + SHARE))
    least = F.greatest("filled_a", "filled_b") - differing - F.least("hot_a", "hot_b")
    # the bound is the same for all rows of a pair and band
    counted = met.select("a", "b", "band", "mult", least.alias("least")).groupBy("a", "b", "band").agg(F.sum("mult").alias("common"), F.min("least").alias("least"))
    return counted.filter("common >= least").select("a", "b", "band")


def set_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_shingles of every row."""
    data = pair(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches):
            yield pa.record_batch([keys, pa.array([len(s) for s in shingles(texts)], pa.int64())], ["doc_id", "n_shingles"])

    return data.mapInArrow(tidy(run), "doc_id long, n_shingles long")


def cells_of(items: np.ndarray, row: np.ndarray, rows: int, high: int) -> np.ndarray:
    """How many shingles of each row fall into each cell of a hash, up to 255; about a cell for four shingles."""
    count = min(max(high // 4, 32), 1 << 16)
    place = (mix(items ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(count)).astype(np.int64)
    return np.minimum(np.bincount(row * count + place, minlength=rows * count), 255).astype(np.uint8).reshape(rows, count)


def _shapes(data: DataFrame) -> DataFrame:
    """doc, n and for each of its bands: filled parts, those of several shingles, parts needed, whether it is
    the band of its own size, cells."""
    whole = ("band", "filled", "several", "need", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches):
            sets = shingles(texts)
            size = np.array([len(x) for x in sets], np.int64)
            at, found, cells = [], {c: [] for c in whole}, []
            for band, high, mine, items, row, count in in_bands(sets):
                place, _ = placed(items, band, count)
                sizes = np.bincount(row * count + place, minlength=len(mine) * count).reshape(len(mine), count)
                at.append(mine)
                values = (np.full(len(mine), band), (sizes > 0).sum(1), (sizes > 1).sum(1), needed(size[mine], high), size[mine] <= high)
                for name, value in zip(whole, values):
                    found[name].append(value)
                cells += [x.tobytes() for x in cells_of(items, row, len(mine), high)]
            doc = np.concatenate([*at, np.zeros(0, np.int64)])
            order = np.argsort(doc, kind="stable")
            columns = [pa.array(np.concatenate([*found[c], np.zeros(0, np.int64)])[order].astype(np.int32), pa.int32()) for c in whole]
            rows = pa.StructArray.from_arrays([*columns, pa.array([cells[k] for k in order], pa.binary())], [*whole, "cells"])
            offsets = np.searchsorted(doc[order], np.arange(len(sets) + 1)).astype(np.int32)
            yield pa.record_batch([keys, pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["doc", "n", "bands"])

    kind = ",".join(f"{c}:int" for c in whole)
    return data.select("doc", "text").mapInArrow(tidy(run), f"doc long, n long, bands array<struct<{kind},cells:binary>>")


def _possible(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs (a, b, or also band) that may be similar enough, as (a, b).

    Their sizes must allow it, and so must the cells: sets differ at least by the
    sum of the differences of their cells.
    """
    sides = shapes.select("doc", "n", F.explode("bands").alias("x")).select("doc", "n", "x.band", "x.own", "x.cells")
    for name in ("a", "b"):
        # a pair without a band meets all bands that both sets have
        keys = [name, "band"] if "band" in pairs.columns else [name]
        pairs = pairs.join(sides.select("band", F.col("doc").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "own", "cells"))), keys)
    # similar sets meet in the band of the smaller one's size
    pairs = pairs.filter("own_a + own_b > 0").filter(100 * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - SHARE) // (100 + SHARE)
            x, y = batch.column(4), batch.column(5)
            keep = [
                int(np.abs(np.frombuffer(x[k].as_buffer(), np.uint8).astype(np.int16) - np.frombuffer(y[k].as_buffer(), np.uint8)).sum()) <= most[k]
                for k in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(tidy(run), "a long, b long").distinct()


def _lacking(shapes: DataFrame, hot: DataFrame, deletions: bool) -> DataFrame:
    """(doc, bands) for which the parts not passed over do not suffice; hot: doc, band, mult."""
    rows = shapes.select("doc", F.explode("bands").alias("x")).select("doc", "x.*").join(hot, ["doc", "band"])
    room = F.col("filled") + F.col("several") - 2 * F.col("mult") if deletions else F.col("filled") - F.col("mult")
    return rows.filter(room < F.col("need")).groupBy("doc").agg(F.collect_list("band").alias("bands"))


def _cell(items: np.ndarray) -> np.ndarray:
    return (items % np.uint64(CELLS)).astype(np.int64)


def grade(held: np.ndarray) -> np.ndarray:
    """A byte that grows with a count: the count itself up to `OFTEN`, by powers of two beyond."""
    return np.where(held <= OFTEN, held, OFTEN + 1 + np.log2(np.maximum(held, 1) / OFTEN).astype(np.int64)).astype(np.uint8)


def _grades(texts: DataFrame) -> np.ndarray:
    """For each cell of a hash, how many times documents hold a shingle in it, graded.

    Tasks count before anything is written, and the table has one size for all
    inputs. A shingle is in its cell with others, so its grade is no less than
    its own count gives, and the same everywhere.
    """
    space = {"block": pa.int32(), "cells": pa.binary(), "held": pa.binary()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def flush() -> pa.RecordBatch:
            cell, held = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.r_[0, np.flatnonzero(np.diff(cell // CELL_BLOCK)) + 1, len(cell)]
            rows = [(int(cell[a]) // CELL_BLOCK, planes((cell[a:b] % CELL_BLOCK).view(np.uint64), 4), planes(held[a:b].astype(np.uint64), 4)) for a, b in zip(cuts, cuts[1:])]
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(space.values())], list(space))

        for _, data in pieces(batches):
            found += [_cell(items) for items in shingles(data) if len(items)]
            size = sum(map(len, found))
            if size > FLUSH:
                yield flush()
                found = []
        if found:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(CELL_BLOCK, np.int64)
        out = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([grade(held).tobytes()], pa.binary())], ["block", "grades"])
        for batch in batches:
            for block, cells, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != now:
                    if now is not None:
                        yield out()
                    now, held = block, np.zeros(CELL_BLOCK, np.int64)
                held[unplanes(cells, 4).view(np.int64)] += unplanes(counts, 4).view(np.int64)
        if now is not None:
            yield out()

    counted = texts.select("doc", "text").mapInArrow(tidy(count), "block int, cells binary, held binary")
    table = np.zeros(CELLS, np.uint8)
    # one row of fixed size for each block, 16 MB in all
    for row in counted.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(total), "block int, grades binary").toLocalIterator():
        table[row.block * CELL_BLOCK : (row.block + 1) * CELL_BLOCK] = np.frombuffer(row.grades, np.uint8)
    return table


def _need(n: Column) -> Column:
    """Least number of shingles in common with a similar set."""
    return F.ceil(n * SHARE / 100)


def _rare_and_common(texts: DataFrame) -> DataFrame:
    """(doc, n, rare, common): each document's rarest shingles, and its common ones, rarest first.

    All documents order shingles alike, by the grade of the cell and by value. Of
    n shingles a similar set lacks at most n - need, so of the need-th last and
    all before it, it has one; the first that both have is among these in both.
    If its cell holds more than `OFTEN`, all that the two share is common. Rare
    ones are given among those first ones alone, common ones where they are
    enough for a link.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_grades(texts))
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for keys, data in pieces(batches):
            sizes, rare, common = [], [], []
            for items in shingles(data):
                graded, value = table[_cell(items)], items.view(np.int64)
                order = np.lexsort((value, graded))
                graded, value = graded[order], value[order]
                need = -(-len(items) * SHARE // 100)
                first = int(np.searchsorted(graded, OFTEN, side="right"))
                sizes.append(len(items))
                rare.append(value[: min(first, len(items) - need + 1)])
                common.append(value[first:] if len(items) - first >= max(need, 1) else value[:0])
            yield pa.record_batch([keys, pa.array(sizes, pa.int64()), pa.array(rare, kind), pa.array(common, kind)], ["doc", "n", "rare", "common"])

    return texts.select("doc", "text").mapInArrow(tidy(run), "doc long, n long, rare array<long>, common array<long>")


def shared_counts(values: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """How many values each two of `count` rows share; a row holds a value once."""
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    # only values of several rows are a column of the table
    place = np.cumsum(held > 1) - 1
    several = held[column] > 1
    row, column = row[several], place[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((count, count), np.float32)
    for first in range(0, int((held > 1).sum()), 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        table = np.zeros((count, 2048), np.float32)
        table[row[a:b], column[a:b] - first] = 1
        out += table @ table.T
    return out.astype(np.int64)


def alike_sets(table: pa.Table) -> pa.Table:
    """Links among the sets of a tile: all of those with a set of several components, else a star.

    A row is (a, b, shared) of two sets, or of two documents with a null for shared.
    """
    h, doc, n, lo, hi = (table[c].to_numpy() for c in ("h", "doc", "n", "lo", "hi"))
    lists = table["common"].combine_chunks()
    shared = shared_counts(lists.flatten().to_numpy(), np.repeat(np.arange(len(h)), np.diff(lists.offsets.to_numpy())), len(h))
    alike = 100 * shared >= SHARE * (n[:, None] + n - shared)
    alike &= np.minimum(lo[:, None], lo) < np.maximum(hi[:, None], hi)
    np.fill_diagonal(alike, False)
    several = lo < hi
    x, y = np.nonzero(alike & (several[:, None] | several))
    alike[several] = alike[:, several] = False
    label, after = None, np.arange(len(h))
    while label is None or (label != after).any():
        label = after
        after = np.minimum(label, np.where(alike, label, len(h)).min(1, initial=len(h)))
        after = after[after]
    far = np.flatnonzero(label != np.arange(len(h)))
    return pa.table({
        "a": np.r_[h[x], doc[far]], "b": np.r_[h[y], doc[label[far]]],
        "shared": pa.array(np.r_[shared[x, y], np.zeros(len(far), np.int64)], mask=np.r_[np.zeros(len(x), bool), np.ones(len(far), bool)]),
    })


def _by_common(space: Workspace, common: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) that join all documents whose common shingles alone make them similar.

    With the same common shingles a smaller set is the closer one: if two
    documents are similar, each is so to the smallest with the common shingles of
    the other, and so are those two. Hence only the smallest of each component
    and set of common shingles is held against the smallest of every such set.

    Sets that share one of their first common shingles meet in tiles of about
    `TILE` by `TILE`, so a set is sent once for each tile and not for each pair.
    """
    named = common.join(comps, "doc", "left").select("n", "doc", "common", F.coalesce("comp", "doc").alias("comp"), F.xxhash64("common").alias("h"))
    member = F.min(F.struct("n", "doc"))
    reps = named.groupBy("h", "comp").agg(member.alias("rep"))
    sets = space.keep(named.groupBy("h").agg(member.alias("least"), F.first("common").alias("common"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "sets")
    # the common shingles of rarest order, one of which a similar set must have among its own
    heads = sets.select("h", "lo", "hi", F.explode(F.slice("common", F.lit(1), (F.size("common") - _need(F.col("least.n")) + 1).cast("int"))).alias("gid"))
    mixed = heads.groupBy(F.struct("gid").alias("k")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("held"))
    mixed = mixed.filter("lo < hi AND held > 1").select("k.gid", F.ceil(F.col("held") / TILE).cast("int").alias("blocks"))
    tiles = heads.select("h", "gid").join(mixed, "gid").withColumn("own", F.pmod(F.hash("h"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("h", "gid", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    met = tiles.join(sets.select("h", "least.doc", "least.n", "lo", "hi", "common"), "h")
    found = space.keep(met.groupBy("gid", "x", "y").applyInArrow(alike_sets, "a long, b long, shared long").distinct(), "alike")
    best = sets.select(F.col("h").alias("b"), F.col("least").alias("best"))
    tried = found.filter("shared IS NOT NULL").join(best, "b").select(F.col("a").alias("h"), "best", "shared").unionByName(
        sets.filter("lo < hi").select("h", F.col("least").alias("best"), F.size("common").cast("long").alias("shared"))
    )
    alike = 100 * F.col("shared") >= SHARE * (F.col("rep.n") + F.col("best.n") - F.col("shared"))
    return reps.join(tried, "h").filter(alike & (F.col("rep.doc") != F.col("best.doc"))).select(F.col("rep.doc").alias("a"), F.col("best.doc").alias("b")).unionByName(
        found.filter("shared IS NULL").select("a", "b")
    )


def _passed_over(mixed: DataFrame) -> DataFrame:
    """How many parts of each doc and band lie in groups of too many classes."""
    return mixed.filter(f"classes > {GROUP}").groupBy("doc", "band").agg(F.sum("mult").alias("mult"))


def _texts(data: DataFrame, pairs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The texts of all documents in the pairs, and of those in `more`.

    A bitmap keeps nearly all other texts out of the shuffle of the join, which
    decides.
    """
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    ids = ids.unionByName(more.select("doc")) if more is not None else ids
    some, _ = maybe_among(data, F.col("doc"), ids)
    # an inner join on distinct ids: a semi join would be moved below the bitmap
    return some.join(ids.select(F.struct("doc").alias("k")).distinct().select("k.doc"), "doc").select(*data.columns)


def _linked(space: Workspace, links: DataFrame, comps: DataFrame, pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with the pairs that prove similar; as they are if there is no pair."""
    if not pairs.limit(1).count():
        return links, comps
    links = space.keep(links.unionByName(verify(pairs, texts)), "near")
    return links, components(space, links)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, comp) of every document that is linked with another one.

    Keys are whole numbers; rows with a null key are not compared, and rows with
    the same key are one node. Texts without words are linked with nothing.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = pair(docs, key, text).filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "doc")
    groups = space.keep(members(data, count), "groups")
    # equal keys with several texts: the largest set stands for them
    shapes = space.keep(_shapes(data).groupBy("doc").agg(F.max_by("bands", "n").alias("bands"), F.max("n").alias("n")), "shapes")

    # each document against the partner with which it shares most signatures
    alike = groups.filter("doc <> pivot AND band = 62").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    first = groups.filter("doc <> pivot AND band < 62").groupBy("doc", "pivot").agg(F.sum("mult").alias("mult")).groupBy("doc").agg(
        F.max_by("pivot", F.struct("mult", -F.col("pivot"))).alias("b")
    ).select(F.col("doc").alias("a"), "b")
    first = space.keep(_possible(first.unionByName(alike).distinct(), shapes), "pairs")
    links = space.keep(verify(first, _texts(data, first)), "near")
    comps = components(space, links)

    shared = groups.filter("band < 62")
    marks = groups.filter("band = 63").select("doc").distinct()
    mixed = _mixed(space, shared, comps, shapes)
    hot = _passed_over(mixed)
    every = F.sequence(F.lit(0), F.lit(61))
    lacking = space.keep(_lacking(shapes, hot, False).unionByName(marks.select("doc", every.alias("bands"))).groupBy("doc").agg(
        F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands")
    ), "lacking")
    more = space.keep(_possible(_near_pairs(space, mixed, hot), shapes), "pairs")
    texts = space.keep(_texts(data, more, lacking), "texts")
    links, comps = _linked(space, links, comps, more, texts)
    if lacking.limit(1).count():
        rest = texts.join(lacking, "doc").select("doc", "text", "bands")
        deeper = space.keep(members(rest, 2 * count, True), "groups")
        mixed = _mixed(space, deeper.filter("band < 62"), comps)
        last = space.keep(_lacking(shapes, _passed_over(mixed), True).select("doc").unionByName(deeper.filter("band = 63").select("doc")).distinct(), "last")
        more = space.keep(_possible(_cross_pairs(mixed, GROUP), shapes), "pairs")
        links, comps = _linked(space, links, comps, more, texts)
        if last.limit(1).count():
            tokens = space.keep(_rare_and_common(space.keep(texts.join(last, "doc", "left_semi"), "texts")), "tokens")
            rare = tokens.select(F.explode("rare").alias("gid"), "doc").distinct()
            common = tokens.filter("size(common) > 0").select("doc", "n", "common")
            links = space.keep(links.unionByName(_by_common(space, common, comps)), "near")
            comps = components(space, links)
            mixed = _mixed(space, rare, comps)
            links, comps = _linked(space, links, comps, space.keep(_possible(_cross_pairs(mixed, None), shapes), "pairs"), texts)
    comps = space.keep(comps, "components")
    space.clear(comps)
    return comps


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row; a null key has a null component."""
    comps = similar(docs, key, text)
    return set_sizes(docs, key, text).join(comps.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of smallest doc_id; all columns kept."""
    name = "_gone"
    while name in docs.columns:
        name = f"_{name}"
    gone = similar(docs).filter("doc <> comp").select(F.col("doc").alias(name))
    some, rest = maybe_among(docs, docs["doc_id"], gone)
    # an outer join: an anti join would be moved below the bitmap, and shuffle all texts
    left = some.join(gone, F.col("doc_id") == F.col(name), "left").filter(F.col(name).isNull()).select(*docs.columns)
    return rest.unionByName(left)
