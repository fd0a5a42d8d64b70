"""A change stream with a ledger: every change once per target, with a delivery record.

How far the stream has come is a position vector, the highest position of each
log partition. A log whose partitions advance at different speeds may bring a
lower position of one partition after a higher one of another; neither is late.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowferry.config import Bridge
from rowferry.functions.literals import named, value_literal
from rowferry.operators.changes import (
    Vector,
    after_vector,
    element_wise_max,
    filter_change_ops,
    filter_changes,
    vector_ends,
)
from rowferry.operators.commit import SnapshotTable
from rowferry.operators.payload import payload_outbox
from rowferry.operators.row_index import numbered_ranges
from rowferry.session import shuffles_dropped
from rowferry.sources.relational import key_cuts
from rowferry.streaming.bridge import apply_to_targets, start_batches

LEDGER = "run_id string, sequence bigint, row_index bigint, row_count bigint, status string, attempts int, error string"
# rows of a batch that are numbered at once, and ranges at most: each reads the batch anew
ROWS_AT_ONCE, MOST_RANGES = 1_000_000, 8


@dataclass(frozen=True)
class Entry:
    """One recorded batch: its sequences [start, end) and the vector after it."""

    name: str
    start: int = 0
    end: int = 0
    vector: Vector = field(default_factory=dict)
    note: str | None = None


class StreamLedger:
    """Deliveries of a stream in a shared folder, one data folder per batch.

    Next to them lie the entries of the last two batches. Spark repeats only the
    last batch, which finds the entry before it and so gets the same sequences.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str) -> None:
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id

    def _place(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())  # noqa: SLF001

    def entries(self) -> list[Entry]:
        """The entries that are kept, oldest first."""
        folder, fs = self._place("_entries")
        if not fs.exists(folder):
            return []
        io, found = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils, []  # noqa: SLF001
        for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
            if name.endswith(".json"):
                stream = fs.open(self._place(f"_entries/{name}")[0])
                try:
                    found.append(Entry(**json.loads(io.toString(stream, "UTF-8"))))
                finally:
                    stream.close()
        return found

    def commit(self, entry: Entry) -> None:
        """Add an entry, or replace the one of the same batch."""
        held = self.entries()
        number = next((k for k, e in enumerate(held) if e.name == entry.name), None)
        first = self._first_number()
        place = first + (len(held) if number is None else number)
        draft, fs = self._place(f"_entries/{place:012d}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(asdict(entry), default=int).encode()))
        finally:
            stream.close()
        path, _ = self._place(f"_entries/{place:012d}.json")
        fs.delete(path, False)
        fs.rename(draft, path)
        for old in range(first, place - 1):
            fs.delete(self._place(f"_entries/{old:012d}.json")[0], False)

    def _first_number(self) -> int:
        folder, fs = self._place("_entries")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return min((int(n[:12]) for n in names if n.endswith(".json")), default=0)

    def before(self, name: str) -> Entry:
        """The entry that a batch goes on from, the same if it comes again."""
        held = self.entries()
        at = next((k for k, e in enumerate(held) if e.name == name), len(held))
        return held[at - 1] if at else Entry("")

    def write(self, name: str, part: str, rows: DataFrame) -> None:
        with shuffles_dropped(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{part}/batch={name}")

    def read(self, part: str = "deliveries", schema: str = LEDGER) -> DataFrame | None:
        """All deliveries, or the captured changes or the outbox, of the stream."""
        folder, fs = self._place(part)
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema) if part == "deliveries" else None
        return self.spark.read.parquet(f"{self.path}/{part}").drop("batch")


def prepare_start(ledger: StreamLedger, log: DataFrame, order: Sequence[str], partition: str | None, start: str = "beginning") -> Entry:
    """Set where a stream begins, before its first batch; returns the last entry.

    A new stream begins with the log, or from now: behind its end at this
    moment. A stream that resumes goes on from its vector. If the log of a
    partition no longer reaches back to it, changes are lost: the stream begins
    again from now, and the entry says so.
    """
    held = ledger.entries()
    if not held:
        entry = Entry("start", vector=vector_ends(log, order, partition) if start == "now" else {})
        ledger.commit(entry)
        return entry
    last = held[-1]
    oldest = vector_ends(log, order, partition, lowest=True)
    lost = sorted(p for p, place in last.vector.items() if p in oldest and oldest[p] > place)
    if not lost:
        return last
    now = element_wise_max(last.vector, vector_ends(log, order, partition))
    entry = Entry(f"gap-{last.name}", last.end, last.end, now, f"history lost: {', '.join(lost)}")
    ledger.commit(entry)
    return entry


def place_ranges(changes: DataFrame, place: Sequence[str], rows_at_once: int | None = None) -> list[Column]:
    """Conditions that cut changes into ranges of places, ascending; each change meets one.

    They hold about ``rows_at_once`` rows, or an even share if that makes too many.
    """
    rows = changes.count()
    parts = min(-(-rows // (rows_at_once or ROWS_AT_ONCE)), MOST_RANGES)
    if parts < 2:
        return [F.lit(True)]
    at = F.struct(*[named(c) for c in place])
    cuts = [
        F.struct(*[value_literal(v).cast(changes.schema[c].dataType).alias(c) for c, v in zip(place, cut)])
        for cut in key_cuts(changes.select(at.alias("place")), "place", parts, rows=rows)
    ]
    # structs compare field by field with NULL first, as the places are sorted
    return [
        (at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True))
        for low, high in zip([None, *cuts], [*cuts, None])
    ]


def deliver_changes(
    changes: DataFrame,
    bridge: Bridge,
    tables: Mapping[str, SnapshotTable],
    order: Sequence[str],
    ledger: StreamLedger,
    name: str,
    partition: str | None = None,
    always_new: bool = False,
    now: str = "",
) -> dict[str, str | None]:
    """Deliver and record one batch of changes; the error of each target.

    The batch's new changes, each position once, are numbered in log order and
    written down, so targets and ledger see the same ones. A failed delivery is
    recorded with its changes, and the vector moves on; `resend_failed` applies
    them later. A payload bridge gets an outbox instead of table writes.
    ``always_new`` is for sources without positions, where only the name of the
    batch tells a repeat.
    """
    before = ledger.before(name)
    fresh = filter_changes(filter_change_ops(changes, bridge.operations), bridge.filters)
    place = [*([partition] if partition else []), *order]
    if not always_new:
        fresh = after_vector(fresh, order, partition, before.vector)
    size = bridge.delivery.batch_size
    with numbered_ranges(fresh, place_ranges(fresh, place), place, not always_new, before.end) as (numbered, count):
        rows = numbered.withColumn("sequence", F.expr(f"row_index div {size}"))
        vector = element_wise_max(before.vector, {} if always_new else vector_ends(rows, order, partition))
        errors: dict[str, str | None] = {}
        if bridge.payload is not None:
            body = rows.drop("sequence", "row_index", *order, *([partition] if partition else []))
            outbox = payload_outbox(rows.select(*body.columns, "row_index", "sequence"), bridge.payload, bridge.source, now, ledger.run_id, bridge.primary_key)
            ledger.write(name, "outbox", outbox)
            status = "queued"
        else:
            # the vector has settled what is new: the target keeps one of its own for changes it missed
            errors = apply_to_targets(bridge, rows.drop("sequence", "row_index"), tables, order, f"{ledger.run_id}:{name}", always_new, partition)
            status = "failed" if any(errors.values()) else "success"
        error = next((f"{label}: {text}" for label, text in errors.items() if text), None)
        ledger.write(
            name,
            "deliveries",
            rows.groupBy("sequence")
            .agg(F.min("row_index").alias("row_index"), F.count("*").alias("row_count"))
            .select(
                F.lit(ledger.run_id).alias("run_id"), "sequence", "row_index", "row_count",
                F.lit(status).alias("status"), F.lit(1).alias("attempts"), F.lit(error).cast("string").alias("error"),
            ),
        )
        if status == "failed":
            ledger.write(name, "captured", rows.withColumn("run_id", F.lit(ledger.run_id)))
    # deliveries begin at a sequence of their own, so a batch that ends within one leaves it
    end = before.end + -(-count // size) * size
    ledger.commit(Entry(name, before.end, end, vector))
    return errors


def start_pipeline(
    stream: DataFrame,
    bridge: Bridge,
    tables: Mapping[str, SnapshotTable],
    order: Sequence[str],
    checkpoint: str,
    ledger: StreamLedger,
    partition: str | None = None,
    normalize: Callable[[DataFrame], DataFrame] | None = None,
    always_new: bool = False,
    log: DataFrame | None = None,
    start: str = "beginning",
    once: bool = True,
) -> StreamingQuery:
    """Keep the targets of a bridge in step with a change stream and record every delivery.

    ``log`` is the log as it stands; with it the start and the gap check come
    before the first batch. With ``on_error`` abort a failed batch stops the
    query, and comes again when it is restarted.
    """
    if log is not None:
        prepare_start(ledger, log, order, partition, start)
    # another checkpoint counts its batches anew
    token = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = normalize(batch) if normalize else batch
        errors = deliver_changes(changes, bridge, tables, order, ledger, f"{token}-{batch_id:012d}", partition, always_new)
        failed = {label: error for label, error in errors.items() if error}
        if failed and bridge.delivery.on_error == "abort":
            raise RuntimeError(f"targets failed: {failed}")

    return start_batches(stream, apply, checkpoint, once)
