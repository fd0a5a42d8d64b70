"""Change feeds as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rowferry.config import OPERATIONS, Bridge, ColumnMapping
from rowferry.operators.changes import (
    after_position,
    after_vector,
    dedupe_positions,
    filter_change_ops,
    filter_changes,
    vector_ends,
)
from rowferry.operators.commit import WRITE_ERRORS, SnapshotTable
from rowferry.operators.merge import (
    apply_changes_append,
    apply_last_changes,
    last_per_key,
    split_null_keys,
)
from rowferry.operators.projection import map_columns
from rowferry.session import frozen


def apply_batch(
    changes: DataFrame,
    table: SnapshotTable,
    order: Sequence[str],
    batch_id: str,
    operations: Sequence[str] = OPERATIONS,
    write_mode: str = "upsert",
    always_new: bool = False,
    partition: str | None = None,
) -> bool:
    """Apply one batch of changes: drop what was seen, merge, publish.

    Changes up to the target's position are late repeats and are dropped. The
    rest without a NULL key is frozen, so that touched buckets, new position and merge all see the
    same rows: one change per key for an upsert target, each position once for
    a target that appends. Changes with a NULL key go to the target's rejects,
    with all their columns. ``always_new`` is for sources without a durable
    position, whose events are never late. ``partition`` names the column of the
    log partition, whose positions only compare among themselves.
    """
    current = table.version()
    if batch_id in current.batches:
        return False
    fresh = filter_change_ops(changes, operations)
    if partition is not None and not always_new:
        fresh = after_vector(fresh, order, partition, current.vector)
    elif not always_new:
        fresh = after_position(fresh, order, current.position)
    valid, rejects = split_null_keys(fresh, table.keys)
    table.reject(rejects, batch_id)
    columns = dict.fromkeys(["op", *order, *([partition] if partition else []), *table.schema.names])
    rows = valid.select(*columns)
    staged = (
        dedupe_positions(rows, [*order, *([partition] if partition else [])])
        if write_mode == "insert"
        else last_per_key(rows, table.keys, order)
    )

    def merge(current: DataFrame, delta: DataFrame) -> DataFrame:
        if write_mode == "insert":
            return apply_changes_append(current, delta, table.keys, order)
        return apply_last_changes(current, delta, table.keys)

    with frozen(staged, "changes") as delta:
        reached = {} if partition is None or always_new else vector_ends(delta, order, partition)
        return table.apply(delta, merge, batch_id, [] if partition else order, vector=reached)


def apply_to_targets(
    bridge: Bridge,
    changes: DataFrame,
    tables: Mapping[str, SnapshotTable],
    order: Sequence[str],
    batch_id: str,
    always_new: bool = False,
    partition: str | None = None,
) -> dict[str, str | None]:
    """One batch of changes to every target of a bridge; the error per target.

    Each target keeps its own position, so one that fails stays behind and
    takes up the missed changes when the batch comes again.
    """
    fresh = filter_changes(changes, bridge.filters)
    control = [ColumnMapping(c, c) for c in ("op", *order, *([partition] if partition else []))]
    errors: dict[str, str | None] = {}
    for target in bridge.targets:
        mapped = map_columns(fresh, [*target.mapping, *control] if target.mapping else ())
        try:
            apply_batch(
                mapped,
                tables[target.label],
                order,
                f"{batch_id}:{target.label}",
                bridge.operations,
                target.write_mode,
                always_new,
                partition,
            )
            errors[target.label] = None
        except WRITE_ERRORS as error:
            errors[target.label] = str(error)
    return errors


def start_bridge(
    stream: DataFrame,
    table: SnapshotTable,
    order: Sequence[str],
    checkpoint: str,
    bridge_id: str,
    normalize: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = True,
    operations: Sequence[str] = OPERATIONS,
    always_new: bool = False,
) -> StreamingQuery:
    """Keep a target in step with a change stream.

    Spark's checkpoint resumes the source; the batch id in the target's marker
    makes a repeated micro-batch a no-op.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = normalize(batch) if normalize else batch
        apply_batch(changes, table, order, f"{bridge_id}:{batch_id}", operations, always_new=always_new)

    return start_batches(stream, apply, checkpoint, once)


def start_fan_out(
    stream: DataFrame,
    bridge: Bridge,
    tables: Mapping[str, SnapshotTable],
    order: Sequence[str],
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Keep all targets of a bridge in step with a change stream.

    A failed target stops the query after the others were written; the same
    micro-batch comes again on restart and changes nothing where it arrived.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        with frozen(batch, "batch") as changes:
            errors = apply_to_targets(
                bridge, changes, tables, order, f"{bridge.bridge_id}:{batch_id}"
            )
        failed = {label: error for label, error in errors.items() if error}
        if failed:
            raise RuntimeError(f"targets failed: {failed}")

    return start_batches(stream, apply, checkpoint, once)


def start_batches(stream: DataFrame, apply: Callable, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def change_log_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of change-log files as a stream; bounded per micro-batch if asked."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
