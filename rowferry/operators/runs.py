"""Runs of a bridge: bulk copy, resume and poll, with their ledger."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import SETTLED_DELIVERY_STATUSES, Bridge, ColumnMapping, Sort, Target
from rowferry.functions.literals import named
from rowferry.operators.commit import WRITE_ERRORS, SnapshotTable
from rowferry.operators.ledger import record_deliveries
from rowferry.operators.merge import split_null_keys, upsert_rows
from rowferry.operators.paging import resolve_order
from rowferry.operators.payload import payload_outbox
from rowferry.operators.progress import outside_spans, spans_of
from rowferry.operators.projection import map_columns
from rowferry.operators.row_index import row_index_sequence
from rowferry.operators.watch import WatchState, watch_poll
from rowferry.session import freeze
from rowferry.sources.relational import scan_table

LEDGER_SCHEMA = (
    "run_id string, sequence bigint, row_index bigint, row_count bigint, status string, "
    "attempts int, error string"
)


@dataclass(frozen=True)
class RunResult:
    """The ledger after a run, rejected rows, and the outbox of an HTTP bridge."""

    deliveries: DataFrame
    status: str
    rejects: DataFrame | None = None
    outbox: DataFrame | None = None
    state: WatchState | None = None


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def _numbered(source: DataFrame, bridge: Bridge) -> DataFrame:
    order, _ = resolve_order(bridge.sort, bridge.primary_key)
    rows = scan_table(source, bridge.filters)
    return row_index_sequence(rows, order, bridge.primary_key, bridge.delivery.batch_size)


@dataclass(frozen=True)
class _Delivery:
    """The rows of one target in its columns, what it refuses, or why it takes nothing."""

    target: Target
    table: SnapshotTable | None = None
    rows: DataFrame | None = None
    refusal: Column | None = None
    error: str | None = None


def _refusal(rows: DataFrame, target: Target, table: SnapshotTable) -> Column | None:
    """The first reason why a row does not fit the target; None if all rows fit by their types.

    NULL keys are no reason: their rows are rejects.
    """
    reasons = []
    for wanted in table.schema:
        key = wanted.name in target.key_columns and target.write_mode == "upsert"
        given = rows.schema[wanted.name] if wanted.name in rows.columns else None
        column = named(wanted.name) if given else F.lit(None)
        if given and given.dataType != wanted.dataType:
            misfit = column.isNotNull() & column.try_cast(wanted.dataType).isNull()
            reasons.append(F.when(misfit, f"{wanted.name} is no {wanted.dataType.simpleString()}"))
        if not wanted.nullable and not key and (given is None or given.nullable):
            reasons.append(F.when(column.isNull(), f"{wanted.name} has no value"))
    return F.coalesce(*reasons) if reasons else None


def _prepare(rows: DataFrame, target: Target, tables: Mapping[str, SnapshotTable]) -> _Delivery:
    try:
        table = tables[target.label]
        if target.write_mode == "upsert" and list(target.matched_by()) != table.keys:
            raise ValueError(f"the keys of {target.label} differ from those of its table")
        numbers = [ColumnMapping(c, c) for c in ("row_index", "sequence")]
        mapped = map_columns(rows, [*target.mapping, *numbers] if target.mapping else ())
        unknown = [c for c in mapped.columns if c not in (*table.schema.names, "row_index", "sequence")]
        if unknown:
            raise ValueError(f"the target has no column {unknown}")
        return _Delivery(target, table, mapped, _refusal(mapped, target, table))
    except WRITE_ERRORS as error:
        return _Delivery(target, error=f"{target.label}: {error}")


def _write(to: _Delivery, rows: DataFrame, run_id: str, refused: DataFrame | None) -> DataFrame | None:
    """Publish the rows that the target does not have of this run; returns the rejects.

    The target's own version says what it has, so that what was published
    before a crash, a failure of another target or a resume from further back
    is never written twice.
    """
    version, pending = to.table.version(), rows
    if version.delivered is not None:
        pending = outside_spans(pending, to.table.delivered(run_id, version))
    if refused is not None:
        pending = pending.join(refused, "sequence", "left_anti")
    if pending is not rows and pending.isEmpty():
        return None
    publish = partial(
        to.table.apply, batch_id=f"{run_id}:{to.target.label}:{version.number + 1}", spans=spans_of(pending, run_id), base=version
    )
    mapped = pending.drop("sequence")
    if to.target.write_mode == "insert":
        publish(mapped.drop("row_index"), None)
        return None
    valid, rejects = split_null_keys(mapped, to.target.key_columns)
    # several source rows may fall on one key: the last in source order wins
    publish(valid, lambda current, delta: upsert_rows(current, delta, to.target.key_columns, ["row_index"], partial=True))
    return rejects


def waves(first: int, last: int, abort: bool) -> Iterator[tuple[int, int]]:
    """Ranges of sequences to deliver one after the other.

    A run that stops at its first failure starts with one delivery and goes on
    with ten times as many each time, so a target that takes nothing is noticed
    at once and a healthy one costs few writes.
    """
    count = 1 if abort else last - first + 1
    while first <= last:
        yield first, min(last, first + count - 1)
        first, count = first + count, count * 10


def _outcomes(rows: DataFrame, run_id: str, faults: DataFrame | None, broken: Sequence[tuple[int, int, int, str]]) -> DataFrame:
    """One row per delivery; its error is that of the first target that failed.

    ``faults`` has the refused deliveries (sequence, place, error) by the place
    of their target, ``broken`` the ranges that a whole target did not take.
    """
    counted = rows.groupBy("sequence").agg(F.min("row_index").alias("row_index"), F.count("*").alias("row_count"))
    found = [
        F.when(F.col("sequence").between(first, last), F.struct(F.lit(place).alias("place"), F.lit(text).alias("error")))
        for place, first, last, text in broken
    ]
    if faults is not None:
        first_fault = faults.groupBy("sequence").agg(F.min(F.struct("place", "error")).alias("fault"))
        counted, found = counted.join(first_fault, "sequence", "left"), [*found, F.col("fault")]
    none = F.lit(None).cast("struct<place:int,error:string>")
    error = F.least(*found, none)["error"] if found else F.lit(None).cast("string")
    return counted.select(
        F.lit(run_id).alias("run_id"),
        "sequence",
        "row_index",
        "row_count",
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        F.lit(1).alias("attempts"),
        error.alias("error"),
    )


def run_replay(
    bridge: Bridge,
    source: DataFrame,
    tables: Mapping[str, SnapshotTable],
    run_id: str,
    deliveries: DataFrame | None = None,
    cursor_offset: int = 0,
    table_name: str | None = None,
    now: str = "",
    attempt: int = 1,
) -> RunResult:
    """Copy a source to its targets; with a ledger, only what is not settled.

    The numbered source is a written table, so every target and the ledger see
    the same rows. Each target gets the pending rows that it does not have yet,
    as one version. A delivery with a row that does not fit a target, and any
    delivery to a target that takes nothing, fails as a whole for that target
    alone; running again sends it there and nowhere else. With ``on_error``
    abort nothing after the first failed delivery is recorded or sent, but for
    those written in one wave with it, which count as sent when the run goes on.
    """
    spark = source.sparkSession
    ledger = deliveries if deliveries is not None else empty_ledger(spark)
    numbered = _numbered(source, bridge)
    settled = ledger.where(
        (F.col("run_id") == run_id) & F.col("status").isin(*SETTLED_DELIVERY_STATUSES)
    ).select("sequence")
    first = cursor_offset // bridge.delivery.batch_size
    pending = numbered.where(F.col("sequence") >= first).join(settled, "sequence", "left_anti")
    if bridge.payload is not None:
        outbox = payload_outbox(
            pending.select(*source.columns, "row_index", "sequence"),
            bridge.payload,
            table_name or bridge.source,
            now,
            run_id,
            bridge.primary_key,
        )
        return RunResult(ledger, "queued", outbox=outbox)
    return _deliver(bridge, pending, tables, run_id, ledger, attempt=attempt)


def _deliver(bridge, rows, tables, run_id, ledger, state=None, attempt=1) -> RunResult:
    """Write rows to every target and record each delivery.

    Attempts go on from the ledger's, and are `attempt` at least.
    """
    span = rows.agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")).first()
    if span["first"] is None:
        return RunResult(ledger, "completed", state=state)
    abort = bridge.delivery.on_error == "abort"
    targets = [_prepare(rows, target, tables) for target in bridge.targets]
    faults, last = None, span["last"]
    for place, to in enumerate(targets):
        if to.refusal is not None:
            error = F.concat(F.lit(f"{to.target.label}: "), F.min_by(to.refusal, "row_index")).alias("error")
            found = to.rows.where(to.refusal.isNotNull()).groupBy("sequence").agg(error).withColumn("place", F.lit(place))
            faults = found if faults is None else faults.unionByName(found)
    if faults is not None:
        faults = freeze(faults, "faults")
        stop = faults.agg(F.min("sequence")).first()[0] if abort else None
        last = last if stop is None else stop
    rejects, broken = None, []
    for low, high in waves(span["first"], last, abort):
        for place, to in enumerate(targets):
            error = to.error
            if error is None:
                refused = None if faults is None else faults.where(F.col("place") == place).select("sequence")
                try:
                    left = _write(to, to.rows.where(F.col("sequence").between(low, high)), run_id, refused)
                    rejects = left if rejects is None else rejects
                except WRITE_ERRORS as failure:
                    error = f"{to.target.label}: {failure}"
            if error is not None:
                broken.append((place, low, high, error))
        if broken and abort:
            # the first delivery of the wave is the first that failed
            last = low
            break
    delivered = rows.where(F.col("sequence") <= last)
    if faults is not None:
        faults = faults.where(F.col("sequence") <= last)
    before = ledger.where(F.col("run_id") == run_id).select("sequence", F.col("attempts").alias("before"))
    outcomes = _outcomes(delivered, run_id, faults, broken).join(before, "sequence", "left").withColumn(
        "attempts", F.greatest(F.coalesce("before", F.lit(0)) + F.col("attempts"), F.lit(attempt)).cast("int")
    ).select(*ledger.columns)
    done = freeze(record_deliveries(ledger, outcomes), "ledger")
    failed = bool(broken) or (faults is not None and not faults.isEmpty())
    return RunResult(done, "failed" if failed else "completed", rejects, state=state)


def run_poll(
    bridge: Bridge,
    source: DataFrame,
    tables: Mapping[str, SnapshotTable],
    run_id: str,
    state: WatchState | None,
    deliveries: DataFrame | None = None,
    now: str = "",
) -> RunResult:
    """One poll of a watching bridge: new rows are written, then the state moves on.

    A payload bridge gets an outbox of them instead, one queued delivery per row.
    The numbers go on from the run's ledger, so no idempotency key comes twice.
    """
    ledger = deliveries if deliveries is not None else empty_ledger(source.sparkSession)
    rows = scan_table(source, bridge.filters)
    page, reached = watch_poll(rows, bridge.strategy, state, bridge.primary_key, bridge.per_poll)
    done = ledger.where(F.col("run_id") == run_id).agg(F.max("sequence")).first()[0]
    start = 0 if done is None else done + 1
    order = [Sort(bridge.strategy.column)] if bridge.strategy.column else []
    numbered = row_index_sequence(page, order, bridge.primary_key)
    # a poll delivers row by row, so a sequence is a row
    shifted = numbered.withColumn("row_index", F.col("row_index") + start).withColumn(
        "sequence", F.col("row_index")
    )
    if bridge.payload is not None:
        rows = shifted.select(*source.columns, "row_index", "sequence")
        outbox = payload_outbox(rows, bridge.payload, bridge.source, now, run_id, bridge.primary_key)
        queued = shifted.select(
            F.lit(run_id).alias("run_id"), "sequence", "row_index", F.lit(1).cast("bigint").alias("row_count"),
            F.lit("queued").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"),
        )
        return RunResult(ledger.unionByName(queued), "queued", outbox=outbox, state=reached)
    return _deliver(bridge, shifted, tables, run_id, ledger, reached)
