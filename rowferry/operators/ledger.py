"""Runs and deliveries: counters, plans and outcomes.

``runs`` has run_id, bridge_id, status, cursor_offset, batch_size, total_count
and started_at. ``deliveries`` has run_id, sequence, row_index, row_count,
status and more. All work is keyed by (run_id, sequence), so a run that holds
a large part of the ledger still spreads over all partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import (
    ACTIVE_RUN_STATUSES,
    LEDGER_PAGE,
    RESUMABLE_RUN_STATUSES,
    RUN_LIST_LIMIT,
    SETTLED_DELIVERY_STATUSES,
    TERMINAL_RUN_STATUSES,
    Sort,
)
from rowferry.operators.commit import WRITE_ERRORS
from rowferry.operators.merge import apply_changes, upsert_rows
from rowferry.operators.paging import cut_page
from rowferry.operators.skew import group_for_join
from rowferry.session import freeze

KEY = ["run_id", "sequence"]
_CHUNK = 65_536


def _delivery_count() -> Column:
    return F.expr("(total_count + batch_size - 1) div batch_size")


def _last_batch_size() -> Column:
    total, batch = F.col("total_count"), F.col("batch_size")
    return F.when(total > 0, total - (_delivery_count() - 1) * batch)


def planned_deliveries(runs: DataFrame) -> DataFrame:
    """Number of deliveries of each run and the size of the last one."""
    return runs.select(
        "run_id",
        _delivery_count().alias("delivery_count"),
        _last_batch_size().cast("bigint").alias("last_batch_size"),
    )


def expand_sequences(ranges: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row per sequence of each inclusive range, in a ``sequence`` column.

    Long ranges open in two steps with a repartition between them, so one big
    run is neither one large array nor one task.
    """
    low, high = F.col(first).cast("bigint"), F.col(last).cast("bigint")
    chunks = (
        ranges.where(low <= high)
        .withColumn("_from", F.explode(F.sequence(low, high, F.lit(_CHUNK).cast("bigint"))))
        .withColumn("_to", F.least(F.col("_from") + (_CHUNK - 1), high))
    )
    # a fixed number: AQE would merge partitions by the few bytes of the chunks
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(parts, *[c for c in ("run_id", "_from") if c in chunks.columns])
    return spread.withColumn("sequence", F.explode(F.sequence("_from", "_to"))).drop(
        first, last, "_from", "_to"
    )


def planned_sequences(runs: DataFrame, from_cursor: bool = False) -> DataFrame:
    """Every planned (run, sequence) with its row range, all or from the cursor on."""
    first = F.expr("cursor_offset div batch_size") if from_cursor else F.lit(0).cast("bigint")
    plan = runs.where("total_count > 0").select(
        "run_id",
        "batch_size",
        "total_count",
        first.alias("first"),
        (_delivery_count() - 1).alias("last"),
    )
    rows = expand_sequences(plan)
    start = F.col("sequence") * F.col("batch_size")
    return rows.select(
        "run_id",
        "sequence",
        start.cast("bigint").alias("row_index"),
        F.least(F.col("batch_size"), F.col("total_count") - start).cast("bigint").alias("row_count"),
    )


def settled_sequences(deliveries: DataFrame) -> DataFrame:
    """Deliveries that must not be sent again: delivered or skipped."""
    return deliveries.where(F.col("status").isin(*SETTLED_DELIVERY_STATUSES)).select(*KEY)


def pending_deliveries(
    runs: DataFrame, deliveries: DataFrame, from_cursor: bool = False
) -> DataFrame:
    """Planned deliveries that are not settled."""
    planned = planned_sequences(runs, from_cursor)
    return planned.join(settled_sequences(deliveries), KEY, "left_anti")


def run_counters(deliveries: DataFrame) -> DataFrame:
    """Row totals by status per run."""

    def rows_with(status: str):
        return F.coalesce(
            F.sum(F.when(F.col("status") == status, F.col("row_count"))), F.lit(0)
        ).cast("bigint")

    return deliveries.groupBy("run_id").agg(
        rows_with("success").alias("sent_count"),
        rows_with("failed").alias("failed_count"),
        rows_with("skipped").alias("skipped_count"),
    )


def run_progress(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Settled, pending, percent and success rate per run.

    Percent is unknown without a positive total, the rate without an attempt.
    """
    counted = runs.select("run_id", "total_count").join(
        run_counters(deliveries), "run_id", "left"
    )
    sent, failed, skipped = (
        F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        for c in ("sent_count", "failed_count", "skipped_count")
    )
    settled, attempted, total = sent + failed + skipped, sent + failed, F.col("total_count")

    def percent(part, whole):
        # half rounds up
        return F.floor(part * 100.0 / whole + 0.5).cast("bigint")

    return counted.select(
        "run_id",
        "total_count",
        settled.alias("settled"),
        F.when(total.isNotNull(), F.greatest(F.lit(0), total - settled)).cast("bigint").alias(
            "pending"
        ),
        F.when(total > 0, F.least(F.lit(100), percent(settled, total))).cast("bigint").alias(
            "percent"
        ),
        F.when(attempted > 0, percent(sent, attempted)).alias("success_rate"),
    )


def record_deliveries(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Upsert outcomes by (run, sequence); ``recorded_at`` orders repeats."""
    order = ["recorded_at"] if "recorded_at" in outcomes.columns else []
    return upsert_rows(deliveries, outcomes, KEY, order, partial=True)


def skip_sequences(runs: DataFrame, deliveries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Skipped deliveries for the wanted sequences that have no delivery yet."""
    fresh = wanted.select(*KEY).distinct().join(deliveries.select(*KEY), KEY, "left_anti")
    plan = runs.select(
        "run_id",
        "batch_size",
        _delivery_count().alias("delivery_count"),
        _last_batch_size().alias("last_batch_size"),
    )
    sized = fresh.join(plan, "run_id")
    is_last = F.coalesce(F.col("sequence") == F.col("delivery_count") - 1, F.lit(False))
    return sized.select(
        "run_id",
        "sequence",
        (F.col("sequence") * F.col("batch_size")).cast("bigint").alias("row_index"),
        F.when(is_last, F.col("last_batch_size")).otherwise(F.col("batch_size")).cast("bigint").alias(
            "row_count"
        ),
        F.lit("skipped").alias("status"),
        F.lit(0).alias("attempts"),
    )


def skip_range(
    runs: DataFrame, deliveries: DataFrame, ranges: DataFrame, limit: int | None = None
) -> DataFrame:
    """:func:`skip_sequences` for inclusive ranges ``first`` to ``last`` per run.

    With ``limit`` a longer range is refused.
    """
    if limit is not None:
        too_long = ranges.where(F.col("last") - F.col("first") + 1 > limit)
        if not too_long.isEmpty():
            raise ValueError(f"at most {limit} deliveries can be skipped at once")
    return skip_sequences(runs, deliveries, expand_sequences(ranges))


def resume_plan(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries left from the cursor on, for runs that can be resumed."""
    resumable = runs.where(F.col("status").isin(*RESUMABLE_RUN_STATUSES))
    return pending_deliveries(resumable, deliveries, from_cursor=True)


def retry_failed_plan(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """All deliveries not settled, from the start, of ended runs with a failure."""
    failed = deliveries.where("status = 'failed'").select("run_id").distinct()
    eligible = runs.where(F.col("status").isin(*TERMINAL_RUN_STATUSES)).join(
        failed, "run_id", "left_semi"
    )
    return pending_deliveries(eligible, deliveries)


def resend_failed(
    target: DataFrame,
    runs: DataFrame,
    deliveries: DataFrame,
    captured: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    write: Callable[[DataFrame, str], DataFrame] = freeze,
) -> tuple[DataFrame, DataFrame]:
    """Apply the captured rows of failed deliveries again, oldest first.

    ``captured`` holds run_id, sequence, op and the rows as they were read. It
    returns the written target and the deliveries: delivered once ``write`` has
    written the target, and failed once more, with the target as it was, when
    it could not.
    """
    ended = runs.where(~F.col("status").isin(*ACTIVE_RUN_STATUSES)).select("run_id")
    failed = deliveries.where("status = 'failed'").join(ended, "run_id", "left_semi")
    rows = captured.join(failed.select(*KEY), KEY, "left_semi")
    try:
        written, error = write(apply_changes(target, rows, keys, order), "resent"), None
    except WRITE_ERRORS as refused:
        written, error = target, str(refused)
    outcomes = failed.select(
        *KEY,
        F.lit("failed" if error else "success").alias("status"),
        (F.col("attempts") + 1).cast("int").alias("attempts"),
        *([F.lit(error).cast("string").alias("error")] if "error" in deliveries.columns else []),
    )
    return written, record_deliveries(deliveries, outcomes)


def abort_cut(deliveries: DataFrame) -> DataFrame:
    """With on-error abort: nothing of a run after its first failed sequence."""
    first = group_for_join(
        deliveries.where("status = 'failed'"),
        {"run_id": F.col("run_id")},
        F.min("sequence").alias("_stop"),
    )
    return (
        deliveries.join(first, "run_id", "left")
        .where("_stop IS NULL OR sequence <= _stop")
        .drop("_stop")
    )


def delivery_window(
    deliveries: DataFrame,
    run_id,
    status: str | None = None,
    first: int | None = None,
    last: int | None = None,
    offset: int = 0,
    limit: int = LEDGER_PAGE,
) -> DataFrame:
    """One page of a run's deliveries in sequence order, as long as asked for."""
    rows = deliveries.where(F.col("run_id") == run_id)
    if status:
        rows = rows.where(F.col("status") == status)
    if first is not None:
        rows = rows.where(F.col("sequence") >= first)
    if last is not None:
        rows = rows.where(F.col("sequence") <= last)
    return cut_page(rows, [Sort("sequence")], offset, limit)


def list_runs(runs: DataFrame, bridge_id, limit: int = RUN_LIST_LIMIT) -> DataFrame:
    """Newest runs of one bridge."""
    return (
        runs.where(F.col("bridge_id") == bridge_id)
        .orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(limit)
    )


def latest_run_per_bridge(runs: DataFrame) -> DataFrame:
    """Newest run of each bridge and whether it is still active."""
    newest = runs.groupBy("bridge_id").agg(
        F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("run")
    )
    return newest.select(
        "bridge_id",
        F.col("run.run_id").alias("run_id"),
        F.col("run.status").alias("last_status"),
        F.col("run.status").isin(*ACTIVE_RUN_STATUSES).alias("active"),
    )


def bridge_status(bridges: DataFrame, runs: DataFrame) -> DataFrame:
    """disabled, active, failed or idle per bridge."""
    joined = bridges.select("bridge_id", "enabled").join(
        latest_run_per_bridge(runs), "bridge_id", "left"
    )
    return joined.select(
        "bridge_id",
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("active"), "active")
        .when(F.col("last_status") == "failed", "failed")
        .otherwise("idle")
        .alias("status"),
    )
