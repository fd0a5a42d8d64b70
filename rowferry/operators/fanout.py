"""One set of rows written to several targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowferry.config import ColumnMapping, Target
from rowferry.operators.commit import WRITE_ERRORS
from rowferry.operators.ddl import ensure_target
from rowferry.operators.merge import (
    apply_changes,
    apply_changes_append,
    insert_rows,
    upsert_rows,
)
from rowferry.operators.projection import map_columns
from rowferry.session import freeze


def _mapped(rows: DataFrame, target: Target, control: Sequence[str]) -> DataFrame:
    mapping = list(target.mapping)
    if mapping:
        named = {m.target for m in mapping}
        mapping += [ColumnMapping(c, c) for c in control if c not in named]
    return map_columns(rows, mapping)


def _merged(
    mapped: DataFrame, target: Target, table: DataFrame | None, order: Sequence[str], op: str | None, control: Sequence[str]
) -> DataFrame:
    image = mapped.drop(*[c for c in control if table is None or c not in table.columns])
    current = ensure_target(table, target, image.schema, mapped.sparkSession)
    if op:
        write = apply_changes if target.write_mode == "upsert" else apply_changes_append
        return write(current, mapped, target.key_columns, order, op)
    if target.write_mode == "insert":
        return insert_rows(current, image)
    keys = target.matched_by()
    if not order:
        return upsert_rows(current, image, keys, partial=True)
    return upsert_rows(current, mapped, keys, order, partial=True)


def write_target(
    rows: DataFrame,
    target: Target,
    table: DataFrame | None,
    order: Sequence[str] = (),
    op: str | None = None,
) -> DataFrame:
    """The new content of one target after writing ``rows``."""
    control = list(dict.fromkeys([*order, *([op] if op else [])]))
    return _merged(_mapped(rows, target, control), target, table, order, op, control)


def fan_out(
    rows: DataFrame,
    targets: Sequence[Target],
    tables: dict[str, DataFrame | None],
    order: Sequence[str] = (),
    op: str | None = None,
    write: Callable[[DataFrame, str], DataFrame] = freeze,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write to every target; a target that fails does not stop the others.

    Each target's rows are staged once, which counts them on the way, merged
    and handed to ``write``, so status and ``affected`` tell what was written:
    a value that breaks one target's write fails that target alone. Returns the
    written tables by label and one outcome row per target. The loop runs over
    targets, never over rows.
    """
    if not targets:
        raise ValueError("at least one target is needed")
    control = list(dict.fromkeys([*order, *([op] if op else [])]))
    written: dict[str, DataFrame] = {}
    notes: list[tuple[str, str, str | None, int]] = []
    for target in targets:
        try:
            seen = Observation()
            staged = _mapped(rows, target, control).observe(seen, F.count(F.lit(1)).alias("rows"))
            # what only the plan can tell comes before any row is moved
            _merged(staged, target, tables.get(target.label), order, op, control)
            staged = freeze(staged, "staged")
            merged = _merged(staged, target, tables.get(target.label), order, op, control)
            written[target.label] = write(merged, target.label)
            notes.append((target.label, "success", None, seen.get["rows"]))
        except WRITE_ERRORS as error:
            notes.append((target.label, "failed", str(error), 0))
    failed = any(status == "failed" for _, status, _, _ in notes)
    outcome = rows.sparkSession.createDataFrame(notes, "target string, status string, error string, affected bigint")
    return written, outcome.withColumn("outcome", F.lit("failed" if failed else "success"))
