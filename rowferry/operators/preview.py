"""What a bridge would write or send, for a few rows; nothing is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.config import MAX_PREVIEW_ROWS, Bridge, Payload, Target
from rowferry.functions.predicates import apply_filters
from rowferry.operators.paging import preview_rows
from rowferry.operators.payload import render_row, render_warnings
from rowferry.operators.row_index import order_columns, total_order
from rowferry.operators.top import top_rows

_INDEX = "_preview_index"


@dataclass
class Preview:
    """The rows as they would arrive, and what is wrong with the bridge.

    ``bodies`` holds the mapped rows of the first target, or ``row_index`` and
    ``body`` of a payload. ``from_source`` is false for a given sample row.
    """

    bodies: DataFrame
    warnings: list[str]
    from_source: bool
    targets: list[Target] = field(default_factory=list)


def preview_payload(
    df: DataFrame,
    payload: Payload,
    table: str,
    now: str,
    limit: int = 3,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """``row_index``, ``body`` and ``warnings`` of the first rows.

    ``warnings`` names the tokens that resolve to nothing: in a row's body they
    leave a null, or a gap inside a text. They are known from the columns.
    """
    if not 1 <= limit <= MAX_PREVIEW_ROWS:
        raise ValueError(f"a preview shows 1 to {MAX_PREVIEW_ROWS} rows")
    # ten rows at most go through the one task that numbers them
    if keys:
        order = order_columns(total_order((), keys))
        index = F.row_number().over(Window.orderBy(*order)) - 1
        first = top_rows(df, order, limit)
    else:
        index = F.monotonically_increasing_id()
        first = df.limit(limit).coalesce(1)
    numbered = first.withColumn(_INDEX, index.cast("bigint"))
    missing = F.array(*map(F.lit, render_warnings(df, payload))).cast("array<string>")
    rendered = render_row(numbered, payload, table, now, index=_INDEX)
    return rendered.select(F.col(_INDEX).alias("row_index"), "body", missing.alias("warnings"))


def preview_bridge(
    bridge: Bridge,
    source: DataFrame,
    now: str,
    limit: int = 3,
    sample: DataFrame | None = None,
) -> Preview:
    """The first rows that pass the bridge's filters, in the order of its key.

    A given ``sample`` stands for the source and is not filtered.
    """
    rows = apply_filters(source, bridge.filters) if sample is None else sample
    known = tuple(k for k in bridge.primary_key if k in rows.columns)
    if bridge.payload is not None:
        bodies = preview_payload(rows, bridge.payload, bridge.source, now, limit, known)
        return Preview(bodies.drop("warnings"), render_warnings(rows, bridge.payload), sample is None)
    warnings = [
        f"{t.label}: rows are matched by key, but no key column is chosen"
        for t in bridge.targets
        if t.write_mode == "upsert" and not t.key_columns
    ]
    mapped = preview_rows(rows, bridge.targets[0].mapping, limit, known)
    return Preview(mapped, warnings, sample is None, list(bridge.targets))
