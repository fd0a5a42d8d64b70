"""Sorting, pages and previews."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import MAX_PREVIEW_ROWS, PAGE_CAPS, ColumnMapping, Filter, Sort
from rowferry.functions.literals import named, value_literal
from rowferry.functions.predicates import apply_filters
from rowferry.operators.counts import count_estimated, count_rows
from rowferry.operators.projection import map_columns
from rowferry.operators.row_index import order_columns, row_index_sequence, total_order
from rowferry.operators.top import top_rows
from rowferry.session import freeze

# Beyond this many leading rows a page is cut from the row index instead of a
# single top-k task.
DEEP_PAGE_ROWS = 10_000


def sort_rows(df: DataFrame, sort: Sequence[Sort], keys: Sequence[str] = ()) -> DataFrame:
    """Global sort; key columns at the end keep hot sort values divisible."""
    return df.orderBy(*order_columns(total_order(sort, keys)))


def page_bounds(limit: int, offset: int, dialect: str | None = None) -> tuple[int, int]:
    """Checked bounds; with a dialect, at most a page of its length."""
    if int(limit) != limit or int(offset) != offset or limit < 0 or offset < 0:
        raise ValueError("limit and offset must be non-negative whole numbers")
    limit = max(int(limit), 1)
    return (min(limit, PAGE_CAPS[dialect]) if dialect else limit), int(offset)


def cut_page(df: DataFrame, order: Sequence[Sort], offset: int, count: int) -> DataFrame:
    """``count`` rows from ``offset`` on, in order.

    Shallow pages are a top-k. A deep or long one is cut from the distributed
    row index, so no task ever holds all rows up to its end.
    """
    if offset + count <= DEEP_PAGE_ROWS:
        return top_rows(df, order_columns(order), offset + count).offset(offset)
    numbered = row_index_sequence(df, order, index="_at", sequence="_seq")
    page = numbered.where((F.col("_at") >= offset) & (F.col("_at") < offset + count))
    return page.orderBy("_at").drop("_at", "_seq")


def page_offset(
    df: DataFrame,
    sort: Sequence[Sort],
    keys: Sequence[str],
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page with ``has_more``, known from one row past the page.

    The page is as long as asked for; only `browse` holds to the page caps.
    """
    limit, offset = page_bounds(limit, offset)
    order = total_order(sort, keys)
    probe = freeze(cut_page(df, order, offset, limit + 1), "page")
    has_more = probe.count() > limit
    page = probe.orderBy(*order_columns(order)).limit(limit)
    return page.withColumn("has_more", F.lit(has_more))


def after_key(order: Sequence[Sort], last: Sequence[Any]) -> Column:
    """Rows strictly after ``last`` in lexicographic key order."""
    if len(order) != len(last):
        raise ValueError("one value per order column is needed")
    condition = F.lit(False)
    for sort, value in reversed(list(zip(order, last))):
        column, bound = named(sort.column), value_literal(value)
        past = column < bound if sort.direction == "desc" else column > bound
        condition = past | ((column == bound) & condition)
    # a plain bound on the leading column is what the file scan can use
    lead, first = named(order[0].column), value_literal(last[0])
    bound = lead <= first if order[0].direction == "desc" else lead >= first
    return bound & condition


def page_keyset(
    df: DataFrame, keys: Sequence[str], last: Sequence[Any] | None, limit: int = 200
) -> DataFrame:
    """The next page after the last key; the bound prunes row groups."""
    order = [Sort(key) for key in keys]
    rows = df.where(after_key(order, last)) if last is not None else df
    return top_rows(rows, order_columns(order), limit)


def resolve_order(
    sort: Sequence[Sort], primary_key: Sequence[str]
) -> tuple[list[Sort], bool]:
    """The order of a bulk copy and whether key paging fits it.

    The caller's sort comes first, then the primary key; without either the
    copy is refused. Key paging needs one ascending column that is the key.
    """
    order = list(sort) or [Sort(key) for key in primary_key]
    if not order:
        raise ValueError("the source has no primary key: give a sort order")
    keyset = (
        len(order) == 1
        and list(primary_key) == [order[0].column]
        and order[0].direction == "asc"
    )
    return order, keyset


def seek_resume(numbered: DataFrame, offset: int, index: str = "row_index") -> DataFrame:
    """Rows of an indexed copy from ``offset`` on."""
    return numbered.where(F.col(index) >= offset)


def preview_rows(
    df: DataFrame,
    mapping: Sequence[ColumnMapping] = (),
    limit: int = 3,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The first rows as they would be written; nothing is written."""
    if not 1 <= limit <= MAX_PREVIEW_ROWS:
        raise ValueError(f"a preview shows 1 to {MAX_PREVIEW_ROWS} rows")
    rows = df.orderBy(*keys) if keys else df
    return map_columns(rows.limit(limit), mapping)


def browse(
    df: DataFrame,
    filters: Iterable[Filter] = (),
    sort: Sequence[Sort] = (),
    keys: Sequence[str] = (),
    limit: int = 100,
    offset: int = 0,
    dialect: str = "sql",
) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row with the total and how it was obtained."""
    filters = list(filters)
    page = page_offset(
        apply_filters(df, filters, dialect), sort, keys, *page_bounds(limit, offset, dialect)
    )
    total = count_rows(df, filters, dialect) if filters else count_estimated(df)
    return page, total
