"""Filter specifications compiled to one boolean column."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import Filter
from rowferry.functions.literals import named, value_literal

_SCALARS = (str, bytes, bool, int, float, dt.date, dt.datetime, type(None))


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _membership(column: Column, values: object) -> Column:
    listed = list(values) if isinstance(values, (list, tuple, set, frozenset)) else []
    return column.isin([value_literal(v) for v in listed]) if listed else F.lit(False)


def _document_membership(column: Column, values: object) -> Column:
    listed = list(values) if isinstance(values, (list, tuple, set, frozenset)) else []
    found = _membership(column, [v for v in listed if v is not None])
    return (found | column.isNull()) if None in listed else found


_SHARED: dict[str, Callable[[Column, object], Column]] = {
    "lt": lambda c, v: c < value_literal(v),
    "lte": lambda c, v: c <= value_literal(v),
    "gt": lambda c, v: c > value_literal(v),
    "gte": lambda c, v: c >= value_literal(v),
    "isNull": lambda c, _: c.isNull(),
    "notNull": lambda c, _: c.isNotNull(),
}

_DIALECTS: dict[str, dict[str, Callable[[Column, object], Column]]] = {
    "sql": {
        **_SHARED,
        "eq": lambda c, v: c == value_literal(v),
        "neq": lambda c, v: c != value_literal(v),
        # % and _ inside the value stay wildcards in this dialect
        "contains": lambda c, v: c.cast("string").ilike(f"%{_text(v)}%"),
        "startsWith": lambda c, v: c.cast("string").ilike(f"{_text(v)}%"),
        "endsWith": lambda c, v: c.cast("string").ilike(f"%{_text(v)}"),
        "in": _membership,
    },
    "document": {
        **_SHARED,
        "eq": lambda c, v: c.isNull() if v is None else c == value_literal(v),
        # a missing field differs from every value
        "neq": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(value_literal(v)),
        "contains": lambda c, v: F.contains(F.lower(c), F.lower(F.lit(_text(v)))),
        "startsWith": lambda c, v: F.startswith(F.lower(c), F.lower(F.lit(_text(v)))),
        "endsWith": lambda c, v: F.endswith(F.lower(c), F.lower(F.lit(_text(v)))),
        "in": _document_membership,
    },
}
_COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte")


def compile_filter(spec: Filter, dialect: str = "sql") -> Column:
    return filter_on(named(spec.column), spec, dialect)


def filter_on(column: Column, spec: Filter, dialect: str = "sql") -> Column:
    """The filter applied to a given column instead of the one that it names."""
    build = _DIALECTS[dialect].get(spec.operator)
    if build is None:
        raise ValueError(f"unsupported filter operator {spec.operator!r}")
    if (
        dialect == "document"
        and spec.operator in _COMPARISONS
        and not isinstance(spec.value, _SCALARS)
    ):
        raise ValueError(f"the filter value for {spec.column!r} must be a scalar")
    return build(column, spec.value)


def compile_filters(filters: Iterable[Filter], dialect: str = "sql") -> Column:
    """All filters joined by AND; no filter keeps every row."""
    return reduce(
        lambda left, right: left & right,
        (compile_filter(spec, dialect) for spec in filters),
        F.lit(True),
    )


# a longer list is joined instead of written into the expression
LONG_LIST = 1000
_LISTED = {bool: "boolean", int: "bigint", float: "double", str: "string", dt.datetime: "timestamp_ntz", dt.date: "date"}


def _long_list(spec: Filter) -> tuple[list, str] | None:
    """The values of a long list and their type; None for short lists and mixed types."""
    if spec.operator != "in" or not isinstance(spec.value, (list, tuple, set, frozenset)) or len(spec.value) <= LONG_LIST:
        return None
    kinds = {type(v) for v in spec.value if v is not None}
    if kinds == {int, float}:
        kinds = {float}
    kind = _LISTED.get(kinds.pop()) if len(kinds) == 1 else None
    if kind is None or (kind == "timestamp_ntz" and any(v is not None and v.tzinfo for v in spec.value)):
        return None
    return [float(v) if kind == "double" and v is not None else v for v in spec.value], kind


def apply_filters(df: DataFrame, filters: Iterable[Filter], dialect: str = "sql") -> DataFrame:
    """The rows that pass all filters; membership in a long list is a semi join with its values."""
    short = []
    for spec in filters:
        listed = _long_list(spec)
        if listed is None:
            short.append(spec)
            continue
        values, kind = listed
        # NULL in the list is a value of documents and matches nothing in tables
        wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values) if v is not None or dialect == "document"], f"_listed {kind}")
        column = named(spec.column)
        equal = column.eqNullSafe(F.col("_listed")) if dialect == "document" else column == F.col("_listed")
        df = df.join(wanted, equal, "left_semi")
    return df.where(compile_filters(short, dialect))


_ANY_TEXT = ("contains", "startsWith", "endsWith")
_PRESENCE = ("isNull", "notNull")
_KINDS = {bool: "BOOLEAN", str: "STRING"}


def _as_kind(value: Column, spec: Filter, kind: type) -> Column:
    """A filter on a variant, of which only values of the kind can match.

    Whole numbers are compared as such, other numbers as floating point.
    """
    shape = F.schema_of_variant(value)
    if kind in _KINDS:
        typed = F.when(shape == _KINDS[kind], F.try_variant_get(value, "$", _KINDS[kind].lower()))
        return filter_on(typed, spec, "document")
    if kind in (int, float):
        number = F.when(
            (shape == "DOUBLE") | (shape == "FLOAT") | shape.startswith("DECIMAL"), F.try_variant_get(value, "$", "double")
        )
        whole = filter_on(F.try_variant_get(value, "$", "bigint"), spec, "document")
        return F.when(shape == "BIGINT", whole).otherwise(filter_on(number, spec, "document"))
    # text holds dates and times
    text = F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))
    return filter_on(text.try_cast("timestamp_ntz" if kind is dt.datetime else "date"), spec, "document")


def variant_filter(value: Column, spec: Filter) -> Column:
    """A document filter on a field whose type differs from document to document.

    A value only matches one of its own kind. A missing field and JSON null are
    both NULL.
    """
    blank = F.coalesce(value.isNull() | F.is_variant_null(value), F.lit(True))
    present = F.when(~blank, True)
    if spec.operator in _PRESENCE or (spec.operator in ("eq", "neq") and spec.value is None):
        return filter_on(present, spec, "document")
    if spec.operator in _ANY_TEXT:
        return _as_kind(value, spec, str)
    if spec.operator == "in":
        listed = list(spec.value) if isinstance(spec.value, (list, tuple, set, frozenset)) else []
        kinds = {float if type(v) is int else type(v) for v in listed if v is not None}
        parts = [
            _as_kind(value, Filter(spec.column, "in", [v for v in listed if (float if type(v) is int else type(v)) is kind]), kind)
            for kind in sorted(kinds, key=str)
        ]
        found = reduce(lambda left, right: left | right, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(False))
        return (found | blank) if None in listed else found
    return _as_kind(value, spec, type(spec.value))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a key glob with ``*`` and ``?``."""
    translated = {"*": ".*", "?": "."}
    return "^" + "".join(translated.get(ch, re.escape(ch)) for ch in glob) + "$"


def matches_glob(column: Column, glob: str) -> Column:
    return column.rlike("(?s)" + glob_pattern(glob))
