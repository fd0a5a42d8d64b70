"""Request bodies built from JSON templates, as column expressions.

A template is read once on the driver and turned into a column that yields
JSON text. Values are quoted where they are placed, so no value can break the
structure of the document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import LOGGED_BODY_CHARS, Delivery, Payload
from rowferry.functions.text import (
    json_array,
    json_object,
    json_text,
    plain_text,
    quoted_json,
)

_TOKEN = re.compile(r"\{\{\s*([\w$]+)\s*\}\}")
# Output keys that are never written.
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")
# HTTP statuses worth another attempt.
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504)


class _Scope:
    """Columns that tokens resolve to, and the names that did not resolve."""

    def __init__(
        self,
        schema: T.StructType,
        payload: Payload,
        table: str,
        now: str,
        index: str | None,
        op: str | None,
        hidden: Sequence[str],
    ) -> None:
        shown = [f for f in schema.fields if f.name not in hidden]
        self.values: dict[str, tuple[Column, T.DataType]] = {
            f.name: (F.col(f"`{f.name}`"), f.dataType) for f in shown
        }
        if op:
            self.values["$op"] = (F.col(op), T.StringType())
        row = [
            (payload.rename.get(name, name), column, dtype)
            for name, (column, dtype) in self.values.items()
            if not payload.fields or name in payload.fields
        ]
        self.row_text = json_object(list({m[0]: m for m in row}.values()))
        self.values["$table"] = (F.lit(table), T.StringType())
        self.values["$now"] = (F.lit(now), T.StringType())
        position = F.col(index) if index else F.lit(0)
        self.values["$index"] = (position, T.LongType())
        self.missing: list[str] = []

    def _miss(self, name: str) -> None:
        if name not in self.missing:
            self.missing.append(name)

    def as_json(self, name: str) -> Column:
        if name == "$row":
            return self.row_text
        if name in self.values:
            return json_text(*self.values[name])
        self._miss(name)
        return F.lit("null")

    def as_text(self, name: str) -> Column:
        if name == "$row":
            return self.row_text
        if name in self.values:
            return plain_text(*self.values[name])
        self._miss(name)
        return F.lit("")


def read_template(template: str) -> object:
    """The template as plain JSON values; a bare token stands for itself."""
    if _TOKEN.fullmatch(template.strip()):
        return template.strip()
    try:
        return json.loads(template)
    except json.JSONDecodeError as error:
        raise ValueError(f"the payload template is not valid JSON: {error}") from error


def _mixed(text: str, scope: _Scope) -> Column:
    """Text with its tokens replaced; odd items of the split are token names."""
    pieces = [
        scope.as_text(part) if at % 2 else F.lit(part)
        for at, part in enumerate(_TOKEN.split(text))
        if at % 2 or part
    ]
    return F.concat(*pieces) if pieces else F.lit("")


def _body(node: object, scope: _Scope) -> Column:
    if isinstance(node, str):
        whole = _TOKEN.fullmatch(node)
        if whole:
            return scope.as_json(whole[1])
        if _TOKEN.search(node):
            return quoted_json(_mixed(node, scope))
    if isinstance(node, list):
        items = [_body(item, scope) for item in node]
        return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    if isinstance(node, dict):
        return _members(node, scope)
    return F.lit(json.dumps(node, ensure_ascii=False))


def _members(node: dict, scope: _Scope) -> Column:
    """Object members; a forbidden key, or one repeated later, is left out."""
    names = [(_mixed(key, scope) if _TOKEN.search(key) else key) for key in node]
    fragments = []
    for at, (name, value) in enumerate(zip(names, node.values())):
        body = _body(value, scope)
        if isinstance(name, str):
            if name in FORBIDDEN_KEYS:
                continue
            piece = F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), body)
            name = F.lit(name)
        else:
            piece = F.when(
                ~name.isin(*FORBIDDEN_KEYS), F.concat(quoted_json(name), F.lit(":"), body)
            )
        rivals = [n for n in names[at + 1 :] if not isinstance(n, str)]
        if not isinstance(names[at], str):
            rivals = [n if not isinstance(n, str) else F.lit(n) for n in names[at + 1 :]]
        for rival in rivals:
            piece = F.when(name != rival, piece)
        fragments.append(piece)
    # concat_ws leaves NULL fragments out
    return F.concat(F.lit("{"), F.concat_ws(",", *fragments), F.lit("}"))


def _wrapped(body: Column, wrap_key: str | None) -> Column:
    if not wrap_key:
        return body
    return F.concat(F.lit("{" + json.dumps(wrap_key, ensure_ascii=False) + ":"), body, F.lit("}"))


def _compile(df, payload, table, now, index, op, hidden):
    scope = _Scope(df.schema, payload, table, now, index, op, hidden)
    return _body(read_template(payload.template), scope), scope.missing


def render_warnings(df: DataFrame, payload: Payload, op: str | None = None) -> list[str]:
    """Tokens that no column or helper resolves, known before any row is read."""
    return _compile(df, payload, "", "", None, op, ())[1]


def render_row(
    df: DataFrame,
    payload: Payload,
    table: str,
    now: str,
    index: str | None = None,
    op: str | None = None,
    hidden: Sequence[str] = (),
) -> DataFrame:
    """Add ``body``, the JSON text of one request per row.

    ``hidden`` names bookkeeping columns that are not part of the row.
    """
    hidden = [*hidden, *[c for c in (index, op) if c]]
    body, _ = _compile(df, payload, table, now, index, op, hidden)
    return df.withColumn("body", _wrapped(body, payload.wrap_key))


def render_batch(
    df: DataFrame,
    payload: Payload,
    table: str,
    now: str,
    index: str = "row_index",
    sequence: str = "sequence",
    keys: Sequence[str] = (),
    op: str | None = None,
    hidden: Sequence[str] = (),
    as_array: bool = False,
) -> DataFrame:
    """One body per delivery: rows of a sequence as a JSON array in index order.

    A sequence holds at most a batch of rows (1000), so each group is small by
    construction. A delivery of one row is sent as an object unless
    ``as_array`` is set.
    """
    inner = Payload(payload.template, payload.fields, payload.rename)
    rendered = render_row(df, inner, table, now, index, op, [*hidden, sequence])
    row_keys = json_array([(F.col(k), df.schema[k].dataType) for k in keys]) if keys else None
    item = [F.col(index).alias("at"), F.col("body")]
    if row_keys is not None:
        item.append(
            (json_text(F.col(keys[0]), df.schema[keys[0]].dataType) if len(keys) == 1 else row_keys)
            .alias("row_key")
        )
    grouped = rendered.groupBy(sequence).agg(
        F.array_sort(F.collect_list(F.struct(*item))).alias("items")
    )
    bodies = F.array_join(F.transform("items", lambda r: r["body"]), ",")
    listed = F.concat(F.lit("["), bodies, F.lit("]"))
    body = listed if as_array else F.when(F.size("items") == 1, bodies).otherwise(listed)
    columns = [
        F.col(sequence),
        F.element_at("items", 1)["at"].alias("row_index"),
        F.size("items").cast("bigint").alias("row_count"),
        _wrapped(body, payload.wrap_key).alias("body"),
    ]
    if row_keys is not None:
        listed_keys = F.array_join(F.transform("items", lambda r: r["row_key"]), ",")
        columns.append(F.concat(F.lit("["), listed_keys, F.lit("]")).alias("row_keys"))
    return grouped.select(*columns)


def payload_outbox(
    numbered: DataFrame,
    payload: Payload,
    table: str,
    now: str,
    run_id: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Deliveries ready to send, with idempotency key and a capped log copy.

    The row keys are recorded for a one-column key only, as in a bulk copy.
    """
    single = list(keys) if len(keys) == 1 else []
    batches = render_batch(numbered, payload, table, now, keys=single)
    if not single:
        batches = batches.withColumn("row_keys", F.lit(None).cast("string"))
    return batches.select(
        "sequence",
        "row_index",
        "row_count",
        "row_keys",
        F.concat(F.lit(f"{run_id}:"), F.col("sequence").cast("string")).alias("idempotency_key"),
        "body",
        F.substring("body", 1, LOGGED_BODY_CHARS).alias("logged_body"),
    )


def change_outbox(
    changes: DataFrame,
    payload: Payload,
    table: str,
    now: str,
    run_id: str,
    keys: Sequence[str],
    position: str = "position",
    op: str = "op",
) -> DataFrame:
    """One delivery per change, keyed by run and log position."""
    rendered = render_row(changes, payload, table, now, op=op, hidden=[position])
    return rendered.select(
        position,
        json_array([(F.col(k), changes.schema[k].dataType) for k in keys]).alias("row_keys"),
        F.concat(F.lit(f"{run_id}:"), F.col(position)).alias("idempotency_key"),
        "body",
    )


def retry_due(deliveries: DataFrame, delivery: Delivery, retry_after: str | None = None) -> DataFrame:
    """Failed deliveries that may be tried again, with the delay in milliseconds.

    ``retry_after`` names a column with the seconds a receiver asked for as
    text; it lengthens the delay up to the maximum.
    """
    ceiling = F.lit(delivery.backoff_max_ms).cast("double")
    doubled = F.lit(delivery.backoff_ms) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    delay = F.least(ceiling, doubled)
    if retry_after:
        asked = F.col(retry_after).try_cast("double") * 1000
        delay = F.when(asked.isNull(), delay).otherwise(
            F.greatest(delay, F.least(asked, ceiling))
        )
    due = (
        (F.col("status") == "failed")
        & (F.col("http_status").isNull() | F.col("http_status").isin(*RETRYABLE_STATUS))
        & (F.col("attempts") < delivery.max_attempts)
    )
    return deliveries.where(due).withColumn("delay_ms", delay.cast("bigint"))
