"""Log positions as sortable columns.

A position arrives as text whose text order is not the log order, so each
engine has an expression that turns it into a struct or number to sort by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LSN_LOW_RANGE = 4_294_967_296


def lsn_order(position: Column) -> Column:
    """``H/L`` in hexadecimal as one number; NULL when it cannot be read."""
    valid = position.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")

    def part(index: int) -> Column:
        return F.conv(F.split_part(position, F.lit("/"), F.lit(index)), 16, 10).cast(
            "decimal(20,0)"
        )

    number = (part(1) * F.lit(_LSN_LOW_RANGE).cast("decimal(20,0)") + part(2)).cast(
        "decimal(20,0)"
    )
    return F.when(valid, number)


def binlog_order(position: Column) -> Column:
    """``file:pos:row`` as a struct; a missing row is -1, a missing pos is 0."""
    full = r"^(.*):(\d+):(\d+)$"
    short = r"^(.*):([^:]*)$"
    is_full = position.rlike(full)
    is_short = position.rlike(short)

    def piece(pattern: str, group: int) -> Column:
        return F.regexp_extract(position, pattern, group)

    return F.struct(
        F.when(is_full, piece(full, 1))
        .when(is_short, piece(short, 1))
        .otherwise(position)
        .alias("file"),
        F.when(is_full, piece(full, 2).try_cast("bigint"))
        .when(is_short, F.coalesce(piece(short, 2).try_cast("bigint"), F.lit(0)))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("pos"),
        F.when(is_full, piece(full, 3).try_cast("bigint"))
        .otherwise(F.lit(-1).cast("bigint"))
        .alias("row"),
    )


def event_order(position: Column) -> dict[str, Column]:
    """``millis:counter`` of events without a durable position."""

    def part(index: int) -> Column:
        return F.split_part(position, F.lit(":"), F.lit(index)).try_cast("bigint")

    return {"order_millis": part(1), "order_counter": F.coalesce(part(2), F.lit(0).cast("bigint"))}


def _binlog_columns(position: Column) -> dict[str, Column]:
    order = binlog_order(position)
    return {f"order_{name}": order[name] for name in ("file", "pos", "row")}


POSITION_ORDER: dict[str, Callable[[Column], dict[str, Column]]] = {
    "postgres": lambda position: {"order_lsn": lsn_order(position)},
    "mysql": _binlog_columns,
    # resume tokens sort in log order as they are
    "mongodb": lambda position: {"order_token": position},
    "redis": event_order,
}
# These sources hand every event over as new, so no watermark applies.
WITHOUT_WATERMARK = ("mongodb", "redis")


def position_order(engine: str, position: Column) -> dict[str, Column]:
    """Sortable columns of a text position, by name and in order."""
    return POSITION_ORDER[engine](position)
