"""Python values as literals that keep comparisons free of casts."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_literal(value: Any) -> Column:
    """A literal of the value; a datetime without zone stays without zone.

    The plain literal of such a datetime would be an instant, and comparing a
    zoneless column with it casts the column and blocks pushdown.
    """
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)
