"""Timestamps given as stamps, ISO text or epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ts_norm(column: Column, dtype: T.DataType) -> Column:
    """Comparable value with microseconds kept; text that is no stamp is NULL."""
    if isinstance(dtype, T.TimestampNTZType):
        return column
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        seconds = (column.cast("decimal(21,3)") / 1000).cast("decimal(18,6)")
        return _epoch() + F.make_dt_interval(secs=seconds)
    return column.cast("string").try_cast("timestamp_ntz")
