"""Aggregated join sides that leave the other side divisible.

AQE can split a hot partition of a join only when both sides come straight
from a shuffle. A side that was just aggregated by the join keys is already
placed by them, so Spark skips its shuffle and with it the split. Grouping by a
struct of the keys makes the planner shuffle the (small, unique) result once
more and keeps the hot side divisible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "_key_struct"


def group_for_join(df: DataFrame, keys: dict[str, Column], *aggregates: Column) -> DataFrame:
    """One row per key with the aggregates, reduced on the map side first."""
    packed = F.struct(*[column.alias(name) for name, column in keys.items()])
    grouped = df.groupBy(packed.alias(_KEY))
    rows = grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias("_one")).drop("_one")
    return rows.select(f"{_KEY}.*", *[c for c in rows.columns if c != _KEY])


def keys_for_join(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys as a join side."""
    packed = df.select(F.struct(*keys).alias(_KEY)).distinct()
    return packed.select(f"{_KEY}.*")
