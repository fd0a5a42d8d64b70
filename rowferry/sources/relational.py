"""Table, query and JDBC sources."""

from __future__ import annotations

import decimal
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.config import Filter, Sort
from rowferry.functions.literals import named
from rowferry.functions.predicates import apply_filters
from rowferry.operators.paging import sort_rows
from rowferry.session import freeze


def load_table(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def scan_table(
    table: DataFrame,
    filters: Iterable[Filter] = (),
    sort: Sequence[Sort] = (),
    columns: Sequence[str] = (),
    dialect: str = "sql",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Read one relation; filters and the column list reach the file scan.

    With a sort, ``keys`` break ties, so that a sort value that covers a large
    part of the rows is still split over tasks.
    """
    rows = apply_filters(table, filters, dialect)
    if sort:
        rows = sort_rows(rows, sort, keys)
    return rows.select(*columns) if columns else rows


def scan_query(
    spark: SparkSession,
    text: str,
    args: dict[str, Any] | list[Any] | None = None,
    max_rows: int | None = None,
    refuse_truncated: bool = False,
) -> DataFrame:
    """Rows of a query over registered views.

    With ``max_rows`` the page carries a ``truncated`` flag taken from one row
    beyond the cap; ``refuse_truncated`` raises instead, as a bulk copy must
    not be silently short.
    """
    rows = spark.sql(text, args=args)
    if max_rows is None:
        return rows
    # the query runs once; at most one row more than the cap is kept
    # and the ordinal of each kept row tells which one is beyond it
    kept = rows.limit(max_rows + 1).withColumn("_ordinal", F.monotonically_increasing_id())
    probe = freeze(kept, "query")
    truncated = probe.count() > max_rows
    if truncated and refuse_truncated:
        raise ValueError(f"the query returns more than {max_rows} rows")
    # a limit leaves one partition, whose ordinals count from 0
    return probe.where(F.col("_ordinal") < max_rows).drop("_ordinal").withColumn("truncated", F.lit(truncated))


def key_ranges(column: str, low: int, high: int, parts: int) -> list[str]:
    """SQL predicates that split a numeric key into disjoint ranges.

    The outer ranges are open and the first one takes NULL keys, so every row
    falls in exactly one range whatever happens between the probe and the read.
    """
    if parts < 1:
        raise ValueError("at least one range is needed")
    width = max(1, -(-(high - low + 1) // parts))
    cuts = [low + width * i for i in range(1, parts) if low + width * i <= high]
    if not cuts:
        return [f"{column} = {column} OR {column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [
        f"{column} < {cuts[0]} OR {column} IS NULL",
        *inner,
        f"{column} >= {cuts[-1]}",
    ]


def key_cuts(keys: DataFrame, column: str, parts: int, per_part: int = 400, rows: int | None = None) -> list[Any]:
    """Values that split the rows by any ordered key into parts of about equal size.

    They are quantiles of a sample of about ``parts * per_part`` keys, picked by
    a hash, which is what comes to the driver. A value that many rows share is
    one cut at most, so a part may be larger by the rows of one value.
    """
    if parts < 1:
        raise ValueError("at least one range is needed")
    known = keys.select(named(column).alias("k")).where("k IS NOT NULL")
    step = max(1, (known.count() if rows is None else rows) // (parts * per_part))
    # rows are picked, not values: a frequent value counts as often as it comes
    picked = known.select("k", F.monotonically_increasing_id().alias("at")).where(F.pmod(F.xxhash64("at"), F.lit(step)) == 0)
    sample = [r["k"] for r in picked.select("k").orderBy("k").collect()]
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    return [c for c, before in zip(cuts, [*sample[:1], *cuts]) if c != before]


def sql_text(value: Any) -> str:
    """A key value as a SQL literal."""
    if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)):
        return "'" + str(value).replace("'", "''") + "'"
    return str(value)


def range_predicates(column: str, cuts: Sequence[Any], quote: str = '"') -> list[str]:
    """SQL predicates of the ranges between the cuts; each row falls in exactly one."""
    name = quote + column.replace(quote, quote * 2) + quote
    if not cuts:
        return [f"{name} = {name} OR {name} IS NULL"]
    inner = [f"{name} >= {sql_text(a)} AND {name} < {sql_text(b)}" for a, b in zip(cuts, cuts[1:])]
    return [f"{name} < {sql_text(cuts[0])} OR {name} IS NULL", *inner, f"{name} >= {sql_text(cuts[-1])}"]


def scan_jdbc_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    parts: int,
    filters: Iterable[Filter] = (),
    properties: dict[str, str] | None = None,
    cuts: Sequence[Any] | None = None,
) -> DataFrame:
    """Read a relational source in parallel key ranges, one task per range.

    Filters are pushed into the statement that each range sends. A key that is
    no whole number, or that is spread unevenly, is split at given ``cuts``
    (:func:`key_cuts` of a sample or of an earlier copy).
    """
    options = {"fetchsize": "10000", **(properties or {})}
    if cuts is not None:
        rows = spark.read.jdbc(url, table, predicates=range_predicates(column, cuts), properties=options)
        return apply_filters(rows, filters)
    probe = spark.read.jdbc(
        url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b",
        properties=options,
    ).first()
    bounds = (int(probe[0]), int(probe[1])) if probe and probe[0] is not None else (0, 0)
    predicates = key_ranges(column, *bounds, parts)
    rows = spark.read.jdbc(url, table, predicates=predicates, properties=options)
    return apply_filters(rows, filters)


def write_jdbc(
    rows: DataFrame,
    url: str,
    table: str,
    connections: int = 8,
    properties: dict[str, str] | None = None,
) -> None:
    """Append rows to a relational target over a bounded number of connections.

    JDBC has no upsert: write to a staging table and merge it in the database.
    """
    options = {"batchsize": "1000", "numPartitions": str(connections), **(properties or {})}
    rows.write.jdbc(url, table, mode="append", properties=options)
