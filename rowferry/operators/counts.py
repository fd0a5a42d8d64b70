"""Counts and cursor aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.config import Filter
from rowferry.functions.predicates import apply_filters


def count_rows(df: DataFrame, filters: Iterable[Filter] = (), dialect: str = "sql") -> DataFrame:
    """Exact number of rows that match the filters."""
    return apply_filters(df, filters, dialect).agg(
        F.count("*").alias("total"), F.lit(False).alias("estimated")
    )


def count_estimated(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    """Cheap total flagged as an estimate; unknown when filters apply.

    Without filters the scan has an empty read schema, so parquet answers from
    the row counts in its footers.
    """
    if list(filters):
        return df.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("total"), F.lit(True).alias("estimated")
        )
    return df.agg(F.count("*").alias("total"), F.lit(True).alias("estimated"))


def analyzed_count(df: DataFrame, table: str) -> int | None:
    """Row count in the catalog statistics of a saved table, if analyzed."""
    rows = df.sparkSession.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'")
    found = rows.select(F.regexp_extract("data_type", r"(\d+) rows", 1)).first()
    return int(found[0]) if found and found[0] else None


def cursor_max(df: DataFrame, column: str, alias: str = "cursor") -> DataFrame:
    """Largest value of a tracked column; NULLs never count."""
    return df.agg(F.max(column).alias(alias))


def key_candidates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the key columns identify every row."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(has_null, F.col("_rows")).otherwise(0)), F.lit(0)).alias(
            "null_keys"
        ),
        F.coalesce((F.max("_rows") == 1) & ~F.bool_or(has_null), F.lit(True)).alias("is_key"),
    )


def table_stats(df: DataFrame) -> DataFrame:
    """One row per column: rows, NULLs and an approximate distinct count.

    One pass with fixed-size sketches; exact distinct counts of many columns
    would multiply the rows.
    """
    names = df.columns
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(n).isNull()).alias(f"nulls_{i}") for i, n in enumerate(names)],
        *[F.approx_count_distinct(n).alias(f"distinct_{i}") for i, n in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col("rows").alias("row_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            F.col(f"distinct_{i}").alias("approx_distinct"),
        )
        for i, n in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")
