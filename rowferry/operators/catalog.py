"""Schema introspection as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").withColumnRenamed("namespace", "database_name")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Relations of the session catalog with their kind."""
    text = "SHOW TABLES" + (" IN IDENTIFIER(:name)" if database else "")
    rows = spark.sql(text, args={"name": database} if database else None)
    return rows.select(
        F.col("namespace").alias("schema_name"),
        F.col("tableName").alias("table_name"),
        F.when(F.col("isTemporary"), "view").otherwise("table").alias("kind"),
    )


def list_relations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, column count and row count of given relations, each counted in parallel."""
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            "row_count",
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def describe_columns(
    columns: DataFrame, keys: DataFrame, foreign_keys: DataFrame
) -> DataFrame:
    """One row per column with key flags and the column it refers to.

    ``columns`` has schema_name, table_name, column_name, ordinal, data_type
    and nullable; ``keys`` the key columns with ``is_primary``;
    ``foreign_keys`` one column per key, of which the first by name is shown.
    """
    place = ["schema_name", "table_name", "column_name"]
    flags = keys.groupBy(*place).agg(
        F.bool_or("is_primary").alias("is_primary_key"),
        F.bool_or("is_unique").alias("is_unique"),
    )
    references = foreign_keys.groupBy(*place).agg(
        F.min_by("referenced_table", "fk_name").alias("references_table")
    )
    return (
        columns.join(flags, place, "left")
        .join(references, place, "left")
        .select(
            *place,
            "ordinal",
            "data_type",
            (F.col("nullable") & ~F.coalesce("is_primary_key", F.lit(False))).alias("nullable"),
            F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
            F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
            "references_table",
        )
    )


def schema_columns(name: str, df: DataFrame, primary_key: Sequence[str] = ()) -> DataFrame:
    """The columns of a DataFrame as catalog rows."""
    rows = [
        (name, f.name, i + 1, f.dataType.simpleString(), f.nullable, f.name in primary_key)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "table_name string, column_name string, ordinal int, data_type string, "
        "nullable boolean, is_primary_key boolean",
    )


def describe_keys(key_columns: DataFrame) -> DataFrame:
    """One row per key, index or foreign key with its columns in key order.

    A key has a handful of columns, so each group is small.
    """
    grouped = key_columns.groupBy("schema_name", "table_name", "key_name", "key_kind").agg(
        F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("parts")
    )
    return grouped.select(
        "schema_name",
        "table_name",
        "key_name",
        "key_kind",
        F.array_join(F.transform("parts", lambda p: p["column_name"]), ",").alias("columns"),
        F.size("parts").cast("bigint").alias("column_count"),
    )


def search_catalog(tables: DataFrame, text: str) -> DataFrame:
    """Relations whose name contains the text, ignoring case."""
    return tables.where(F.contains(F.lower("table_name"), F.lit(text.lower())))
