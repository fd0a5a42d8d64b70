"""Dumps, restores and exports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.text import (
    MICROS,
    bytes_untag,
    csv_cell,
    csv_escape,
    json_options,
    plain_text,
    quoted_name,
    row_json,
    sql_literal,
)
from rowferry.operators.merge import insert_rows, without_keys
from rowferry.sources.documents import document_fields
from rowferry.sources.keyspace import list_members, scan_keyspace

FORMAT = "rowferry-dump"
_MANIFEST = "manifest"


def dump_lines(name: str, df: DataFrame) -> DataFrame:
    """Rows of one table as JSON text; NULLs stay, bytes are tagged."""
    return df.select(F.lit(name).alias("table_name"), row_json(df.schema, MICROS).alias("line"))


def backup_json(
    tables: Mapping[str, DataFrame],
    path: str,
    primary_keys: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Write a portable dump: JSON lines per table plus a manifest.

    Every table is written by its own tasks; nothing passes through the
    driver but the schemas.
    """
    if not tables:
        raise ValueError("no table to dump")
    keys = primary_keys or {}
    manifest = [
        (FORMAT, 1, name, list(keys.get(name, ())), df.columns, df.schema.json())
        for name, df in tables.items()
    ]
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.select(row_json(df.schema, MICROS)).write.text(f"{path}/rows/{name}")
    # the manifest is written last: a dump without it is incomplete
    spark.createDataFrame(
        manifest,
        "format string, version int, name string, primary_key array<string>, "
        "columns array<string>, spark_schema string",
    ).write.json(f"{path}/{_MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> list[T.Row]:
    shape = (
        "format string, version int, name string, primary_key array<string>, "
        "columns array<string>, spark_schema string"
    )
    entries = spark.read.schema(shape).json(f"{path}/{_MANIFEST}").collect()
    if not entries or any(e["format"] != FORMAT for e in entries):
        raise ValueError(f"{path} is not a dump")
    return entries


def _restored(field: T.StructField, source: Column) -> Column:
    if isinstance(field.dataType, T.BinaryType):
        return bytes_untag(source)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return source.cast(field.dataType)
    return source


def _transport(field: T.StructField) -> T.StructField:
    """Type of a field inside the JSON lines."""
    if isinstance(field.dataType, (T.BinaryType, T.TimestampType, T.TimestampNTZType)):
        return T.StructField(field.name, T.StringType())
    return T.StructField(field.name, field.dataType)


def decode_lines(lines: DataFrame, schema: T.StructType, column: str = "line") -> DataFrame:
    """Rows of JSON text back in their types."""
    shape = T.StructType([_transport(f) for f in schema.fields])
    parsed = lines.select(F.from_json(F.col(column), shape, json_options(MICROS)).alias("row"))
    return parsed.select(
        *[_restored(f, F.col("row")[f.name]).alias(f.name) for f in schema.fields]
    )


def restore_json(
    spark: SparkSession, path: str, existing: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Tables of a dump with their true types.

    A missing table is created; rows are appended to one that exists.
    """
    present = existing or {}
    restored = {}
    for entry in read_manifest(spark, path):
        schema = T.StructType.fromJson(json.loads(entry["spark_schema"]))
        lines = spark.read.schema("value string").text(f"{path}/rows/{entry['name']}")
        rows = decode_lines(lines, schema, "value")
        current = present.get(entry["name"])
        restored[entry["name"]] = rows if current is None else insert_rows(current, rows)
    return restored


def backup_documents(df: DataFrame, column: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Documents as dump lines, and the union of their fields."""
    return df.select(F.col(column).alias("line")), document_fields(df, column, order)


def restore_documents(
    collection: DataFrame, documents: DataFrame, key: str = "_id", order: Sequence[str] = ()
) -> DataFrame:
    """Insert documents; those whose id exists already are passed over.

    Of equal ids the first in dump order, given by the ``order`` columns, is
    inserted; without them the ids of a dump are taken to be unique.
    """
    place = Window.partitionBy(key).orderBy(*order) if order else None
    first = documents
    if place is not None:
        ranked = documents.withColumn("_place", F.row_number().over(place)).where("_place = 1")
        first = ranked.drop("_place", *[c for c in order if c not in collection.columns])
    else:
        first = documents.dropDuplicates([key])
    return insert_rows(collection, without_keys(first, collection, [key]))


def backup_keyspace(keyspace: DataFrame) -> DataFrame:
    """Every key with its whole value as dump lines."""
    rows = scan_keyspace(keyspace, full=True).select("key", "type", "ttl", "value")
    value = F.when(F.col("type") == "string", F.to_json(F.array("value"))).otherwise(F.col("value"))
    text = F.when(F.col("type") == "string", F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return rows.select(
        F.concat(
            F.lit('{"key":'),
            _json_string(F.col("key")),
            F.lit(',"type":'),
            _json_string(F.col("type")),
            F.lit(',"ttl":'),
            F.coalesce(F.col("ttl").cast("string"), F.lit("null")),
            F.lit(',"value":'),
            F.coalesce(text, F.lit("null")),
            F.lit("}"),
        ).alias("line")
    )


def _json_string(column: Column) -> Column:
    boxed = F.to_json(F.array(column))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def restore_keyspace(keyspace: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace each restored key by its type; an expiry of 0 or less is dropped.

    Empty lists, sets, sorted sets and hashes leave no key, and a sorted set
    is rebuilt from its pairs. ``rows`` has one row per key.
    """
    flat = list_members(F.col("value"))
    kept = (
        F.when(F.col("type").isin("list", "set"), F.size(flat) > 0)
        .when(F.col("type") == "zset", F.size(flat) > 1)
        .when(F.col("type") == "hash", ~F.coalesce(F.col("value"), F.lit("{}")).isin("{}", ""))
        .otherwise(F.lit(True))
    )
    restored = (
        rows.where((F.col("key") != "") & F.coalesce(kept, F.lit(False)))
        .withColumn(
            "value",
            F.when(
                F.col("type") == "zset",
                # scores stay as they are written; a lone tail has no score
                F.to_json(F.slice(flat, 1, (F.floor(F.size(flat) / 2) * 2).cast("int"))),
            ).otherwise(F.col("value")),
        )
        .withColumn("ttl", F.when(F.col("ttl") > 0, F.col("ttl")).otherwise(-1).cast("bigint"))
    )
    return without_keys(keyspace, rows.where("key <> ''"), ["key"]).unionByName(
        restored.select(*keyspace.columns)
    )


def create_statement(
    table: str,
    columns: Sequence[tuple[str, str, bool]],
    primary_key: Sequence[str],
    dialect: str,
) -> str:
    """CREATE TABLE text of a dump from (name, type, nullable) columns."""
    lines = [
        f"  {quoted_name(name, dialect)} {kind}{'' if nullable else ' NOT NULL'}"
        for name, kind, nullable in columns
    ]
    if primary_key:
        names = ", ".join(quoted_name(k, dialect) for k in primary_key)
        lines.append(f"  PRIMARY KEY ({names})")
    body = ",\n".join(lines)
    return f"CREATE TABLE IF NOT EXISTS {quoted_name(table, dialect)} (\n{body}\n);"


def backup_sql(df: DataFrame, table: str, dialect: str) -> DataFrame:
    """One INSERT statement per row."""
    names = ", ".join(quoted_name(c, dialect) for c in df.columns)
    head = f"INSERT INTO {quoted_name(table, dialect)} ({names}) VALUES ("
    values = [sql_literal(F.col(f.name), f.dataType, dialect) for f in df.schema.fields]
    return df.select(
        F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("line")
    )


def write_sql_dump(
    df: DataFrame, table: str, dialect: str, path: str, types: Mapping[str, str],
    primary_key: Sequence[str] = (),
) -> None:
    """DDL and INSERT lines of one table as text files under ``path``."""
    columns = [(f.name, types[f.name], f.nullable and f.name not in primary_key) for f in df.schema]
    ddl = create_statement(table, columns, primary_key, dialect)
    df.sparkSession.createDataFrame([(ddl,)], "line string").write.text(f"{path}/ddl")
    backup_sql(df, table, dialect).write.text(f"{path}/rows")


def export_csv(df: DataFrame) -> DataFrame:
    """Rows as CSV lines: quoted where needed, NULL empty, nested values as JSON."""
    cells = [csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def csv_header(df: DataFrame) -> DataFrame:
    cells = [csv_escape(F.lit(name)) for name in df.columns]
    return df.sparkSession.range(1).select(F.concat_ws(",", *cells).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files, each with the header, in the quoting of :func:`export_csv`."""
    text = df.select(*[plain_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    text.write.option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_json(df: DataFrame) -> DataFrame:
    """Rows as JSON lines with NULL fields kept."""
    return df.select(row_json(df.schema).alias("line"))
