"""Portable column types and their spelling per engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of source type names per portable type, tried in order.
TYPE_PATTERNS = (
    ("uuid", r"(^| )uuid"),
    ("boolean", r"bool"),
    ("timestamp", r"timestamp|datetime|^date$| date|time with|time without"),
    ("json", r"json|jsonb|object|array|bson"),
    ("bigint", r"bigint|int8|long"),
    ("integer", r"serial|^int|integer|int4|int2|smallint|tinyint|mediumint"),
    ("number", r"numeric|decimal|real|double|float|money|number"),
)

# Column type per engine and portable type.
ENGINE_TYPES = {
    "postgres": {
        "integer": "INTEGER",
        "bigint": "BIGINT",
        "number": "DOUBLE PRECISION",
        "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP",
        "json": "JSONB",
        "uuid": "UUID",
        "text": "TEXT",
    },
    "mysql": {
        "integer": "INT",
        "bigint": "BIGINT",
        "number": "DOUBLE",
        "boolean": "TINYINT(1)",
        "timestamp": "DATETIME",
        "json": "JSON",
        "uuid": "CHAR(36)",
        "text": "TEXT",
    },
    "mssql": {
        "integer": "INT",
        "bigint": "BIGINT",
        "number": "FLOAT",
        "boolean": "BIT",
        "timestamp": "DATETIME2",
        "json": "NVARCHAR(MAX)",
        "uuid": "UNIQUEIDENTIFIER",
        "text": "NVARCHAR(MAX)",
    },
    "sqlite": {
        "integer": "INTEGER",
        "bigint": "INTEGER",
        "number": "REAL",
        "boolean": "INTEGER",
        "timestamp": "TEXT",
        "json": "TEXT",
        "uuid": "TEXT",
        "text": "TEXT",
    },
}

# Types that need another spelling when the column is a key.
KEY_TYPES = {
    "mysql": {"uuid": "VARCHAR(255)", "text": "VARCHAR(255)"},
    "mssql": {"text": "NVARCHAR(255)"},
}

# Spark type created for each portable type.
SPARK_TYPES = {
    "uuid": "string",
    "boolean": "boolean",
    "timestamp": "timestamp_ntz",
    "json": "string",
    "bigint": "bigint",
    "integer": "int",
    "number": "double",
    "text": "string",
}

# Words accepted as a column default, besides numbers and quoted text.
DEFAULT_WORDS = (
    "current_timestamp",
    "current_date",
    "current_time",
    "now()",
    "null",
    "true",
    "false",
    "gen_random_uuid()",
    "uuid()",
)
SAFE_NAME = r"^[A-Za-z_][A-Za-z0-9_$]*$"
SAFE_TYPE = r"^[A-Za-z0-9_ (),]+$"
DEFAULT_NUMBER = r"^-?\d+(\.\d+)?$"
DEFAULT_TEXT = r"^'([^'\\]|'')*'$"
MAX_NAME_LENGTH = 128


def portable_type(type_name: Column) -> Column:
    lowered = F.lower(F.coalesce(type_name, F.lit("")))
    chosen = F.lit("text")
    for portable, pattern in reversed(TYPE_PATTERNS):
        chosen = F.when(lowered.rlike(pattern), portable).otherwise(chosen)
    return chosen


def engine_type(portable: Column, is_key: Column, engine: str) -> Column:
    spelling = ENGINE_TYPES.get(engine, ENGINE_TYPES["sqlite"])
    key_spelling = {**spelling, **KEY_TYPES.get(engine, {})}

    def lookup(table: dict[str, str]) -> Column:
        pairs = [F.lit(item) for entry in table.items() for item in entry]
        return F.create_map(*pairs)[portable]

    return F.when(is_key, lookup(key_spelling)).otherwise(lookup(spelling))


def is_safe_name(name: Column) -> Column:
    return name.rlike(SAFE_NAME) & (F.length(name) <= MAX_NAME_LENGTH)


def is_safe_type(type_name: Column) -> Column:
    return F.trim(type_name).rlike(SAFE_TYPE)


def is_safe_default(value: Column) -> Column:
    """Number, quoted text or listed word; an absent default is fine."""
    trimmed = F.trim(value)
    return (
        value.isNull()
        | (trimmed == "")
        | trimmed.rlike(DEFAULT_NUMBER)
        | trimmed.rlike(DEFAULT_TEXT)
        | F.lower(trimmed).isin(*DEFAULT_WORDS)
    )
