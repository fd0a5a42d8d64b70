"""Column mapping, renaming and value coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import ColumnMapping
from rowferry.functions.literals import named
from rowferry.functions.text import iso_text, json_text

_OBJECTS = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def map_columns(df: DataFrame, mapping: Sequence[ColumnMapping] = ()) -> DataFrame:
    """Project rows on the target's columns.

    An empty mapping keeps every column. A source column that is missing gives
    NULL; columns that no entry names are dropped.
    """
    if not mapping:
        return df
    present = set(df.columns)
    return df.select(
        *[
            (named(m.source) if m.source in present else F.lit(None).cast("string")).alias(
                m.target
            )
            for m in mapping
        ]
    )


def source_column_for(targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source column that feeds each target column; unmapped ones feed themselves.

    ``targets`` has ``target``; ``mapping`` has ``position``, ``source`` and
    ``target``, and the first entry of a target wins.
    """
    first = mapping.groupBy("target").agg(F.min_by("source", "position").alias("source"))
    return targets.join(first, "target", "left").withColumn(
        "source", F.coalesce("source", "target")
    )


def project_fields_rename(
    df: DataFrame, fields: Sequence[str] = (), rename: dict[str, str] | None = None
) -> DataFrame:
    """Keep the listed fields in table order, then rename them."""
    names = rename or {}
    kept = [c for c in df.columns if not fields or c in fields]
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in kept])


def coerce_for_target(df: DataFrame, engine: str) -> DataFrame:
    """Values in the form that the engine can store."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, _OBJECTS) and engine in ("sqlite", "mysql"):
            column = F.when(column.isNotNull(), json_text(column, kind))
        elif engine == "sqlite" and isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif engine == "sqlite" and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = iso_text(column, kind)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Text shapes accepted per type, the narrowest first.
VALUE_SHAPES = (
    ("boolean", r"^(true|false)$"),
    ("integer", r"^-?\d{1,9}$"),
    ("bigint", r"^-?\d{1,18}$"),
    ("double", r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?$"),
    ("json", r"^(\{.*\}|\[.*\])$"),
)


def infer_value_types(df: DataFrame) -> DataFrame:
    """Type of each text column from all of its values, one row per column."""
    names = df.columns
    tallies = []
    for i, name in enumerate(names):
        tallies.append(F.count(name).alias(f"n_{i}"))
        for kind, shape in VALUE_SHAPES:
            tallies.append(F.count_if(F.col(name).rlike("(?s)" + shape)).alias(f"{kind}_{i}"))
    wide = df.agg(*tallies)
    entries = []
    for i, name in enumerate(names):
        chosen = F.lit("text")
        for kind, _ in reversed(VALUE_SHAPES):
            fits = (F.col(f"{kind}_{i}") == F.col(f"n_{i}")) & (F.col(f"n_{i}") > 0)
            chosen = F.when(fits, kind).otherwise(chosen)
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                chosen.alias("data_type"),
                F.col(f"n_{i}").alias("value_count"),
            )
        )
    return wide.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def coerce_object_ids(df: DataFrame, column: str = "_id") -> DataFrame:
    """Add the 12-byte form of ids that are 24 hex digits, and their text form."""
    valid = F.col(column).rlike("^[0-9a-fA-F]{24}$")
    binary = F.when(valid, F.unhex(column))
    return df.withColumn(f"{column}_bytes", binary).withColumn(
        f"{column}_text", F.coalesce(F.lower(F.hex(binary)), F.col(column))
    )
