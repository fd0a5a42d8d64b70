"""Schemaless documents held as JSON text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import DEFAULT_FIND_LIMIT, Filter, Sort
from rowferry.functions.literals import named
from rowferry.functions.predicates import apply_filters, variant_filter
from rowferry.operators.paging import cut_page
from rowferry.session import freeze


ENTRIES = "map<string,variant>"


def field_of(column: str, name: str):
    """One field of the documents as a variant; its name may hold any character."""
    return F.from_json(named(column), ENTRIES)[name]


def document_types(df: DataFrame, column: str) -> DataFrame:
    """One row per path over all documents: path, types, objects, arrays.

    A path is a list of steps, a field name or NULL for the elements of an
    array. ``types`` is the common type of the plain values there, the counts
    tell how many values are objects and arrays. Names are values here, never
    part of a type's text, and each level of nesting is one aggregate by path
    that is reduced on the map side.
    """
    step = F.array(F.struct("name"))
    level = df.select(F.explode(F.from_json(named(column), ENTRIES)).alias("name", "value")).select(step.alias("path"), "value")
    found: DataFrame | None = None
    while True:
        shape = F.schema_of_variant("value")
        kinds = level.withColumn("object", shape.startswith("OBJECT")).withColumn("array", shape.startswith("ARRAY"))
        rows = freeze(
            kinds.groupBy("path").agg(
                F.schema_of_variant_agg(F.when(~F.col("object") & ~F.col("array"), F.col("value"))).alias("types"),
                F.count_if("object").alias("objects"),
                F.count_if("array").alias("arrays"),
            ),
            "paths",
        )
        found = rows if found is None else found.unionByName(rows)
        if rows.where("objects + arrays > 0").isEmpty():
            return found
        fields = kinds.where("object").select("path", F.explode(F.try_variant_get("value", "$", ENTRIES)).alias("name", "value"))
        items = kinds.where("array").select("path", F.lit(None).cast("string").alias("name"), F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("value"))
        level = fields.unionByName(items).select(F.concat("path", step).alias("path"), "value")


def _type_of(paths: dict[tuple, tuple], path: tuple) -> T.DataType:
    """The type of all values at a path; values of different kinds stay variants."""
    types, objects, arrays = paths[path]
    plain = types not in (None, "VOID")
    if plain + (objects > 0) + (arrays > 0) > 1:
        return T.VariantType()
    below = sorted((p for p in paths if p[:-1] == path), key=str)
    if objects:
        return T.StructType([T.StructField(p[-1], _type_of(paths, p)) for p in sorted(below, key=lambda p: p[-1].encode())])
    if arrays:
        return T.ArrayType(_type_of(paths, below[0]) if below else T.StringType())
    # NULL everywhere: kept as text
    return T._parse_datatype_string(types) if plain else T.StringType()  # noqa: SLF001


def document_schema(df: DataFrame, column: str) -> T.StructType:
    """Union of the fields over all documents."""
    paths = {
        tuple(step["name"] for step in r["path"]): (r["types"], r["objects"], r["arrays"]) for r in document_types(df, column).collect()
    }
    if not paths:
        raise ValueError(f"{column} holds no JSON objects")
    names = sorted((p for p in paths if len(p) == 1), key=lambda p: p[0].encode())
    return T.StructType([T.StructField(p[0], _type_of(paths, p)) for p in names])


def scan_documents(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Documents as a table whose columns are the union of all fields."""
    schema = document_schema(df, column)
    parsed = df.select(*keep, F.from_json(named(column), schema).alias("doc"))
    return parsed.select(*keep, "doc.*")


def document_fields(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per field: type where it first appears, and document count."""
    fields = (
        df.select(
            *order,
            # name and value together, so that a name may hold any character
            F.explode(F.from_json(F.col(column), "map<string,variant>")).alias("field", "value"),
        )
    )
    shape = F.schema_of_variant("value")
    field_type = (
        F.when(F.col("value").isNull() | F.is_variant_null("value"), "null")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .otherwise("number")
    )
    return fields.groupBy("field").agg(
        F.min_by(field_type, F.struct(*order)).alias("data_type"),
        F.count("*").alias("documents"),
        F.lit(True).alias("nullable"),
    )


def find_documents(
    df: DataFrame,
    filters: Iterable[Filter] = (),
    sort: Sequence[Sort] = (),
    limit: int = DEFAULT_FIND_LIMIT,
) -> DataFrame:
    """Filtered, sorted and limited documents; the top rows need no full sort."""
    rows = apply_filters(df, filters, "document")
    return cut_page(rows, sort, 0, limit) if sort else rows.limit(limit)


def matching_documents(df: DataFrame, column: str, filters: Iterable[Filter] = ()) -> DataFrame:
    """The rows whose document passes all filters, told from the text alone.

    No schema is needed, so nothing is read before the one scan of the rows.
    """
    for spec in filters:
        df = df.where(variant_filter(field_of(column, spec.column), spec))
    return df


def search_documents(
    df: DataFrame,
    column: str,
    fields: Mapping[str, str],
    filters: Iterable[Filter] = (),
    sort: Sequence[Sort] = (),
    limit: int = DEFAULT_FIND_LIMIT,
) -> DataFrame:
    """Named fields, with their types, of the matching documents: sorted and limited in one scan.

    A value that is not of the type asked for is NULL.
    """
    rows = matching_documents(df, column, filters).select(
        *[F.try_variant_get(field_of(column, name), "$", kind).alias(name) for name, kind in fields.items()]
    )
    return cut_page(rows, sort, 0, limit) if sort else rows.limit(limit)
