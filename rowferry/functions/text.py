"""Text forms of values: JSON, plain text, CSV cells and SQL literals."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
_STAMPS = (T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
# Digits of a second: payloads show milliseconds, dumps keep all that Spark has.
MILLIS, MICROS = 3, 6

# Dialect quote characters and boolean literals.
IDENTIFIER_QUOTES = {"postgres": '"', "mysql": "`", "sqlite": '"'}
BOOLEAN_LITERALS = {"postgres": ("TRUE", "FALSE"), "mysql": ("1", "0"), "sqlite": ("1", "0")}


def json_options(digits: int = MILLIS) -> dict[str, str]:
    """Options that make nested JSON agree with :func:`json_text`."""
    pattern = f"yyyy-MM-dd'T'HH:mm:ss.{'S' * digits}'Z'"
    return {
        "ignoreNullFields": "false",
        "timeZone": "UTC",
        "timestampFormat": pattern,
        "timestampNTZFormat": pattern,
    }


def iso_text(column: Column, dtype: T.DataType, digits: int = MILLIS) -> Column:
    """ISO text in UTC; no step depends on the session's time zone."""
    if isinstance(dtype, T.TimestampType):
        seconds = (F.unix_micros(column).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        column = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    shown = column.cast("string")
    clock = F.split_part(shown, F.lit(" "), F.lit(2))
    return F.concat(
        F.split_part(shown, F.lit(" "), F.lit(1)),
        F.lit("T"),
        F.substring(clock, 1, 8),
        F.lit("."),
        F.rpad(F.substring(clock, 10, digits), digits, "0"),
        F.lit("Z"),
    )


def number_text(column: Column) -> Column:
    """Shortest plain form: 5 for 5.0, 12345678.9 without an exponent."""
    size = F.abs(column)
    printed = column.cast("string")
    plain = F.regexp_replace(
        printed.try_cast("decimal(38,18)").cast("string"),
        r"\.?0+$",
        "",
    )
    exponent = F.regexp_replace(F.replace(printed, F.lit("E"), F.lit("e")), r"\.0e", "e")
    return (
        F.when(F.isnan(column) | (size == float("inf")), F.lit(None))
        .when(size < 1e-6, F.when(column == 0, F.lit("0")).otherwise(exponent))
        .when(
            (size < 1e15) & (column == F.floor(column)),
            F.floor(column).cast("long").cast("string"),
        )
        .when((size >= 1e-3) & (size < 1e7), printed)
        .when(size < 1e19, plain)
        .otherwise(exponent)
    )


def json_text(column: Column, dtype: T.DataType, digits: int = MILLIS) -> Column:
    """JSON text of one value; NULL becomes the word null."""
    if isinstance(dtype, _REAL):
        piece = number_text(column)
    elif isinstance(dtype, (*_WHOLE, T.DecimalType, T.BooleanType)):
        piece = column.cast("string")
    elif isinstance(dtype, _STAMPS):
        piece = F.concat(F.lit('"'), iso_text(column, dtype, digits), F.lit('"'))
    elif isinstance(dtype, T.BinaryType):
        piece = bytes_tag(column)
    elif isinstance(dtype, _NESTED):
        piece = F.to_json(column, json_options(digits))
    else:
        piece = quoted_json(column.cast("string"))
    return F.coalesce(piece, F.lit("null"))


def quoted_json(column: Column) -> Column:
    """A string as a JSON string; NULL stays NULL."""
    boxed = F.to_json(F.array(column))
    return F.when(column.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def json_object(members: list[tuple[str, Column, T.DataType]], digits: int = MILLIS) -> Column:
    """JSON object text from (key, value, type) members."""
    pieces = [
        F.concat(F.lit(json.dumps(key, ensure_ascii=False) + ":"), json_text(value, dtype, digits))
        for key, value, dtype in members
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def row_json(schema: T.StructType, digits: int = MILLIS) -> Column:
    """JSON object text of a whole row; NULL fields are kept."""
    return json_object([(f.name, F.col(f"`{f.name}`"), f.dataType) for f in schema.fields], digits)


def plain_text(column: Column, dtype: T.DataType) -> Column:
    """Text of a value for use inside other text; NULL becomes ''."""
    if isinstance(dtype, _REAL):
        shown = number_text(column)
    elif isinstance(dtype, _STAMPS):
        shown = iso_text(column, dtype)
    elif isinstance(dtype, T.BinaryType):
        shown = bytes_tag(column)
    elif isinstance(dtype, _NESTED):
        shown = F.to_json(column, json_options())
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit(""))


def csv_escape(column: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(column.rlike('[",\\n\\r]'), doubled).otherwise(column)


def csv_cell(column: Column, dtype: T.DataType) -> Column:
    return csv_escape(plain_text(column, dtype))


def quote_ident(name: Column | str, dialect: str) -> Column:
    mark = IDENTIFIER_QUOTES[dialect]
    column = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit(mark), F.replace(column, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def quoted_name(name: str, dialect: str) -> str:
    """Plan-time counterpart of :func:`quote_ident`."""
    mark = IDENTIFIER_QUOTES[dialect]
    return mark + name.replace(mark, mark * 2) + mark


def sql_literal(column: Column, dtype: T.DataType, dialect: str) -> Column:
    if isinstance(dtype, T.BooleanType):
        yes, no = BOOLEAN_LITERALS[dialect]
        shown = F.when(column, F.lit(yes)).otherwise(F.lit(no))
    elif isinstance(dtype, _REAL):
        shown = number_text(column)
    elif isinstance(dtype, (*_WHOLE, T.DecimalType)):
        shown = column.cast("string")
    elif isinstance(dtype, T.BinaryType):
        opening = "'\\x" if dialect == "postgres" else "X'"
        shown = F.concat(F.lit(opening), F.lower(F.hex(column)), F.lit("'"))
    else:
        body = F.replace(plain_text(column, dtype), F.lit("'"), F.lit("''"))
        if dialect == "mysql":
            body = F.replace(body, F.lit("\\"), F.lit("\\\\"))
        shown = F.concat(F.lit("'"), body, F.lit("'"))
    return F.when(column.isNull(), F.lit("NULL")).otherwise(shown)


def bytes_tag(column: Column) -> Column:
    """``{"$bytes": base64}`` text of a binary value."""
    return F.concat(F.lit('{"$bytes":"'), F.translate(F.base64(column), "\r\n", ""), F.lit('"}'))


def bytes_untag(column: Column) -> Column:
    """Binary value of a tag; the older byte-array form is read too."""
    tagged = F.unbase64(F.get_json_object(column, "$['$bytes']"))
    listed = F.from_json(F.get_json_object(column, "$.data"), "array<int>")
    older = F.unhex(
        F.array_join(F.transform(listed, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )
    return F.coalesce(
        tagged, F.when(F.get_json_object(column, "$.type") == "Buffer", older)
    )


def json_array(columns: list[tuple[Column, T.DataType]]) -> Column:
    pieces = [json_text(column, dtype) for column, dtype in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *pieces), F.lit("]"))


def row_key(schema: T.StructType, keys: list[str] | tuple[str, ...] = ()) -> Column:
    """Stable identity text: key values in key order, else all values by name."""
    names = list(keys) or sorted(schema.names)
    return json_array([(F.col(f"`{name}`"), schema[name].dataType) for name in names])
