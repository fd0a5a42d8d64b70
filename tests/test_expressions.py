"""Filters, text forms, types and positions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowferry.config import Delivery, Filter, Sort, Target, WatchStrategy
from rowferry.functions.positions import binlog_order, lsn_order
from rowferry.functions.predicates import compile_filter, compile_filters, glob_pattern
from rowferry.functions.text import (
    bytes_untag,
    csv_cell,
    json_text,
    number_text,
    plain_text,
    quote_ident,
    row_key,
    sql_literal,
)
from rowferry.functions.types import is_safe_default, is_safe_name, portable_type
from rowferry.operators.ddl import ColumnSpec, TableSpec, apply_defaults, create_table


def one(spark, value, kind, build):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v"), df.schema["v"].dataType)).first()[0]


def test_unknown_operator_is_refused():
    with pytest.raises(ValueError, match="unsupported"):
        compile_filter(Filter("a", "like", 1))


@pytest.mark.parametrize("operator", ["eq", "neq", "lt", "lte", "gt", "gte"])
def test_document_operand_must_be_scalar(spark, operator):
    with pytest.raises(ValueError, match="scalar"):
        compile_filter(Filter("a", operator, {"$gt": ""}), "document")


def test_null_semantics_per_dialect(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")

    def ids(spec, dialect):
        return [r[0] for r in rows(df.where(compile_filters([spec], dialect)), "id")]

    assert ids(Filter("s", "neq", "a"), "sql") == [3]
    assert ids(Filter("s", "neq", "a"), "document") == [2, 3]
    assert ids(Filter("s", "eq", None), "sql") == []
    assert ids(Filter("s", "eq", None), "document") == [2]
    assert ids(Filter("s", "neq", None), "document") == [1, 3]
    assert ids(Filter("s", "in", ["a", None]), "document") == [1, 2]
    assert ids(Filter("s", "in", []), "sql") == []


def test_wildcards_stay_active_in_sql_only(spark, rows):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("axb",)], "s string")

    def found(value, dialect):
        return [r[0] for r in rows(df.where(compile_filter(Filter("s", "contains", value), dialect)))]

    assert found("50%", "document") == ["50% off"]
    assert found("50%", "sql") == ["50% off", "500 off"]
    assert found("A_B", "document") == ["a_b"]
    assert found("A_B", "sql") == ["a_b", "axb"]


def test_filter_values_reach_the_scan(spark, tables):
    day = dt.datetime(1998, 1, 1)
    df = tables.orders.where(
        compile_filters([Filter("o_orderdate", "gte", day), Filter("o_custkey", "eq", 5)])
    ).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_custkey,5)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_glob_keeps_other_characters_literal():
    assert glob_pattern("a.b*c?") == r"^a\.b.*c.$"


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (5.0, "5"),
        (-0.5, "-0.5"),
        (12345678.9, "12345678.9"),
        (0.0001, "0.0001"),
        (1e-7, "1e-7"),
        (1e21, "1e21"),
        (123456789012345680.0, "123456789012345680"),
        (0.0, "0"),
        (float("nan"), None),
    ],
)
def test_number_text(spark, value, text):
    assert one(spark, value, "double", lambda c, _: number_text(c)) == text


def test_json_text_of_each_type(spark):
    assert one(spark, 'a"b\n', "string", json_text) == '"a\\"b\\n"'
    assert one(spark, None, "string", json_text) == "null"
    assert one(spark, True, "boolean", json_text) == "true"
    assert one(spark, 2.0, "double", json_text) == "2"
    assert one(spark, dt.datetime(2024, 1, 2, 3, 4, 5, 678000), "timestamp_ntz", json_text) == '"2024-01-02T03:04:05.678Z"'
    assert one(spark, [1, 2], "array<int>", json_text) == "[1,2]"
    assert one(spark, (1, None), "struct<a:int,b:string>", json_text) == '{"a":1,"b":null}'
    assert one(spark, bytearray(b"\x00\x01"), "binary", json_text) == '{"$bytes":"AAE="}'


def test_plain_text_of_missing_is_empty(spark):
    assert one(spark, None, "string", plain_text) == ""
    assert one(spark, {"a": 1}, "map<string,int>", plain_text) == '{"a":1}'


def test_bytes_round_trip_both_forms(spark):
    raw = bytes([0, 1, 2, 250, 255])
    tagged = one(spark, bytearray(raw), "binary", json_text)
    assert bytes(one(spark, tagged, "string", lambda c, _: bytes_untag(c))) == raw
    older = '{"type":"Buffer","data":[0,1,2,250,255]}'
    assert bytes(one(spark, older, "string", lambda c, _: bytes_untag(c))) == raw


def test_long_bytes_are_one_line(spark):
    raw = bytes(range(256)) * 4
    tagged = one(spark, bytearray(raw), "binary", json_text)
    assert "\r" not in tagged and bytes(one(spark, tagged, "string", lambda c, _: bytes_untag(c))) == raw


@pytest.mark.parametrize(
    ("value", "kind", "dialect", "text"),
    [
        (None, "string", "sqlite", "NULL"),
        ("it's", "string", "postgres", "'it''s'"),
        ("a\\'b", "string", "mysql", "'a\\\\''b'"),
        (True, "boolean", "postgres", "TRUE"),
        (False, "boolean", "sqlite", "0"),
        (bytearray(b"hi"), "binary", "sqlite", "X'6869'"),
        (bytearray(b"hi"), "binary", "postgres", "'\\x6869'"),
        (7, "int", "sqlite", "7"),
    ],
)
def test_sql_literal(spark, value, kind, dialect, text):
    assert one(spark, value, kind, lambda c, t: sql_literal(c, t, dialect)) == text


def test_csv_cell_quotes_when_needed(spark):
    assert one(spark, 'say "x",\n', "string", csv_cell) == '"say ""x"",\n"'
    assert one(spark, "plain", "string", csv_cell) == "plain"
    assert one(spark, None, "int", csv_cell) == ""


def test_identifier_quotes_are_doubled(spark):
    assert one(spark, 'a"b', "string", lambda c, _: quote_ident(c, "postgres")) == '"a""b"'
    assert one(spark, "a`b", "string", lambda c, _: quote_ident(c, "mysql")) == "`a``b`"


def test_row_key_falls_back_to_all_values_by_name(spark):
    df = spark.createDataFrame([(2, "x", None)], "b int, a string, c string")
    assert df.select(row_key(df.schema, ["b"]), row_key(df.schema)).first()[:] == ("[2]", '["x",2,null]')


# Type names and the portable type expected of each.
EXPECTED_TYPES = {
    "varchar(255)": "text",
    "bigint": "bigint",
    "integer": "integer",
    "timestamp with time zone": "timestamp",
    "jsonb": "json",
    "boolean": "boolean",
    "uuid": "uuid",
    "numeric(10,2)": "number",
    "interval": "integer",
    "longtext": "bigint",
    "longblob": "bigint",
    "bigserial": "integer",
    "objectId": "json",
    "bytea": "text",
    "time": "text",
    "time without time zone": "timestamp",
    "decimal(38,10)": "number",
    "date": "timestamp",
    "ARRAY": "json",
    "tinyint(1)": "integer",
    "int unsigned": "integer",
    "bit": "text",
    "uuid[]": "uuid",
}


def test_portable_types(spark):
    df = spark.createDataFrame(list(EXPECTED_TYPES.items()), "name string, wanted string")
    assert df.where(portable_type(F.col("name")) != F.col("wanted")).collect() == []


@pytest.mark.parametrize(
    ("value", "ok"),
    [
        ("42", True),
        ("-1.5", True),
        ("'it''s ok'", True),
        ("CURRENT_TIMESTAMP", True),
        ("now()", True),
        ("  true ", True),
        ("1; drop table x", False),
        ("'a' || 'b'", False),
        ("'\\'", False),
        ("random()", False),
    ],
)
def test_default_grammar(spark, value, ok):
    assert one(spark, value, "string", lambda c, _: is_safe_default(c)) is ok
    spec = TableSpec("t", (ColumnSpec("a", "text", default=value),))
    if ok:
        create_table(spark, spec)
    else:
        with pytest.raises(ValueError, match="default"):
            create_table(spark, spec)


def test_names_are_checked(spark):
    assert one(spark, "a_1$", "string", lambda c, _: is_safe_name(c))
    assert not one(spark, "1a", "string", lambda c, _: is_safe_name(c))
    with pytest.raises(ValueError, match="identifier"):
        create_table(spark, TableSpec("bad name", (ColumnSpec("a", "text"),)))
    with pytest.raises(ValueError, match="composite"):
        create_table(
            spark,
            TableSpec(
                "t",
                (
                    ColumnSpec("id", "integer", primary_key=True, auto_increment=True),
                    ColumnSpec("other", "text", primary_key=True),
                ),
            ),
        )
    with pytest.raises(ValueError, match="column"):
        create_table(spark, TableSpec("t", ()))


def test_defaults_fill_absent_columns_only(spark):
    table = create_table(
        spark,
        TableSpec(
            "safe_defaults",
            (
                ColumnSpec("id", "integer", primary_key=True),
                ColumnSpec("n", "integer", default="42"),
                ColumnSpec("label", "text", default="'it''s ok'"),
                ColumnSpec("at", "text", default="CURRENT_TIMESTAMP"),
            ),
        ),
    )
    given = spark.createDataFrame([(1, None)], "id int, label string")
    row = apply_defaults(given, table).first()
    assert (row["id"], row["n"], row["label"]) == (1, 42, None) and row["at"] is not None


def test_positions_sort_as_numbers(spark):
    lsn = lambda v: one(spark, v, "string", lambda c, _: lsn_order(c))
    assert lsn("0/FFFFFFFF") < lsn("1/0") < lsn("A/1")
    assert lsn("nonsense") is None and lsn("FFFFFFFF/FFFFFFFF") == 2**64 - 1
    log = lambda v: tuple(one(spark, v, "string", lambda c, _: binlog_order(c)))
    assert log("binlog.000002:4:9") < log("binlog.000002:4:10") < log("binlog.000002:12:0")
    assert log("binlog.1:77") == ("binlog.1", 77, -1)
    assert log("plain") == ("plain", 0, -1) and log("f:x") == ("f", 0, -1)


def test_configuration_is_checked():
    for build in (
        lambda: Delivery(batch_size=0),
        lambda: Delivery(max_attempts=11),
        lambda: Delivery(on_error="retry"),
        lambda: Sort("a", "down"),
        lambda: Target("t", write_mode="merge"),
        lambda: WatchStrategy("increment"),
        lambda: WatchStrategy("snapshot", max_tracked=5),
        lambda: WatchStrategy("poll", "a"),
    ):
        with pytest.raises(ValueError):
            build()


def test_names_with_dots_and_quotes(spark):
    from rowferry.config import ColumnMapping, Filter, Sort
    from rowferry.functions.predicates import compile_filter
    from rowferry.operators.projection import map_columns
    from rowferry.operators.row_index import order_columns

    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` int, `c``d` string")
    assert df.where(compile_filter(Filter("a.b", "gt", 1))).count() == 1
    assert map_columns(df, [ColumnMapping("c`d", "e.f")]).columns == ["e.f"]
    assert df.orderBy(*order_columns([Sort("a.b", "desc")])).first()[0] == 2


def test_document_fields_with_odd_names(spark):
    from rowferry.sources.documents import document_fields

    rows = spark.createDataFrame([(1, """{"it's": 1, "a.b": "x", "c d": [1], "n": null}""")], "id int, doc string")
    found = {r.field: r.data_type for r in document_fields(rows, "doc", ["id"]).collect()}
    assert found == {"it's": "number", "a.b": "string", "c d": "array", "n": "null"}
