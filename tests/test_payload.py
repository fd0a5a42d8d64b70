"""Templates, batches and retries."""

import json

import pytest
from pyspark.sql import functions as F

from rowferry.config import Delivery, Payload
from rowferry.operators.payload import (
    change_outbox,
    payload_outbox,
    read_template,
    render_batch,
    render_row,
    render_warnings,
    retry_due,
)

NOW = "2024-05-06T07:08:09.000Z"
SHAPE = "id int, email string, active boolean, meta struct<a:int>, nada string"


def frame(spark):
    return spark.createDataFrame([(7, "ada@x.io", True, (1,), None)], SHAPE)


def body(df, payload, **more):
    return json.loads(render_row(df, payload, "users", NOW, **more).first()["body"])


def test_whole_tokens_keep_their_type(spark):
    template = '{"i": "{{id}}", "b": "{{ active }}", "m": "{{meta}}", "n": "{{nada}}", "k": 1.5, "l": [true, "{{id}}"]}'
    assert body(frame(spark), Payload(template)) == {
        "i": 7, "b": True, "m": {"a": 1}, "n": None, "k": 1.5, "l": [True, 7],
    }


def test_mixed_tokens_are_text(spark):
    template = '{"s": "u-{{id}}/{{nada}}/{{meta}}", "key-{{id}}": "{{email}}!"}'
    assert body(frame(spark), Payload(template)) == {"s": 'u-7//{"a":1}', "key-7": "ada@x.io!"}


def test_helpers(spark):
    template = '{"t": "{{$table}}", "w": "{{$now}}", "at": "{{$index}}", "r": "{{$row}}"}'
    df = frame(spark).select("id", "email").withColumn("at", F.lit(4).cast("bigint"))
    assert body(df, Payload(template), index="at") == {
        "t": "users", "w": NOW, "at": 4, "r": {"id": 7, "email": "ada@x.io"},
    }


def test_values_cannot_break_the_document(spark):
    evil = 'x", "admin": true, "y": "\\ \n\t  {{id}}'
    df = spark.createDataFrame([(1, evil)], "id int, v string")
    assert body(df, Payload('{"a": "{{v}}", "b": "<{{v}}>", "{{v}}": 1}')) == {
        "a": evil, "b": f"<{evil}>", evil: 1,
    }


def test_fields_rename_and_wrap(spark):
    payload = Payload(fields=("email", "id"), rename={"id": "key"}, wrap_key="data")
    assert body(frame(spark), payload) == {"data": {"key": 7, "email": "ada@x.io"}}
    # a token reads the column under its source name
    assert body(frame(spark), Payload('{"x": "{{id}}"}', rename={"id": "key"})) == {"x": 7}


def test_unresolved_tokens_are_reported(spark):
    payload = Payload('{"a": "{{gone}}", "b": "x{{lost}}y", "c{{gone}}": 1}')
    assert render_warnings(frame(spark), payload) == ["gone", "lost"]
    assert body(frame(spark), payload) == {"a": None, "b": "xy", "c": 1}
    assert render_warnings(frame(spark), Payload('{"a": "{{constructor}}"}')) == ["constructor"]


def test_forbidden_and_repeated_keys(spark):
    df = spark.createDataFrame([("__proto__", "b"), ("a", "a")], "k string, v string")
    payload = Payload('{"prototype": 1, "{{k}}": "{{v}}", "{{v}}": 2, "z": 3}')
    got = [json.loads(r["body"]) for r in render_row(df, payload, "t", NOW).collect()]
    assert got == [{"b": 2, "z": 3}, {"a": 2, "z": 3}]


def test_template_must_be_json():
    assert read_template(" {{ $row }} ") == "{{ $row }}"
    with pytest.raises(ValueError, match="not valid JSON"):
        read_template("{oops")


def test_operation_shows_in_the_row_unless_fields_are_listed(spark):
    df = frame(spark).select("id").withColumn("op", F.lit("delete"))
    assert body(df, Payload(), op="op") == {"id": 7, "$op": "delete"}
    assert body(df, Payload('{"o": "{{$op}}", "r": "{{$row}}"}', fields=("id",)), op="op") == {
        "o": "delete", "r": {"id": 7},
    }


def indexed(spark, count, batch):
    return spark.range(count).select(
        "id", F.col("id").alias("row_index"), F.expr(f"id div {batch}").alias("sequence")
    )


def test_batches_are_arrays_in_index_order(spark):
    payload = Payload('{"at": "{{$index}}", "id": "{{id}}"}', wrap_key="rows")
    got = {r["sequence"]: r for r in render_batch(indexed(spark, 25, 10), payload, "t", NOW).collect()}
    assert json.loads(got[1]["body"])["rows"] == [{"at": i, "id": i} for i in range(10, 20)]
    assert (got[2]["row_index"], got[2]["row_count"]) == (20, 5)


def test_a_single_row_is_an_object(spark):
    got = {r["sequence"]: json.loads(r["body"]) for r in render_batch(indexed(spark, 11, 10), Payload(), "t", NOW).collect()}
    assert isinstance(got[0], list) and got[1] == {"id": 10}
    forced = render_batch(indexed(spark, 1, 10), Payload(), "t", NOW, as_array=True).first()
    assert json.loads(forced["body"]) == [{"id": 0}]


def test_outbox_keys_and_log_cap(spark):
    big = indexed(spark, 4, 2).withColumn("text", F.repeat(F.lit("x"), 20_000))
    sent = payload_outbox(big, Payload(), "t", NOW, "run-9", ["id"]).orderBy("sequence").collect()
    assert [r["idempotency_key"] for r in sent] == ["run-9:0", "run-9:1"]
    assert [json.loads(r["row_keys"]) for r in sent] == [[0, 1], [2, 3]]
    assert all(len(r["logged_body"]) == 16384 and len(r["body"]) > 40_000 for r in sent)
    composite = payload_outbox(indexed(spark, 2, 1), Payload(), "t", NOW, "r", ["id", "row_index"])
    assert composite.first()["row_keys"] is None


def test_change_outbox(spark):
    df = spark.createDataFrame([("1/A", "update", 3, "x")], "position string, op string, id int, v string")
    sent = change_outbox(df, Payload(), "t", NOW, "run", ["id", "v"]).first()
    assert sent["idempotency_key"] == "run:1/A" and json.loads(sent["row_keys"]) == [3, "x"]
    assert json.loads(sent["body"]) == {"id": 3, "v": "x", "$op": "update"}


def test_retry_delays(spark):
    shape = "sequence int, status string, http_status int, attempts int, retry_after string"
    df = spark.createDataFrame(
        [
            (0, "failed", 503, 1, None),
            (1, "failed", None, 2, None),
            (2, "failed", 429, 1, "4"),
            (3, "failed", 429, 1, "600"),
            (4, "failed", 400, 1, None),
            (5, "failed", 500, 3, None),
            (6, "success", 200, 1, None),
            (7, "failed", 503, 1, "soon"),
        ],
        shape,
    )
    due = retry_due(df, Delivery(), "retry_after")
    assert {r["sequence"]: r["delay_ms"] for r in due.collect()} == {0: 500, 1: 1000, 2: 4000, 3: 30000, 7: 500}
