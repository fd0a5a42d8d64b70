"""Previews of bridges: rows, bodies, warnings and targets."""

import json

import pytest

from rowferry.config import Bridge, ColumnMapping, Filter, Payload, Target
from rowferry.operators.preview import preview_bridge, preview_payload

NOW = "2024-05-06T07:08:09.000Z"


def people(spark, count=30):
    return spark.createDataFrame([(k, f"n{k}") for k in reversed(range(count))], "id int, name string")


def test_bodies_are_numbered_in_key_order(spark):
    template = Payload('{"at": "{{$index}}", "id": "{{id}}", "from": "{{$table}}", "x": "{{gone}}"}')
    found = preview_payload(people(spark), template, "people", NOW, 4, ("id",)).collect()
    assert [r.row_index for r in found] == [0, 1, 2, 3] and all(r.warnings == ["gone"] for r in found)
    assert [json.loads(r.body) for r in found] == [{"at": k, "id": k, "from": "people", "x": None} for k in range(4)]


def test_rows_without_a_key_are_numbered_too(spark):
    found = preview_payload(people(spark), Payload(), "people", NOW, 5).collect()
    assert sorted(r.row_index for r in found) == list(range(5)) and all(r.warnings == [] for r in found)
    assert set(json.loads(found[0].body)) == {"id", "name"}


def test_no_rows_and_bounds(spark):
    empty = people(spark).where("id < 0")
    assert preview_payload(empty, Payload(), "people", NOW, 3, ("id",)).count() == 0
    for limit in (0, 11):
        with pytest.raises(ValueError, match="preview"):
            preview_payload(empty, Payload(), "people", NOW, limit)


def test_payload_bridge(spark):
    bridge = Bridge("b", "people", ("id",), (Filter("id", "gte", 7),), payload=Payload('{"id": "{{id}}", "y": "{{lost}}"}', wrap_key="data"))
    shown = preview_bridge(bridge, people(spark), NOW, 2)
    assert [json.loads(r.body) for r in shown.bodies.orderBy("row_index").collect()] == [{"data": {"id": k, "y": None}} for k in (7, 8)]
    assert shown.warnings == ["lost"] and shown.from_source and not shown.targets


def test_a_sample_row_stands_for_the_source(spark):
    bridge = Bridge("b", "people", ("id",), (Filter("id", "gte", 7),), payload=Payload())
    sample = spark.createDataFrame([(1, "given")], "id int, name string")
    shown = preview_bridge(bridge, people(spark), NOW, 3, sample)
    assert [json.loads(r.body) for r in shown.bodies.collect()] == [{"id": 1, "name": "given"}] and not shown.from_source


def test_table_bridge_names_targets_and_missing_keys(spark):
    targets = (Target("a", key_columns=("n",), mapping=(ColumnMapping("id", "n"),)), Target("b", schema="s"), Target("c", write_mode="insert"))
    shown = preview_bridge(Bridge("b", "people", ("id",), targets=targets), people(spark), NOW, 2)
    assert [tuple(r) for r in shown.bodies.collect()] == [(0,), (1,)] and shown.bodies.columns == ["n"]
    assert shown.targets == list(targets)
    assert len(shown.warnings) == 1 and shown.warnings[0].startswith("s.b:")
