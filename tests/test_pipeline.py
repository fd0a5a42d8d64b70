"""Change streams with a ledger and a position for each log partition."""

import pytest
from pyspark.sql import types as T

from rowferry.config import Bridge, Delivery, Payload, Target
from rowferry.operators.changes import after_vector, element_wise_max, vector_ends
from rowferry.operators.commit import SnapshotTable
from rowferry.session import scratch_path
from rowferry.streaming.bridge import change_log_stream
from rowferry.streaming.pipeline import Entry, StreamLedger, deliver_changes, prepare_start, start_pipeline

SCHEMA = T.StructType().add("id", T.LongType()).add("v", T.StringType())
FEED = "op string, part string, pos bigint, id bigint, v string"


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), FEED)


def table(spark):
    return SnapshotTable(spark, scratch_path(spark, "t"), SCHEMA, ["id"], 2)


def ledger(spark):
    return StreamLedger(spark, scratch_path(spark, "ledger"), "run")


def bridge(**settings):
    return Bridge("b", "s", ("id",), **{"targets": (Target("one", key_columns=("id",)),), "trigger": "cdc", **settings})


def test_positions_by_partition(spark, rows):
    changes = feed(spark, ("insert", "a", 5, 1, "x"), ("insert", "a", 6, 2, "x"), ("insert", "b", 1, 3, "x"), ("insert", None, 2, 4, "x"))
    assert vector_ends(changes, ["pos"], "part") == {"a": [6], "b": [1], "": [2]}
    assert vector_ends(changes, ["pos"], "part", lowest=True) == {"a": [5], "b": [1], "": [2]}
    assert rows(after_vector(changes, ["pos"], "part", {"a": [5], "": [2]}), "id") == [(2,), (3,)]
    assert after_vector(changes, ["pos"], None, {"": [2]}).count() == 2
    assert element_wise_max({"a": [5], "b": [9]}, {"a": [6], "c": [1]}) == {"a": [6], "b": [9], "c": [1]}


def test_lower_positions_of_another_partition_are_not_late(spark, rows):
    one, book = table(spark), ledger(spark)
    deliver_changes(feed(spark, ("insert", "a", 5, 1, "x"), ("insert", "a", 6, 2, "x")), bridge(), {"one": one}, ["pos"], book, "0", "part")
    again = feed(spark, ("insert", "a", 5, 1, "old"), ("insert", "b", 1, 3, "y"), ("insert", "b", 1, 3, "y"))
    deliver_changes(again, bridge(), {"one": one}, ["pos"], book, "1", "part")
    assert rows(one.read()) == [(1, "x"), (2, "x"), (3, "y")] and one.version().vector == {"a": [6], "b": [1]}
    assert rows(book.read(), "sequence", "status") == [(0, "success"), (1, "success"), (2, "success")]


def test_a_repeated_batch_gets_the_same_sequences(spark, rows):
    one, book = table(spark), ledger(spark)
    batches = [feed(spark, *[("insert", "a", 10 * b + k, 10 * b + k, "x") for k in range(3)]) for b in range(4)]
    for name in (0, 1, 1, 2, 2, 3):
        deliver_changes(batches[name], bridge(delivery=Delivery(batch_size=2)), {"one": one}, ["pos"], book, str(name), "part")
    assert sorted(r[0] for r in book.read().select("sequence").collect()) == list(range(8))
    assert book.read().groupBy().sum("row_count").first()[0] == 12 and one.read().count() == 12
    assert [e.name for e in book.entries()] == ["2", "3"]


def test_a_failed_target_is_recorded_with_its_changes(spark, rows):
    two, book = table(spark), ledger(spark)
    both = bridge(targets=(Target("one", key_columns=("id",)), Target("two", key_columns=("id",))))
    errors = deliver_changes(feed(spark, ("insert", "a", 1, 1, "x"), ("delete", "a", 2, 1, None)), both, {"two": two}, ["pos"], book, "0", "part")
    assert errors["one"] and errors["two"] is None
    assert rows(book.read(), "sequence", "status") == [(0, "failed"), (1, "failed")]
    assert rows(book.read("captured"), "sequence", "op", "id") == [(0, "insert", 1), (1, "delete", 1)]
    deliver_changes(feed(spark, ("insert", "a", 3, 7, "y")), both, {"one": table(spark), "two": two}, ["pos"], book, "1", "part")
    assert rows(book.read(), "sequence", "status") == [(0, "failed"), (1, "failed"), (2, "success")]


def test_abort_stops_the_stream_and_a_restart_heals_it(spark, rows):
    log, checkpoint, one, book = scratch_path(spark, "log"), scratch_path(spark, "c"), table(spark), ledger(spark)
    feed(spark, ("insert", "a", 1, 1, "x"), ("insert", "b", 1, 2, "y")).coalesce(1).write.parquet(log)
    both = bridge(targets=(Target("one", key_columns=("id",)), Target("late", key_columns=("id",))), delivery=Delivery(on_error="abort"))
    tables = {"one": one}

    def run():
        stream = change_log_stream(spark, log, feed(spark).schema)
        start_pipeline(stream, both, tables, ["pos"], checkpoint, book, "part").awaitTermination()

    with pytest.raises(Exception, match="targets failed"):
        run()
    tables["late"] = table(spark)
    run()
    assert rows(one.read()) == rows(tables["late"].read()) == [(1, "x"), (2, "y")]
    assert rows(book.read(), "sequence", "status") == [(0, "success"), (1, "success")]


def test_sources_without_positions(spark, rows):
    one, book = table(spark), ledger(spark)
    for name in ("0", "0", "1"):
        deliver_changes(feed(spark, ("update", "a", 1, int(name), "x")), bridge(), {"one": one}, ["pos"], book, name, "part", always_new=True)
    assert rows(one.read(), "id") == [(0,), (1,)] and rows(book.read(), "sequence") == [(0,), (1,)]


def test_a_payload_bridge_fills_an_outbox(spark, rows):
    book = ledger(spark)
    deliver_changes(feed(spark, ("insert", "a", 1, 1, "x")), bridge(targets=(), payload=Payload()), {}, ["pos"], book, "0", "part", now="n")
    assert rows(book.read(), "sequence", "status") == [(0, "queued")] and book.read("outbox").count() == 1


def test_start_and_lost_history(spark):
    log = feed(spark, ("insert", "a", 5, 1, "x"), ("insert", "b", 9, 1, "x"))
    assert prepare_start(ledger(spark), log, ["pos"], "part").vector == {}
    book = ledger(spark)
    assert prepare_start(book, log, ["pos"], "part", "now").vector == {"a": [5], "b": [9]}
    assert prepare_start(book, log, ["pos"], "part", "now").note is None
    book.commit(Entry("later", 0, 4, {"a": [2], "b": [9]}))
    found = prepare_start(book, log, ["pos"], "part")
    assert found.note == "history lost: a" and found.vector == {"a": [5], "b": [9]} and found.end == 4


def test_no_changes(spark):
    one, book = table(spark), ledger(spark)
    deliver_changes(feed(spark), bridge(), {"one": one}, ["pos"], book, "0", "part")
    assert book.read().count() == 0 and one.read().count() == 0
