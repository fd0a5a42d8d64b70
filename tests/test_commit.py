"""Published versions, streams and bridge runs."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import Bridge, ColumnMapping, Delivery, Filter, Payload, Target, WatchStrategy
from rowferry.operators import runs
from rowferry.operators.commit import SnapshotTable, Version
from rowferry.operators.merge import insert_rows, upsert_rows
from rowferry.session import freeze, scratch_path, shared_root
from rowferry.streaming.bridge import apply_batch, change_log_stream, start_bridge, start_fan_out

SCHEMA = T.StructType().add("id", T.LongType()).add("v", T.StringType())
FEED = "op string, pos bigint, id bigint, v string"


def new_table(spark, buckets=4):
    return SnapshotTable(spark, scratch_path(spark, "t"), SCHEMA, ["id"], buckets)


def put(current, delta):
    return upsert_rows(current, delta, ["id"])


def values(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def test_versions_and_repeats(spark, rows):
    table = new_table(spark)
    assert rows(table.read()) == []
    assert table.apply(values(spark, (1, "a"), (2, "b")), put, "one")
    assert not table.apply(values(spark, (1, "zzz")), put, "one")
    assert table.apply(values(spark, (2, "B"), (3, "c")), put, "two")
    assert rows(table.read()) == [(1, "a"), (2, "B"), (3, "c")]
    assert table.version().number == 2


def test_untouched_buckets_keep_their_files(spark):
    table = new_table(spark, buckets=8)
    table.apply(freeze(spark.range(200).select("id", F.lit("x").alias("v")), "f"), put, "one")
    before, layout = files(table.path), table.version().layout
    table.apply(values(spark, (5, "new")), put, "two")
    after = table.version().layout
    moved = [b for b in layout if layout[b] != after[b]]
    assert len(moved) == 1
    assert before.items() <= files(table.path).items()
    assert table.read().count() == 200 and table.read().where("v = 'new'").count() == 1


def test_failed_merge_publishes_nothing(spark, rows):
    table = new_table(spark)
    table.apply(values(spark, (1, "a")), put, "one")

    def broken(current, delta):
        return put(current, delta).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        table.apply(values(spark, (1, "b")), broken, "two")
    assert rows(table.read()) == [(1, "a")]
    assert table.apply(values(spark, (1, "b")), put, "two") and rows(table.read()) == [(1, "b")]


def test_one_of_two_writers_publishes(spark, rows):
    table = new_table(spark)
    table.apply(values(spark, (1, "a")), put, "one")

    def overtaken(current, delta):
        new = SnapshotTable(spark, table.path, SCHEMA, ["id"], 4)
        new.apply(values(spark, (9, "first")), put, "rival")
        return put(current, delta)

    with pytest.raises(RuntimeError, match="another writer"):
        table.apply(values(spark, (1, "b")), overtaken, "two")
    assert rows(table.read()) == [(1, "a"), (9, "first")]
    assert table.apply(values(spark, (1, "b")), put, "two")
    assert rows(table.read()) == [(1, "b"), (9, "first")]


def test_readers_keep_their_version_until_vacuum(spark, rows):
    table = new_table(spark, buckets=1)
    table.apply(values(spark, (1, "a")), put, "one")
    old = table.version()
    table.apply(values(spark, (1, "b")), put, "two")
    table.apply(values(spark, (1, "c")), put, "three")
    assert rows(table.read(old)) == [(1, "a")]
    assert len(table.vacuum(keep=2)) == 1
    assert rows(table.read()) == [(1, "c")] and table.version().number == 3


def test_deleting_every_row_of_a_bucket(spark, rows):
    table = new_table(spark, buckets=1)
    table.apply(values(spark, (1, "a")), put, "one")
    gone = spark.createDataFrame([("delete", 1, 1, None)], FEED)
    apply_batch(gone, table, ["pos"], "two")
    assert rows(table.read()) == [] and table.version().position == [1]


def test_late_repeats_are_dropped(spark, rows):
    table = new_table(spark)
    feed = [("insert", 5, 1, "new"), ("insert", 6, None, "no key")]
    apply_batch(spark.createDataFrame(feed, FEED), table, ["pos"], "one")
    late = spark.createDataFrame([("update", 4, 1, "old"), ("update", 5, 1, "same")], FEED)
    apply_batch(late, table, ["pos"], "two")
    assert rows(table.read()) == [(1, "new")] and table.version().position == [5]


def test_changes_with_a_null_key_are_kept_as_rejects(spark, rows):
    table = new_table(spark)
    assert table.rejects() is None
    feed = spark.createDataFrame([("insert", 1, 1, "a"), ("insert", 2, None, "b"), ("insert", 3, 2, "c")], FEED)
    assert apply_batch(feed, table, ["pos"], "b:1")
    assert not apply_batch(feed, table, ["pos"], "b:1")
    assert apply_batch(spark.createDataFrame([("delete", 4, None, None)], FEED), table, ["pos"], "b:2")
    assert rows(table.read()) == [(1, "a"), (2, "c")]
    assert sorted((r["op"], r["pos"], r["v"]) for r in table.rejects().collect()) == [("delete", 4, None), ("insert", 2, "b")]


def test_markers_are_complete_before_they_show(spark):
    table = new_table(spark)
    table.apply(values(spark, (1, "a")), put, "one")
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(Version(1))
    assert table._names("_versions") == ["v000000000001.json"] and table.version().batches == ["one"]


def test_fan_out_stream_heals_a_failed_target(spark, rows):
    """The journal appends every change once; the late target catches up."""
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "checkpoint")
    feed = [("insert", 1, 1, "a"), ("update", 2, 1, "b"), ("update", 2, 1, "b"), ("insert", 3, 2, "c"), ("delete", 4, 2, None), ("insert", 5, 9, "no")]
    spark.createDataFrame(feed, FEED).coalesce(1).write.parquet(log)
    bridge = Bridge(
        "b", "s", filters=(Filter("v", "neq", "no"),), trigger="cdc",
        targets=(Target("journal", key_columns=("id",), write_mode="insert"), Target("late", key_columns=("id",))),
    )
    tables = {"journal": new_table(spark)}

    def run():
        stream = change_log_stream(spark, log, spark.createDataFrame([], FEED).schema)
        start_fan_out(stream, bridge, tables, ["pos"], checkpoint).awaitTermination()

    with pytest.raises(Exception, match="targets failed"):
        run()
    assert rows(tables["journal"].read()) == [(1, "a"), (1, "b")]
    tables["late"] = new_table(spark)
    run()
    assert rows(tables["journal"].read()) == [(1, "a"), (1, "b")]
    assert rows(tables["late"].read()) == [(1, "b")]


def test_only_enabled_operations_apply(spark, rows):
    table = new_table(spark)
    table.apply(values(spark, (1, "a")), put, "base")
    feed = spark.createDataFrame([("delete", 1, 1, None), ("insert", 2, 2, "b")], FEED)
    apply_batch(feed, table, ["pos"], "one", operations=["insert", "update"])
    assert rows(table.read()) == [(1, "a"), (2, "b")]


def test_stream_resumes_and_survives_a_lost_checkpoint(spark, rows):
    table, log = new_table(spark), scratch_path(spark, "log")
    schema = spark.createDataFrame([], FEED).schema

    def run(checkpoint):
        stream = change_log_stream(spark, log, schema, files_per_trigger=1)
        start_bridge(stream, table, ["pos"], checkpoint, "bridge").awaitTermination()

    first = scratch_path(spark, "checkpoint")
    spark.createDataFrame([("insert", 1, 1, "a"), ("insert", 2, 2, "b")], FEED).coalesce(1).write.parquet(log)
    run(first)
    spark.createDataFrame([("delete", 3, 1, None), ("update", 4, 2, "B")], FEED).coalesce(1).write.mode("append").parquet(log)
    run(first)
    assert rows(table.read()) == [(2, "B")]
    number = table.version().number
    run(first)
    assert table.version().number == number
    # a new checkpoint reads the whole log again: batch ids and position stop it
    run(scratch_path(spark, "checkpoint"))
    assert rows(table.read()) == [(2, "B")]


def test_scratch_needs_a_shared_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


COPY = Bridge(
    "b",
    "source",
    primary_key=("id",),
    filters=(Filter("id", "lt", 90),),
    targets=(
        Target("one", key_columns=("id",)),
        Target("two", key_columns=("id",), mapping=(ColumnMapping("v", "id"), ColumnMapping("v", "v"))),
    ),
    delivery=Delivery(batch_size=20),
)


def test_replay_records_and_repeats_safely(spark, rows):
    source = spark.range(100).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    bridge = Bridge("b", "s", ("id",), COPY.filters, targets=COPY.targets[:1], delivery=COPY.delivery)
    table = new_table(spark)
    first = runs.run_replay(bridge, source, {"one": table}, "run")
    assert first.status == "completed" and table.read().count() == 90
    assert rows(first.deliveries, "sequence", "row_count") == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 10)]
    again = runs.run_replay(bridge, source, {"one": table}, "run", first.deliveries, attempt=2)
    assert rows(again.deliveries) == rows(first.deliveries) and table.read().count() == 90


def test_failed_target_fails_the_deliveries_and_a_retry_heals(spark, rows):
    source = spark.range(5).select("id", F.lit("v").alias("v"))
    bridge = Bridge("b", "s", ("id",), targets=COPY.targets[:1] + (Target("late", key_columns=("id",)),), delivery=COPY.delivery)
    one, late = new_table(spark), new_table(spark)
    failed = runs.run_replay(bridge, source, {"one": one}, "run")
    assert failed.status == "failed" and rows(failed.deliveries, "status") == [("failed",)]
    assert one.read().count() == 5
    healed = runs.run_replay(bridge, source, {"one": one, "late": late}, "run", failed.deliveries, attempt=2)
    assert rows(healed.deliveries, "status", "row_count") == [("success", 5)]
    assert late.read().count() == one.read().count() == 5


def test_replay_rejects_null_keys_and_keeps_the_last_of_a_key(spark, rows):
    source = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, None, "c")], "n int, id bigint, v string")
    mapping = (ColumnMapping("id", "id"), ColumnMapping("v", "v"))
    bridge = Bridge("b", "s", ("n",), targets=(Target("one", key_columns=("id",), mapping=mapping),))
    table = new_table(spark)
    result = runs.run_replay(bridge, source, {"one": table}, "run")
    assert rows(table.read()) == [(7, "b")] and rows(result.rejects, "v") == [("c",)]


def test_http_bridge_yields_an_outbox(spark):
    bridge = Bridge("b", "s", ("id",), payload=Payload(), delivery=Delivery(batch_size=4))
    result = runs.run_replay(bridge, spark.range(10), {}, "run")
    assert sorted(r["row_count"] for r in result.outbox.collect()) == [2, 4, 4]


def test_polls_write_and_number_their_rows(spark, rows):
    bridge = Bridge(
        "b", "s", ("id",), targets=COPY.targets[:1], trigger="watch",
        strategy=WatchStrategy("increment", "id"), per_poll=4,
    )
    source = spark.range(6).select("id", F.lit("v").alias("v"))
    table = new_table(spark)
    first = runs.run_poll(bridge, source, {"one": table}, "run", None)
    second = runs.run_poll(bridge, source, {"one": table}, "run", first.state, first.deliveries)
    assert table.read().count() == 6
    assert rows(second.deliveries, "sequence", "row_count") == [(i, 1) for i in range(6)]


def test_bridge_needs_one_kind_of_destination():
    with pytest.raises(ValueError):
        Bridge("b", "s")
    with pytest.raises(ValueError):
        Bridge("b", "s", targets=COPY.targets, trigger="watch")
    assert Version().layout == {}


def test_a_batch_that_does_not_fit_leaves_the_old_version(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "typed"), spark.createDataFrame([], "id int, n int").schema, ["id"], 2)
    table.apply(spark.createDataFrame([(1, 1)], "id int, n int"), insert_rows, "a")
    with pytest.raises(Exception, match="CAST"):
        table.apply(spark.createDataFrame([(2, "x")], "id int, n string"), lambda current, delta: delta, "b")
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]


def test_a_run_resumed_from_the_start_delivers_the_rest(spark, tmp_path):
    source = spark.createDataFrame([(k, k) for k in range(10)], "id int, n int")
    bridge = Bridge("copy", "orders", ("id",), targets=(Target("one", write_mode="insert"),), delivery=Delivery(batch_size=1))
    table = SnapshotTable(spark, str(tmp_path / "one"), source.schema, ["id"], 2)
    late = runs.run_replay(bridge, source, {"one": table}, "run", cursor_offset=5)
    rest = runs.run_replay(bridge, source, {"one": table}, "run", late.deliveries)
    assert table.read().count() == 10 and rest.deliveries.where("status = 'success'").count() == 10
