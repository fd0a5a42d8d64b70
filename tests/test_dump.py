"""Dumps, restores, exports and change normalization."""

import csv
import datetime as dt
import json

import pytest

from rowferry.config import Filter
from rowferry.functions.positions import WITHOUT_WATERMARK
from rowferry.operators import changes, dump
from rowferry.operators.commit import SnapshotTable
from rowferry.session import scratch_path
from rowferry.streaming.bridge import apply_batch

STORE = "key string, type string, ttl bigint, value string"


def test_json_round_trip_keeps_every_type(spark, rows):
    df = spark.createDataFrame(
        [
            (1, bytearray([0, 1, 2, 250, 255]), 0.1, dt.datetime(2024, 3, 10, 2, 30, 5, 123456), True, [1, 2], None),
            (2, None, 1e300, None, None, None, 'q"\n'),
        ],
        "id int, data binary, x double, at timestamp_ntz, ok boolean, list array<int>, s string",
    )
    path = scratch_path(spark, "dump")
    dump.backup_json({"t": df, "n": spark.range(2050)}, path, {"t": ["id"]})
    entries = {e["name"]: e for e in dump.read_manifest(spark, path)}
    assert entries["t"]["primary_key"] == ["id"] and entries["t"]["columns"] == df.columns
    back = dump.restore_json(spark, path, {"n": spark.range(5)})
    assert back["t"].schema.simpleString() == df.schema.simpleString()
    assert rows(back["t"]) == rows(df)
    assert back["n"].count() == 2055
    with pytest.raises(Exception, match="not a dump|exist"):
        dump.read_manifest(spark, scratch_path(spark, "nothing"))


def test_documents_skip_known_ids(spark, rows):
    have = spark.createDataFrame([("a", 1)], "_id string, n int")
    more = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "_id string, n int")
    assert rows(dump.restore_documents(have, more)) == [("a", 1), ("b", 2)]


def test_keyspace_restore(spark, rows):
    store = spark.createDataFrame([("keep", "string", 5, "x"), ("l", "string", 5, "old"), ("e", "string", 1, "old")], STORE)
    given = spark.createDataFrame(
        [
            ("l", "list", 0, "[1,2]"),
            ("e", "list", 9, "[]"),
            ("z", "zset", 7, '["a","1","b","2","tail"]'),
            ("h", "hash", -1, '{"f":"v"}'),
            ("h2", "hash", -1, "{}"),
            ("s", "string", None, "text"),
            ("", "string", 1, "nameless"),
        ],
        STORE,
    )
    assert rows(dump.restore_keyspace(store, given)) == [
        ("h", "hash", -1, '{"f":"v"}'),
        ("keep", "string", 5, "x"),
        ("l", "list", -1, "[1,2]"),
        ("s", "string", -1, "text"),
        ("z", "zset", 7, '["a","1","b","2"]'),
    ]


def test_keyspace_dump_is_json(spark):
    store = spark.createDataFrame([("a", "string", -1, 'q"'), ("b", "list", 5, "[1,2]")], STORE)
    got = sorted((json.loads(r["line"]) for r in dump.backup_keyspace(store).collect()), key=lambda d: d["key"])
    assert got == [
        {"key": "a", "type": "string", "ttl": -1, "value": 'q"'},
        {"key": "b", "type": "list", "ttl": 5, "value": [1, 2]},
    ]


def test_sql_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", bytearray(b"hi"), None)], 'id int, `na"me` string, data binary, x double')
    line = dump.backup_sql(df, "t", "sqlite").first()["line"]
    assert line == """INSERT INTO "t" ("id", "na""me", "data", "x") VALUES (1, 'it''s', X'6869', NULL);"""
    types = {"id": "INTEGER", 'na"me': "TEXT", "data": "BLOB", "x": "REAL"}
    dump.write_sql_dump(df, "t", "postgres", str(tmp_path / "d"), types, ["id"])
    ddl = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "d" / "ddl"), wholetext=True).collect())
    assert ddl.startswith('CREATE TABLE IF NOT EXISTS "t" (\n  "id" INTEGER NOT NULL,') and 'PRIMARY KEY ("id")' in ddl


def test_csv_is_read_back_by_a_csv_reader(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", ok\nnext', None, (1, None)), (2, " plain ", 2.0, None)],
        "id int, text string, x double, nested struct<a:int,b:string>",
    )
    header = dump.csv_header(df).first()["line"]
    lines = [r["line"] for r in dump.export_csv(df.orderBy("id")).collect()]
    parsed = list(csv.DictReader("\n".join([header, *lines]).splitlines(keepends=True)))
    assert parsed[0] == {"id": "1", "text": 'say "hi", ok\nnext', "x": "", "nested": '{"a":1,"b":null}'}
    assert parsed[1] == {"id": "2", "text": " plain ", "x": "2", "nested": ""}
    dump.write_csv(df.coalesce(1), str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("*.csv")).read_text()
    assert list(csv.DictReader(part.splitlines(keepends=True))) == parsed


def test_export_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    assert dump.export_json(df).first()["line"] == '{"id":1,"v":null}'


def test_postgres_messages(spark, rows):
    image, shape = "struct<id:int,v:string>", "schema:string,name:string"
    feed = spark.createDataFrame(
        [
            ("0/1", "insert", ("s", "t"), (1, "a"), None, None),
            ("0/2", "delete", ("s", "t"), None, (1, "a"), (1, None)),
            ("0/3", "delete", ("s", "t"), None, None, (2, None)),
            ("0/4", "update", ("s", "other"), (3, "c"), None, None),
            ("0/5", "begin", None, None, None, None),
        ],
        f"lsn string, tag string, relation struct<{shape}>, new {image}, old {image}, key {image}",
    )
    got = changes.normalize_changes_pg(feed, "s", "t")
    assert rows(got, "op", "position", "row.id", "row.v") == [
        ("delete", "0/2", 1, "a"), ("delete", "0/3", 2, None), ("insert", "0/1", 1, "a"),
    ]


def test_mysql_rows_have_their_own_positions(spark, rows):
    image = "struct<id:int>"
    feed = spark.createDataFrame(
        [
            ("updaterows", "f.1", 40, [((1,), (2,)), ((3,), (4,))]),
            ("deleterows", "f.1", 50, [((5,), None)]),
            ("rotate", "f.2", 4, []),
        ],
        f"event string, file string, next_position bigint, rows array<struct<before:{image},after:{image}>>",
    )
    assert rows(changes.normalize_changes_mysql(feed), "op", "position", "row.id") == [
        ("delete", "f.1:50:0", 5), ("update", "f.1:40:0", 2), ("update", "f.1:40:1", 4),
    ]


def test_mongo_and_redis_events(spark, rows):
    doc = "struct<_id:string,v:int>"
    feed = spark.createDataFrame(
        [
            ("p1", "replace", ("a", 1), None, ("a", None)),
            ("p2", "update", None, None, ("b", None)),
            ("p3", "delete", None, None, ("c", None)),
            ("p4", "drop", None, None, None),
        ],
        f"_id string, operationType string, fullDocument {doc}, fullDocumentBeforeChange {doc}, documentKey {doc}",
    )
    assert rows(changes.normalize_changes_mongo(feed), "op", "row._id", "row.v") == [
        ("delete", "c", None), ("update", "a", 1), ("update", "b", None),
    ]
    events = spark.createDataFrame([("1", "set", "k1"), ("2", "expired", "k1"), ("3", "expire", "gone"), ("4", "set", "x")], "position string, event string, key string")
    store = spark.createDataFrame([("k1", "string", -1, "v")], STORE)
    assert rows(changes.normalize_changes_redis(events, store, "[kg]*"), "op") == []
    assert rows(changes.normalize_changes_redis(events, store, "?*"), "op", "row.key", "row.type", "row.value") == [
        ("delete", "k1", None, None), ("update", "gone", "none", None),
        ("update", "k1", "string", "v"), ("update", "x", "none", None),
    ]


def test_operations_and_filters(spark, rows):
    feed = spark.createDataFrame([("insert", 1), ("replace", 2), ("delete", 3)], "op string, n int")
    assert rows(changes.filter_change_ops(feed, ["update"]), "n") == [(2,)]
    assert rows(changes.filter_change_ops(feed, ["insert"], "redis"), "n") == [(1,), (2,)]
    assert rows(changes.filter_changes(feed, [Filter("n", "eq", 1)]), "n") == [(1,), (3,)]
    for wrong in ([], ["truncate"]):
        with pytest.raises(ValueError):
            changes.filter_change_ops(feed, wrong)


def test_log_positions(spark, rows):
    feed = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "f int, n int")
    order = ["f", "n"]
    assert rows(changes.dedupe_positions(feed, order, (1, 0))) == [(1, 1), (2, 0)]
    assert changes.log_end(feed, order) == (2, 0) and changes.log_end(feed.limit(0), order) is None
    assert changes.change_feed_read(feed, order, "now").count() == 0
    assert changes.change_feed_read(feed, order).count() == 4
    lost = changes.gap_detect(feed, order, (0, 9)).first()
    assert lost["history_lost"] and (lost["restart_f"], lost["restart_n"]) == (2, 0)
    kept = changes.gap_detect(feed, order, (1, 0)).first()
    assert not kept["history_lost"] and kept["restart_f"] == 1

@pytest.mark.parametrize(
    ("engine", "positions", "columns"),
    [
        ("postgres", ["0/A", "0/FF", "1/0"], ["order_lsn"]),
        ("mysql", ["f.1:4:9", "f.1:4:10", "f.1:12:0", "f.2:4:0"], ["order_file", "order_pos", "order_row"]),
        ("mongodb", ["82A", "82B"], ["order_token"]),
        ("redis", ["999:7", "1000:1", "1000:2"], ["order_millis", "order_counter"]),
    ],
)
def test_text_positions_drive_a_target(spark, rows, engine, positions, columns):
    """Later positions win, also where their text sorts the other way."""
    shape = "op string, position string, ordinal bigint, row struct<id:bigint,v:string>"
    events = [("update", p, 0, (1, p)) for p in positions]
    feed, order = changes.as_feed(spark.createDataFrame(list(reversed(events)), shape), engine)
    assert order == [*columns, "order_ordinal"]
    schema = feed.select("id", "v").schema
    table = SnapshotTable(spark, scratch_path(spark, "t"), schema, ["id"], 2)
    apply_batch(feed, table, order, "one", always_new=engine in WITHOUT_WATERMARK)
    assert rows(table.read()) == [(1, positions[-1])]
    again, _ = changes.as_feed(spark.createDataFrame(events[:1], shape), engine)
    apply_batch(again, table, order, "two", always_new=engine in WITHOUT_WATERMARK)
    late_counts = engine in WITHOUT_WATERMARK
    assert rows(table.read()) == [(1, positions[0] if late_counts else positions[-1])]


def test_unreadable_positions_are_not_new(spark):
    shape = "op string, position string, ordinal bigint, row struct<id:bigint>"
    feed, _ = changes.as_feed(spark.createDataFrame([("update", "bad", 0, (1,))], shape), "postgres")
    assert feed.count() == 0



def test_times_do_not_depend_on_the_session_zone(spark, rows):
    """02:30 does not exist that day in Los Angeles; it must survive all the same."""
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS a, timestamp'2024-03-10 02:30:00.5 UTC' AS b, "
        "named_struct('t', timestamp'2024-03-10 02:30:00.25 UTC') AS c"
    )
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        line = dump.export_json(df).first()["line"]
        path = scratch_path(spark, "zones")
        dump.backup_json({"t": df}, path)
        back = dump.restore_json(spark, path)["t"]
        assert back.exceptAll(df).count() == 0 and back.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert json.loads(line) == {
        "a": "2024-03-10T02:30:00.123Z",
        "b": "2024-03-10T02:30:00.500Z",
        "c": {"t": "2024-03-10T02:30:00.250Z"},
    }


def test_restored_scores_keep_their_text(spark):
    from rowferry.operators.dump import restore_keyspace

    kind = "key string, type string, ttl long, value string"
    value = '["a","1.5","b","-2.75","c","123456789012345678901"]'
    restored = restore_keyspace(spark.createDataFrame([], kind), spark.createDataFrame([("z", "zset", 0, value)], kind))
    assert restored.first()["value"] == value


def test_the_first_of_equal_ids_is_restored(spark, rows):
    have = spark.createDataFrame([("a", 1)], "_id string, n int")
    more = spark.createDataFrame([("a", 9, 0), ("b", 3, 2), ("b", 2, 1), (None, 5, 3)], "_id string, n int, line int")
    found = dump.restore_documents(have, more.repartition(3), order=["line"])
    assert rows(found) == sorted([("a", 1), ("b", 2), (None, 5)], key=repr)
