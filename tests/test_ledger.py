"""Ledger, lineage and catalog."""

import pytest
from pyspark.sql import functions as F

from rowferry.operators import catalog, ddl, ledger, lineage

RUNS = "run_id int, bridge_id int, status string, cursor_offset bigint, batch_size bigint, total_count bigint, started_at int"
SENT = "run_id int, sequence bigint, row_index bigint, row_count bigint, status string, attempts int"


def runs(spark, *extra):
    base = [
        (1, 10, "completed", 0, 10, 25, 1),
        (2, 10, "failed", 15, 10, 40, 2),
        (3, 11, "running", 0, 10, None, 1),
        (4, 12, "paused", 0, 10, 0, 1),
    ]
    return spark.createDataFrame([*base, *extra], RUNS)


def sent(spark):
    return spark.createDataFrame(
        [
            (1, 0, 0, 10, "success", 1),
            (1, 1, 10, 10, "failed", 3),
            (2, 0, 0, 10, "success", 1),
            (2, 2, 20, 10, "skipped", 0),
            (3, 0, 0, 1, "failed", 1),
        ],
        SENT,
    )


def test_plans(spark, rows):
    assert rows(ledger.planned_deliveries(runs(spark))) == [(1, 3, 5), (2, 4, 10), (3, None, None), (4, 0, None)]
    assert rows(ledger.pending_deliveries(runs(spark), sent(spark))) == [
        (1, 1, 10, 10), (1, 2, 20, 5), (2, 1, 10, 10), (2, 3, 30, 10),
    ]
    assert rows(ledger.resume_plan(runs(spark), sent(spark)), "run_id", "sequence") == [(2, 1), (2, 3)]
    assert rows(ledger.retry_failed_plan(runs(spark), sent(spark)), "run_id", "sequence") == [(1, 1), (1, 2)]


def test_progress(spark):
    got = {r["run_id"]: r[1:] for r in ledger.run_progress(runs(spark), sent(spark)).collect()}
    assert got == {
        1: (25, 20, 5, 80, 50),
        2: (40, 20, 20, 50, 100),
        3: (None, 1, None, None, 0),
        4: (0, 0, 0, None, None),
    }


def test_a_huge_run_opens_in_steps(spark):
    """200 000 sequences of one run come from four chunks over several tasks."""
    big = runs(spark, (9, 13, "failed", 0, 1, 200_000, 9)).where("run_id = 9")
    planned = ledger.planned_sequences(big)
    assert planned.agg(F.count("*"), F.countDistinct("sequence"), F.max("sequence"), F.sum("row_count")).first()[:] == (
        200_000, 200_000, 199_999, 200_000,
    )
    assert planned.select(F.spark_partition_id()).distinct().count() > 1


def test_recording_moves_counters_by_the_difference(spark, rows):
    outcomes = spark.createDataFrame(
        [(1, 1, 10, 10, "success", 4, 2), (1, 1, 10, 10, "failed", 3, 1), (1, 2, 20, 5, "success", 1, 1)],
        SENT + ", recorded_at int",
    )
    updated = ledger.record_deliveries(sent(spark), outcomes)
    assert (1, 25, 0, 0) in rows(ledger.run_counters(updated))
    again = ledger.record_deliveries(updated, outcomes)
    assert rows(again) == rows(updated)


def test_skips(spark, rows):
    wanted = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (2, 1)], "run_id int, sequence bigint")
    skipped = ledger.skip_sequences(runs(spark), sent(spark), wanted)
    assert rows(skipped, "run_id", "sequence", "row_count") == [(1, 2, 5), (2, 1, 10)]
    ranges = spark.createDataFrame([(2, 0, 3)], "run_id int, first bigint, last bigint")
    assert rows(ledger.skip_range(runs(spark), sent(spark), ranges), "sequence") == [(1,), (3,)]
    with pytest.raises(ValueError, match="at most"):
        ledger.skip_range(runs(spark), sent(spark), spark.createDataFrame([(2, 0, 3)], "run_id int, first bigint, last bigint"), limit=3)


def test_resend_keeps_the_operation(spark, rows):
    captured = spark.createDataFrame(
        [(1, 1, "delete", 1, "a", None), (3, 0, "insert", 2, "z", "new")],
        "run_id int, sequence bigint, op string, pos int, id string, v string",
    )
    target = spark.createDataFrame([("a", "old")], "id string, v string")
    after, book = ledger.resend_failed(target, runs(spark), sent(spark), captured, ["id"], ["pos"])
    assert rows(after) == []
    status = {(r["run_id"], r["sequence"]): (r["status"], r["attempts"]) for r in book.collect()}
    assert status[(1, 1)] == ("success", 4) and status[(3, 0)] == ("failed", 1)


def test_a_resend_that_cannot_be_written_stays_failed(spark, rows):
    captured = spark.createDataFrame([(1, 1, "update", 1, "a", "x")], "run_id int, sequence bigint, op string, pos int, id string, v string")
    target = spark.createDataFrame([("a", "old")], "id string, v string")

    def refuse(df, label):
        raise ValueError("no room")

    after, book = ledger.resend_failed(target, runs(spark), sent(spark), captured, ["id"], ["pos"], refuse)
    assert rows(after) == [("a", "old")]
    status = {(r["run_id"], r["sequence"]): (r["status"], r["attempts"]) for r in book.collect()}
    assert status[(1, 1)] == ("failed", 4)


def test_a_window_is_as_long_as_asked_for(spark):
    many = spark.range(2500).selectExpr("1 AS run_id", "id AS sequence", "'success' AS status")
    assert ledger.delivery_window(many, 1, limit=2400).count() == 2400


def test_abort_and_windows(spark, rows):
    more = sent(spark).unionByName(spark.createDataFrame([(1, 2, 20, 5, "success", 1)], SENT))
    assert rows(ledger.abort_cut(more), "run_id", "sequence") == [(1, 0), (1, 1), (2, 0), (2, 2), (3, 0)]
    assert rows(ledger.delivery_window(more, 1, "success"), "sequence") == [(0,), (2,)]
    assert rows(ledger.delivery_window(more, 1, first=1, last=2, offset=1), "sequence") == [(2,)]
    assert [r["run_id"] for r in ledger.list_runs(runs(spark), 10).collect()] == [2, 1]


def test_bridge_states(spark):
    bridges = spark.createDataFrame([(10, True), (11, True), (12, True), (13, True), (14, False)], "bridge_id int, enabled boolean")
    got = {r["bridge_id"]: r["status"] for r in ledger.bridge_status(bridges, runs(spark)).collect()}
    assert got == {10: "failed", 11: "active", 12: "idle", 13: "idle", 14: "disabled"}


TARGETS = "array<struct<connection:string,schema:string,table:string,write_mode:string,key_columns:array<string>,mapping:array<struct<source:string,target:string>>>>"


def bridges(spark):
    db = ("c2", "public", "users", "upsert", ["id"], [])
    other = ("c3", None, "people", "upsert", [], [])
    shape = (
        "bridge_id int, name string, source_connection string, source_table string, trigger_kind string, "
        "watch_strategy string, watch_column string, enabled boolean, selected_keys bigint, source_key array<string>, "
        f"columns array<string>, http_method string, http_url string, targets {TARGETS}"
    )
    return spark.createDataFrame(
        [
            (1, "a", "c1", "t", "replay", None, None, True, None, ["id"], ["id"], None, None, [db, other]),
            (2, "b", "c2", "t", "watch", "increment", None, True, 3, ["id"], ["id"], "POST", "https://api.example.com:8443/x?y=1", []),
            (3, "c", "c2", "t", "watch", "snapshot", None, True, 1, ["a", "b"], [], "PUT", "not a url", []),
            (4, "d", "c4", "t", "replay", None, None, True, None, ["id"], ["id"], None, None, []),
        ],
        shape,
    )


def test_labels_nodes_and_usage(spark, rows):
    labels = {r["bridge_id"]: r["label"] for r in lineage.destination_labels(bridges(spark)).collect()}
    assert labels == {1: "public.users +1", 2: "POST api.example.com", 3: "PUT not a url", 4: "database"}
    assert rows(lineage.destination_nodes(bridges(spark))) == [
        (1, "db:c2:public.users"), (1, "db:c3:people"), (2, "http:api.example.com"), (3, "http:not a url"),
    ]
    assert rows(lineage.connection_usage(bridges(spark))) == [("c1", 1), ("c2", 3), ("c3", 1), ("c4", 1)]


def test_problems(spark, rows):
    assert rows(lineage.bridge_problems(bridges(spark))) == [
        (1, "upsert without keys"),
        (2, "watch without column"),
        (3, "key selection without a one-column key"),
        (3, "no columns"),
        (4, "no target"),
    ]


def test_lineage_edges_carry_the_status(spark, rows):
    got = rows(lineage.bridge_lineage(bridges(spark), runs(spark, (5, 2, "running", 0, 1, 1, 1))), "source", "target", "status")
    assert ("conn:c2", "bridge:2", "active") in got and ("bridge:1", "db:c3:people", "idle") in got


def test_foreign_key_resolution(spark, rows):
    tables = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "schema_name string, table_name string")
    fks = spark.createDataFrame(
        [
            ("same", "b", "y", "k", None, "x"),
            ("exact", "b", "y", "k", "a", "x"),
            ("by_name", "a", "x", "k", None, "y"),
            ("first", "c", "z", "k", "gone", "x"),
            ("lost", "b", "y", "k", None, "nowhere"),
        ],
        "fk_name string, schema_name string, table_name string, columns string, referenced_schema string, referenced_table string",
    )
    assert rows(lineage.fk_edges(tables, fks), "fk_name", "target") == [
        ("by_name", "b.y"), ("exact", "a.x"), ("first", "a.x"), ("same", "b.x"),
    ]


def test_session_catalog(spark, rows):
    ddl.create_database(spark, "rf_probe")
    assert ("rf_probe",) in rows(catalog.list_databases(spark))
    ddl.save_table(spark.range(3), "rf_probe.numbers")
    assert rows(catalog.list_tables(spark, "rf_probe").where("kind = 'table'"), "table_name") == [("numbers",)]
    ddl.drop_table(spark, "rf_probe.numbers")
    ddl.drop_database(spark, "rf_probe")
    for call in (ddl.create_database, ddl.drop_database):
        with pytest.raises(ValueError):
            call(spark, "x", "sqlite")
        with pytest.raises(ValueError):
            call(spark, "x; drop")


def test_created_table_keeps_types(spark):
    table = ddl.create_table(
        spark,
        ddl.TableSpec(
            "t",
            (
                ddl.ColumnSpec("id", "bigint", primary_key=True),
                ddl.ColumnSpec("d", "decimal(38,10)"),
                ddl.ColumnSpec("day", "date"),
                ddl.ColumnSpec("span", "interval"),
                ddl.ColumnSpec("at", "timestamp"),
                ddl.ColumnSpec("note", "longtext", nullable=False),
            ),
        ),
    )
    kinds = [(f.dataType.simpleString(), f.nullable) for f in table.schema.fields]
    assert kinds == [
        ("bigint", False), ("decimal(38,10)", True), ("date", True),
        ("string", True), ("timestamp_ntz", True), ("string", False),
    ]
    assert catalog.schema_columns("t", table, ["id"]).where("is_primary_key").count() == 1
    assert ddl.truncate_table(spark.range(5)).count() == 0


def test_constraints(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "id int, v string")
    assert rows(ddl.check_constraints(df, ["id"], [["id"]])) == [
        ("not_null", "id", None, 2), ("unique", "id", "[1]", 2),
    ]
