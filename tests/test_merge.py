"""Merges against a row-by-row replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rowferry.config import ColumnMapping, Target
from rowferry.operators.fanout import fan_out, write_target
from rowferry.session import freeze
from rowferry.operators.merge import (
    apply_changes,
    apply_changes_append,
    apply_last_changes,
    delete_rows,
    insert_rows,
    last_per_key,
    split_null_keys,
    update_rows,
    upsert_keyspace,
    upsert_rows,
)

TARGET = "id int, v string, w string"


def users(spark):
    return spark.createDataFrame([(1, "Ada", "x"), (2, "Linus", None)], TARGET)


def random_feed(seed, size, hot=0.35):
    """Changes over few keys, one of which takes about a third of all."""
    pick = random.Random(seed)
    return [
        (
            pick.choice(["insert", "update", "delete"]),
            pos,
            7 if pick.random() < hot else pick.randrange(20),
            f"v{pos}",
            pick.choice([None, "w"]),
        )
        for pos in range(size)
    ]


FEED = "op string, pos int, id int, v string, w string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apply_changes_equals_row_loop(spark, rows, seed):
    feed = random_feed(seed, 200)
    state = {k: (k, "old", None) for k in range(5, 25)}
    target = spark.createDataFrame(list(state.values()), TARGET)
    for op, _, key, v, w in feed:
        if op == "delete":
            state.pop(key, None)
        else:
            state[key] = (key, v, w)
    shuffled = random.Random(seed).sample(feed, len(feed)) + feed[-30:]
    changes = spark.createDataFrame(shuffled, FEED)
    expected = sorted(state.values(), key=repr)
    assert rows(apply_changes(target, changes, ["id"], ["pos"])) == expected
    last = last_per_key(changes, ["id"], ["pos"])
    assert rows(apply_last_changes(target, last, ["id"])) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_append_mode_equals_row_loop(spark, rows, seed):
    feed = random_feed(seed, 120)
    state = [(k, "old", None) for k in range(5, 25)]
    target = spark.createDataFrame(state, TARGET)
    for op, _, key, v, w in feed:
        if op == "delete":
            state = [r for r in state if r[0] != key]
        else:
            state.append((key, v, w))
    changes = spark.createDataFrame(random.Random(seed).sample(feed, len(feed)), FEED)
    got = rows(apply_changes_append(target, changes, ["id"], ["pos"]))
    assert got == sorted(state, key=repr)


@pytest.mark.parametrize("seed", [4, 5])
def test_moved_keys_equal_row_loop(spark, rows, seed):
    pick = random.Random(seed)
    state = {k: (k, "old", None) for k in range(10)}
    target = spark.createDataFrame(list(state.values()), TARGET)
    feed = []
    for pos in range(80):
        op, key = pick.choice(["insert", "update", "delete"]), pick.randrange(12)
        old = pick.randrange(12) if op == "update" else key
        feed.append((op, pos, key, old, f"v{pos}", None))
        if op == "delete":
            state.pop(key, None)
            continue
        state.pop(old, None)
        state[key] = (key, f"v{pos}", None)
    changes = spark.createDataFrame(feed, "op string, pos int, id int, old int, v string, w string")
    got = rows(apply_changes(target, changes, ["id"], ["pos"], old_keys=["old"]))
    assert got == sorted(state.values(), key=repr)


def test_upsert_is_idempotent(spark, rows):
    delta = spark.createDataFrame([(2, "L", "y"), (3, "Grace", None)], TARGET)
    once = upsert_rows(users(spark), delta, ["id"])
    assert rows(once) == [(1, "Ada", "x"), (2, "L", "y"), (3, "Grace", None)]
    assert rows(upsert_rows(once, delta, ["id"])) == rows(once)


def test_upsert_last_input_wins(spark, rows):
    delta = spark.createDataFrame(
        [(1, "a", None, 1), (1, "b", None, 3), (1, "c", None, 2)], TARGET + ", at int"
    )
    assert (1, "b", None) in rows(upsert_rows(users(spark), delta, ["id"], ["at"]))


def test_partial_upsert_keeps_other_columns(spark, rows):
    delta = spark.createDataFrame([(1, "A"), (9, "N")], "id int, v string")
    got = rows(upsert_rows(users(spark), delta, ["id"], partial=True))
    assert got == [(1, "A", "x"), (2, "Linus", None), (9, "N", None)]
    full = rows(upsert_rows(users(spark), delta, ["id"]))
    assert (1, "A", None) in full


def test_keys_only_and_set_on_insert(spark, rows):
    keys = spark.createDataFrame([(1,), (5,)], "id int")
    assert rows(upsert_rows(users(spark), keys, ["id"])) == [
        (1, "Ada", "x"), (2, "Linus", None), (5, None, None),
    ]
    delta = spark.createDataFrame([(1, "A", "new"), (5, "B", "new")], TARGET)
    got = rows(upsert_rows(users(spark), delta, ["id"], on_insert_only=["w"]))
    assert got == [(1, "A", "x"), (2, "Linus", None), (5, "B", "new")]


def test_update_and_delete(spark, rows):
    changes = spark.createDataFrame([(2, None), (8, "z")], "id int, v string")
    assert rows(update_rows(users(spark), changes, ["id"])) == [(1, "Ada", "x"), (2, None, None)]
    gone = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert rows(delete_rows(users(spark), gone, ["id"])) == [(2, "Linus", None)]


def test_faulty_calls_are_refused(spark):
    base = users(spark)
    for call in (
        lambda: update_rows(base, base.select("id"), ["id"]),
        lambda: update_rows(base, base, []),
        lambda: delete_rows(base, base, []),
        lambda: upsert_rows(base, base, []),
        lambda: apply_changes(base, base, [], ["id"]),
        lambda: insert_rows(base, base.select()),
        lambda: insert_rows(base, base.withColumn("x", F.lit(1))),
        lambda: upsert_rows(base, base.withColumn("x", F.lit(1)), ["id"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_null_keys_become_rejects(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (None, "b", None)], TARGET)
    valid, rejects = split_null_keys(df, ["id"])
    assert rows(valid, "id") == [(1,)] and rows(rejects, "v") == [("b",)]


def test_keyspace_set_clears_type_and_expiry(spark, rows):
    store = spark.createDataFrame([("a", "list", 30, "[1]")], "key string, type string, ttl bigint, value string")
    sent = spark.createDataFrame(
        [("a", "5", 0), ("b", None, 9), ("", "x", 1)], "key string, value string, ttl int"
    )
    assert rows(upsert_keyspace(store, sent)) == [("a", "string", -1, "5"), ("b", "string", 9, "")]


def test_fan_out_reports_each_target(spark, rows):
    good = Target("people", "crm", key_columns=("key",), mapping=(ColumnMapping("id", "key"), ColumnMapping("nope", "x")))
    bad = Target("gone", create_missing=False, key_columns=("id",))
    written, outcome = fan_out(users(spark), [good, bad], {})
    assert rows(written["crm.people"]) == [(1, None), (2, None)]
    found = {r["target"]: (r["status"], r["affected"], r["outcome"]) for r in outcome.collect()}
    assert found == {"crm.people": ("success", 2, "failed"), "gone": ("failed", 0, "failed")}


def test_a_target_that_fails_while_writing_fails_alone(spark, rows):
    frame = users(spark).withColumn("late", F.when(F.col("id") == 2, F.raise_error(F.lit("torn"))).otherwise(F.col("v")))
    good = Target("good", key_columns=("id",), mapping=(ColumnMapping("id", "id"), ColumnMapping("v", "v")))
    torn = Target("torn", write_mode="insert", mapping=(ColumnMapping("id", "id"), ColumnMapping("late", "late")))
    full = Target("full", key_columns=("id",), mapping=good.mapping)

    def write(df, label):
        if label == "full":
            raise RuntimeError("no room")
        return freeze(df, label)

    written, outcome = fan_out(frame, [torn, good, full], {}, write=write)
    found = {r["target"]: (r["status"], r["affected"]) for r in outcome.collect()}
    assert found == {"torn": ("failed", 0), "good": ("success", 2), "full": ("failed", 0)}
    assert list(written) == ["good"] and rows(written["good"]) == [(1, "Ada"), (2, "Linus")]


def test_write_target_applies_changes_with_mapping(spark, rows):
    target = Target("t", key_columns=("key",), mapping=(ColumnMapping("id", "key"), ColumnMapping("v", "name")))
    table = spark.createDataFrame([(1, "old"), (2, "old")], "key int, name string")
    feed = spark.createDataFrame([("delete", 1, 1, "x", None), ("update", 2, 2, "new", None)], FEED)
    assert rows(write_target(feed, target, table, ["pos"], "op")) == [(2, "new")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """One key with a third of the feed: each map task passes on one row of it."""
    feed = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("pos")
    )
    last = last_per_key(feed, ["key"], ["pos"])
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert last.where("key = 0").first()["pos"] == 299_997


def test_hot_key_of_the_feed_is_split(spark):
    """AQE splits the hot partition of a change join instead of one task taking it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        feed = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") < 60, "delete").otherwise("insert").alias("op"),
            F.col("id").alias("pos"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"),
        )
        target = spark.range(10).select("id")
        result = apply_changes_append(target, feed, ["id"], ["pos"])
        count = result.where("id = 7").count()
        result.write.format("noop").mode("overwrite").save()
        collected = result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert "skew=true" in plan
    assert count == len([r for r in collected if r["id"] == 7]) == len(range(60, 200_000, 3))


def test_a_partial_upsert_reads_each_side_once(spark, rows, tmp_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "twin", 3), (None, "n", 4)], "id long, name string, n int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(2, "B", 1), (2, "B2", 2), (3, "c", 1), (None, "x", 1)], "id long, name string, at int").write.parquet(str(tmp_path / "d"))
    target, delta = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "d"))
    merged = upsert_rows(target, delta, ["id"], ["at"], partial=True)
    assert rows(merged) == sorted(
        [(1, "a", 1), (2, "B2", 2), (2, "B2", 3), (None, "n", 4), (3, "c", None), (None, "x", None)], key=repr
    )
    plan = upsert_rows(target, delta, ["id"], ["at"], partial=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    kept = upsert_rows(target, delta.drop("at").where("name <> 'B'"), ["id"], on_insert_only=["name"], partial=True)
    assert ("3" in str(rows(kept))) and (2, "b", 2) in rows(kept)
