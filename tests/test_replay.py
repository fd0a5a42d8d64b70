"""Copies that fail, stop and begin anew: every row once per target, a status per delivery."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import Bridge, ColumnMapping, Delivery, Target
from rowferry.operators import progress, runs
from rowferry.operators.commit import SnapshotTable
from rowferry.session import scratch_path

PAIR = T.StructType().add("id", T.LongType()).add("v", T.StringType())


def table(spark, schema=PAIR, keys=("id",)):
    return SnapshotTable(spark, scratch_path(spark, "t"), schema, list(keys), 2)


def source(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))


def journals(*names, batch_size=20, on_error="continue"):
    targets = tuple(Target(n, write_mode="insert") for n in names)
    return Bridge("b", "s", ("id",), targets=targets, delivery=Delivery(batch_size=batch_size, on_error=on_error))


def ids(target):
    return sorted(r["id"] for r in target.read().collect())


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "row_index long")


def test_spans_against_sets(spark, monkeypatch):
    monkeypatch.setattr(progress, "WIDTH", 16)
    rng = random.Random(1)
    for _ in range(3):
        have = set(rng.sample(range(300), 200)) | set(range(400, 600))
        spans = progress.merge_spans(progress.spans_of(numbers(spark, have), "r")).collect()
        assert sorted(n for s in spans for n in range(s["first"], s["last"] + 1)) == sorted(have)
        ends = sorted((s["first"], s["last"]) for s in spans)
        assert all(b[0] > a[1] + 1 for a, b in zip(ends, ends[1:]))
        rows = numbers(spark, list(range(620)) * 2)
        left = progress.outside_spans(rows, spark.createDataFrame(spans, progress.SPANS))
        assert sorted(r[0] for r in left.collect()) == sorted([n for n in range(620) if n not in have] * 2)


def test_spans_that_overlap_and_touch(spark, rows):
    spans = spark.createDataFrame([("r", 0, 4), ("r", 5, 9), ("r", 3, 7), ("r", 11, 11), ("q", 10, 10), ("r", 2, 2)], progress.SPANS)
    assert rows(progress.merge_spans(spans)) == [("q", 10, 10), ("r", 0, 9), ("r", 11, 11)]
    empty = spark.createDataFrame([], progress.SPANS)
    assert progress.merge_spans(empty).count() == 0
    assert progress.outside_spans(numbers(spark, [1, 2]), empty).count() == 2


def test_joins_with_spans_are_on_equal_keys(spark):
    spans = spark.createDataFrame([("r", 0, 10**9)], progress.SPANS)
    plan = progress.outside_spans(numbers(spark, [1]), spans)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("batch_size", [1, 20])
def test_a_retry_with_one_more_row_writes_no_row_twice(spark, batch_size):
    bridge, left, right = journals("left", "right", batch_size=batch_size), table(spark), table(spark)
    failed = runs.run_replay(bridge, source(spark, 10), {"left": left}, "run")
    assert failed.status == "failed" and {r["status"] for r in failed.deliveries.collect()} == {"failed"}
    healed = runs.run_replay(bridge, source(spark, 11), {"left": left, "right": right}, "run", failed.deliveries)
    assert healed.status == "completed"
    assert ids(left) == ids(right) == list(range(11))


def test_a_copy_from_further_back_writes_the_rest(spark, rows):
    bridge, left = journals("left", batch_size=1), table(spark)
    late = runs.run_replay(bridge, source(spark, 10), {"left": left}, "run", cursor_offset=2)
    runs.run_replay(bridge, source(spark, 10), {"left": left}, "run", late.deliveries)
    # the ledger may be lost: the target knows what it has
    runs.run_replay(bridge, source(spark, 10), {"left": left}, "run")
    assert ids(left) == list(range(10))
    assert rows(left.delivered("run")) == [("run", 0, 9)]
    # another run is another copy
    runs.run_replay(bridge, source(spark, 10), {"left": left}, "again")
    assert left.read().count() == 20


def test_a_crash_before_the_ledger_was_written(spark, rows, monkeypatch):
    bridge, left = journals("left"), table(spark)
    with monkeypatch.context() as broken:
        broken.setattr(runs, "record_deliveries", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.run_replay(bridge, source(spark, 5), {"left": left}, "run")
    assert left.read().count() == 5
    done = runs.run_replay(bridge, source(spark, 9), {"left": left}, "run")
    assert left.read().count() == 9 and done.status == "completed"


def test_inserts_leave_published_files_alone(spark):
    bridge, left = journals("left", batch_size=1), table(spark)
    first = runs.run_replay(bridge, source(spark, 50), {"left": left}, "run")
    before = {b: f for b, f in left.version().layout.items()}
    runs.run_replay(bridge, source(spark, 60), {"left": left}, "run", first.deliveries)
    after = left.version().layout
    assert all(after[b][: len(f)] == f for b, f in before.items()) and left.read().count() == 60
    stale = left.vacuum(keep=1)
    assert left.read().count() == 60 and left.delivered("run").count() == 1 and len(stale) == 1


def odd(spark, n, bad):
    return spark.range(n).select("id", F.when(F.col("id").isin(*bad), "x").otherwise(F.col("id").cast("string")).alias("v"))


NUMBERS = T.StructType().add("id", T.LongType()).add("v", T.IntegerType())


def test_a_delivery_fails_whole_and_alone(spark, rows):
    bridge, left, text = journals("left", "text", batch_size=3), table(spark, NUMBERS), table(spark)
    result = runs.run_replay(bridge, odd(spark, 12, [4]), {"left": left, "text": text}, "run")
    assert result.status == "failed"
    assert rows(result.deliveries, "sequence", "status", "error") == [
        (0, "success", None), (1, "failed", "left: v is no int"), (2, "success", None), (3, "success", None)
    ]
    assert ids(left) == [0, 1, 2, 6, 7, 8, 9, 10, 11] and text.read().count() == 12
    healed = runs.run_replay(bridge, odd(spark, 12, [-1]), {"left": left, "text": text}, "run", result.deliveries)
    assert ids(left) == ids(text) == list(range(12))
    assert rows(healed.deliveries, "sequence", "status", "attempts") == [(0, "success", 1), (1, "success", 2), (2, "success", 1), (3, "success", 1)]


def test_abort_stops_at_the_first_failed_delivery(spark, rows):
    bridge, left, text = journals("left", "text", batch_size=2, on_error="abort"), table(spark, NUMBERS), table(spark)
    result = runs.run_replay(bridge, odd(spark, 60, [25, 31]), {"left": left, "text": text}, "run")
    assert result.status == "failed"
    assert rows(result.deliveries.where("status = 'failed'"), "sequence", "error") == [(12, "left: v is no int")]
    assert result.deliveries.count() == 13
    assert ids(left) == list(range(24)) and text.read().count() == 26
    healed = runs.run_replay(bridge, odd(spark, 60, [-1]), {"left": left, "text": text}, "run", result.deliveries)
    assert healed.status == "completed" and left.read().count() == text.read().count() == 60
    assert healed.deliveries.where("status = 'success'").count() == 30


def test_abort_with_a_target_that_takes_nothing(spark, rows):
    bridge, left = journals("left", "late", batch_size=2, on_error="abort"), table(spark)
    result = runs.run_replay(bridge, source(spark, 60), {"left": left}, "run")
    assert rows(result.deliveries, "sequence", "status") == [(0, "failed")] and left.read().count() == 2
    late = table(spark)
    runs.run_replay(bridge, source(spark, 60), {"left": left, "late": late}, "run", result.deliveries)
    assert left.read().count() == late.read().count() == 60


def test_waves():
    assert list(runs.waves(3, 40, True)) == [(3, 3), (4, 13), (14, 40)]
    assert list(runs.waves(3, 40, False)) == [(3, 40)] and list(runs.waves(4, 3, True)) == []


def test_values_that_have_to_be_there(spark, rows):
    schema = T.StructType().add("id", T.LongType()).add("v", T.StringType(), False)
    left = table(spark, schema)
    data = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    result = runs.run_replay(journals("left", batch_size=1), data, {"left": left}, "run")
    assert rows(result.deliveries, "sequence", "error") == [(0, None), (1, "left: v has no value"), (2, None)]
    assert ids(left) == [1, 3]


def test_nothing_to_copy(spark):
    left = table(spark)
    result = runs.run_replay(journals("left"), source(spark, 0), {"left": left}, "run")
    assert result.status == "completed" and result.deliveries.count() == 0 and left.version().number == 0


def test_unknown_columns_and_other_keys_fail_their_target(spark, rows):
    bridge = Bridge("b", "s", ("id",), targets=(
        Target("left", write_mode="insert", mapping=(ColumnMapping("id", "id"), ColumnMapping("v", "w"))), Target("right", key_columns=("v",)),
        Target("none"),
    ))
    found = runs.run_replay(bridge, source(spark, 1), {n: table(spark) for n in ("left", "right", "none")}, "run").deliveries
    assert rows(found, "status", "error") == [("failed", "left: the target has no column ['w']")]
