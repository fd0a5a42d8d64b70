"""Polling strategies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowferry.config import WatchStrategy
from rowferry.operators.watch import (
    WatchState,
    empty_state,
    state_for,
    state_from_json,
    state_to_json,
    watch_drain,
    watch_page,
    watch_poll,
    watch_start_now,
)

INCREMENT = WatchStrategy("increment", "id")
STAMP = WatchStrategy("timestamp", "at")
SNAPSHOT = WatchStrategy("snapshot", max_tracked=100)
SHAPE = "id int, at timestamp_ntz"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def ids(df):
    return sorted((r["id"] for r in df.collect()), key=repr)


def stamped(spark, *pairs):
    return spark.createDataFrame(list(pairs), SHAPE)


def test_increment_takes_rows_past_the_cursor(spark):
    df = spark.range(10)
    page, state = watch_poll(df, INCREMENT, None, ["id"], 4)
    assert ids(page) == [0, 1, 2, 3] and state.cursor == 3
    page, state = watch_poll(df, INCREMENT, state, ["id"], 100)
    assert ids(page) == [4, 5, 6, 7, 8, 9]
    page, again = watch_poll(df, INCREMENT, state, ["id"])
    assert ids(page) == [] and again.cursor == 9


def test_increment_bound_reaches_the_scan(tables):
    strategy = WatchStrategy("increment", "o_orderkey")
    page = watch_page(tables.orders, strategy, WatchState("increment", 500), ["o_orderkey"])
    assert "GreaterThan(o_orderkey,500)" in page._jdf.queryExecution().executedPlan().toString()


def test_nulls_never_move_or_reset_the_cursor(spark):
    df = spark.createDataFrame([(None,), (3,), (None,)], "id int")
    page, state = watch_poll(df, INCREMENT, None, [])
    assert ids(page) == [3, None, None] and state.cursor == 3
    nothing = spark.createDataFrame([(None,)], "id int")
    page, state = watch_poll(nothing, INCREMENT, None, [])
    assert page.count() == 1 and state.cursor is None
    page, state = watch_poll(stamped(spark, (1, None), (2, T0)), STAMP, None, ["id"])
    assert ids(page) == [1, 2] and state.cursor == T0


@pytest.mark.parametrize("strategy", [WatchStrategy("increment", "n"), WatchStrategy("timestamp", "n")])
@pytest.mark.parametrize("limit", [7, 100])
def test_rows_without_a_tracked_value_arrive_once(spark, tmp_path, strategy, limit):
    df = spark.range(30).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") < 20, F.col("id")).alias("n"))
    seen, state = [], None
    for _ in range(6):
        page, state = watch_poll(df, strategy, state, ["id"], limit)
        seen += ids(page)
    assert sorted(seen) == list(range(30))
    text = state_to_json(state, str(tmp_path / "keys"))
    more = df.unionByName(spark.createDataFrame([(99, None)], "id int, n long"))
    for known in (state_from_json(spark, strategy, text), watch_start_now(df, strategy, ["id"])):
        assert ids(watch_poll(more, strategy, known, ["id"], limit)[0]) == [99]


def test_timestamp_ties_arrive_once(spark):
    before = stamped(spark, (1, T0), (2, T0))
    page, state = watch_poll(before, STAMP, None, ["id"])
    assert ids(page) == [1, 2]
    after = before.unionByName(stamped(spark, (3, T0), (4, T1)))
    page, state = watch_poll(after, STAMP, state, ["id"])
    assert ids(page) == [3, 4] and state.cursor == T1
    assert [r[0] for r in state.keys.collect()] == ["[4]"]


def test_more_ties_than_a_page_still_move_on(spark):
    df = stamped(spark, *[(i, T0) for i in range(25)], (99, T1))
    seen, state = [], None
    for _ in range(6):
        page, state = watch_poll(df, STAMP, state, ["id"], 5)
        seen += ids(page)
    assert sorted(seen) == [*range(25), 99]


def test_updated_rows_arrive_again(spark):
    _, state = watch_poll(stamped(spark, (1, T0)), STAMP, None, ["id"])
    page, _ = watch_poll(stamped(spark, (1, T1)), STAMP, state, ["id"])
    assert ids(page) == [1]


def test_snapshot_sees_unseen_keys_and_is_bounded(spark):
    page, state = watch_poll(spark.range(5), SNAPSHOT, None, ["id"])
    assert ids(page) == [0, 1, 2, 3, 4]
    page, state = watch_poll(spark.range(7), SNAPSHOT, state, ["id"])
    assert ids(page) == [5, 6] and state.keys.count() == 7
    page, state = watch_poll(spark.range(300), SNAPSHOT, state, ["id"])
    assert page.count() == 293 and state.keys.count() == 100
    # keys pushed out of the bounded set come again, as documented
    assert watch_poll(spark.range(300), SNAPSHOT, state, ["id"])[0].count() == 200


def test_snapshot_without_a_bound_sends_every_key_once(spark):
    strategy, df = WatchStrategy("snapshot"), spark.range(250_000)
    page, state = watch_poll(df, strategy, None, ["id"])
    assert page.count() == 250_000
    page, state = watch_poll(df, strategy, state, ["id"])
    assert page.count() == 0 and state.keys.count() == 250_000


def test_start_now_passes_over_present_rows(spark):
    state = watch_start_now(spark.range(5), INCREMENT, ["id"])
    assert ids(watch_poll(spark.range(7), INCREMENT, state, ["id"])[0]) == [5, 6]
    state = watch_start_now(stamped(spark, (1, T0), (2, T1)), STAMP, ["id"])
    later = stamped(spark, (1, T0), (2, T1), (3, T1))
    assert ids(watch_poll(later, STAMP, state, ["id"])[0]) == [3]
    state = watch_start_now(spark.range(5), SNAPSHOT, ["id"])
    assert ids(watch_poll(spark.range(6), SNAPSHOT, state, ["id"])[0]) == [5]
    assert watch_start_now(spark.range(0), INCREMENT, ["id"]) == empty_state(INCREMENT)


def test_polls_converge(spark):
    df = spark.range(60).select(
        F.col("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.expr("int(id div 9)"))).alias("at")
    )
    collected, _ = watch_drain(df, STAMP, None, ["id"], 7)
    assert sorted(r["id"] for r in collected.collect()) == list(range(60))


def test_state_text_round_trip(spark, tmp_path):
    _, state = watch_poll(stamped(spark, (1, T0), (2, T0)), STAMP, None, ["id"])
    text = state_to_json(state, str(tmp_path / "keys"))
    back = state_from_json(spark, STAMP, text)
    assert back == state and sorted(r[0] for r in back.keys.collect()) == ["[1]", "[2]"]
    for damaged in (None, "", "{}", "[1]", '{"kind": 1'):
        assert state_from_json(spark, STAMP, damaged) == empty_state(STAMP)


def test_cursor_of_another_strategy_is_dropped():
    assert state_for(STAMP, WatchState("increment", 5)) == empty_state(STAMP)
    assert state_for(INCREMENT, WatchState("increment", 5)).cursor == 5


def test_page_size_is_checked(spark):
    with pytest.raises(ValueError):
        watch_poll(spark.range(1), INCREMENT, None, ["id"], 0)
    # any page size that is asked for holds
    assert watch_poll(spark.range(6000).select("id", F.col("id").alias("n")), INCREMENT, None, ["id"], 5500)[0].count() == 5500


@pytest.mark.parametrize("strategy", [WatchStrategy("increment", "n"), WatchStrategy("timestamp", "n")])
def test_a_drain_is_the_same_as_single_polls(spark, strategy):
    value = F.col("id") if strategy.kind == "increment" else F.expr("id div 9")
    df = spark.range(40).select("id", F.when(F.col("id") % 10 != 3, value).alias("n"))
    _, start = watch_poll(df.where("id < 20"), strategy, None, ["id"], 12)
    pages, state = [], start
    while not pages or pages[-1]:
        page, state = watch_poll(df, strategy, state, ["id"], 7)
        pages.append(sorted(r["id"] for r in page.collect()))
    drained, after = watch_drain(df, strategy, start, ["id"], 7, "poll")
    found = {}
    for r in drained.collect():
        found.setdefault(r["poll"], []).append(r["id"])
    assert [sorted(found[k]) for k in sorted(found)] == pages[:-1] and min(found) == start.polls
    assert after == state and after.polls == state.polls

    def held(keys):
        return None if keys is None else {r[0] for r in keys.collect()}

    assert held(after.keys) == held(state.keys) and held(after.blank) == held(state.blank)


def test_a_drain_of_nothing(spark):
    page, state = watch_drain(spark.range(0).select("id", F.col("id").alias("n")), INCREMENT, None, ["id"], 7)
    assert page.count() == 0 and state.cursor is None and state.polls == 1


def test_a_snapshot_poll_writes_its_new_keys_only(spark, tmp_path):
    import os

    strategy, state = WatchStrategy("snapshot"), None
    for n in (3, 5, 5, 9):
        page, state = watch_poll(spark.range(n), strategy, state, ["id"])
        again, _ = watch_poll(spark.range(n), strategy, state, ["id"])
        assert again.count() == 0
    held = {r["_poll"]: r["count"] for r in state.keys.groupBy("_poll").count().collect()}
    assert held == {1: 3, 2: 2, 4: 4}
    text = state_to_json(state, str(tmp_path / "seen"))
    back = state_from_json(spark, strategy, text)
    page, back = watch_poll(spark.range(10), strategy, back, ["id"])
    assert [r["id"] for r in page.collect()] == [9] and back.place == str(tmp_path / "seen")
    # what is there already is not written again
    before = sorted(os.listdir(tmp_path / "seen"))
    assert state_from_json(spark, strategy, state_to_json(back, str(tmp_path / "seen"))).polls == back.polls
    assert sorted(os.listdir(tmp_path / "seen")) == before


def test_a_poll_of_a_payload_bridge_queues_new_rows_once(spark):
    import json

    from rowferry.config import Bridge, Payload, WatchStrategy
    from rowferry.operators.runs import run_poll

    bridge = Bridge("b", "t", ("id",), payload=Payload('{"id": "{{id}}"}'), trigger="watch", strategy=WatchStrategy("increment", "id"), per_poll=4)
    source = spark.range(1, 8).withColumn("v", F.lit("x"))
    first = run_poll(bridge, source, {}, "r", None, now="n")
    second = run_poll(bridge, source, {}, "r", first.state, first.deliveries, "n")
    third = run_poll(bridge, source, {}, "r", second.state, second.deliveries, "n")
    sent = [[(r.sequence, r.idempotency_key, json.loads(r.body)["id"]) for r in run.outbox.orderBy("sequence").collect()] for run in (first, second, third)]
    assert sent == [[(k, f"r:{k}", k + 1) for k in range(4)], [(k, f"r:{k}", k + 1) for k in range(4, 7)], []]
    assert [(r.sequence, r.row_count, r.status) for r in third.deliveries.orderBy("sequence").collect()] == [(k, 1, "queued") for k in range(7)]
