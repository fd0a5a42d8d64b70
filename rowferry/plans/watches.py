"""Polling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import WatchStrategy
from rowferry.functions.literals import value_literal
from rowferry.operators import watch
from rowferry.plans.registry import query

_INCREMENT = WatchStrategy("increment", "o_orderkey")
_STAMP = WatchStrategy("timestamp", "o_orderdate")
_SNAPSHOT = WatchStrategy("snapshot")
_KEY = ["o_orderkey"]


@query(
    "watch_increment",
    """SELECT *, max(o_orderkey) OVER () AS next_cursor FROM
       (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 499 ORDER BY o_orderkey LIMIT 500)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    page, state = watch.watch_poll(rows, _INCREMENT, watch.WatchState("increment", 499), _KEY)
    return page.withColumn("next_cursor", F.lit(state.cursor).cast("bigint"))


@query(
    "watch_timestamp",
    """SELECT o_orderkey, o_orderdate, o_orderdate = max(o_orderdate) OVER () AS at_boundary FROM
       (SELECT o_orderkey, o_orderdate FROM
          (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
        WHERE n > 700 AND n <= 1400)""",
)
def _(t):
    """The second page of 700; the first one ends in the middle of a day."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    _, state = watch.watch_poll(rows, _STAMP, None, _KEY, 700)
    page, state = watch.watch_poll(rows, _STAMP, state, _KEY, 700)
    return page.withColumn("at_boundary", F.col("o_orderdate") == value_literal(state.cursor))


@query(
    "watch_snapshot",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
)
def _(t):
    """Rows that were not there at the first poll."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    _, state = watch.watch_poll(rows.where("o_orderstatus = 'F'"), _SNAPSHOT, None, _KEY)
    return watch.watch_poll(rows, _SNAPSHOT, state, _KEY)[0]


@query(
    "watch_snapshot_state",
    """SELECT '[' || c_custkey || ']' AS seen FROM customer ORDER BY '[' || c_custkey || ']' DESC LIMIT 100""",
)
def _(t):
    """The seen set after one poll, bounded to the newest 100 keys."""
    strategy = WatchStrategy("snapshot", max_tracked=100)
    _, state = watch.watch_poll(t.customer, strategy, None, ["c_custkey"])
    return state.keys.select(F.col("_key").alias("seen"))


@query(
    "watch_start_now",
    """SELECT '[' || o_orderkey || ']' AS boundary_key, o_orderdate AS cursor FROM orders
       WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
)
def _(t):
    state = watch.watch_start_now(t.orders, _STAMP, _KEY)
    return state.keys.select(F.col("_key").alias("boundary_key"), value_literal(state.cursor).alias("cursor"))


@query(
    "watch_page_cap",
    """SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 5000""",
)
def _(t):
    rows = t.events.select("event_id", "ts")
    return watch.watch_page(
        rows, WatchStrategy("timestamp", "ts"), watch.WatchState("timestamp"), ["event_id"], 5000
    )


@query("watch_converge", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    """Polls until nothing is new; every order arrives exactly once."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return watch.watch_drain(rows, _STAMP, None, _KEY, 5000)[0]


@query(
    "watch_converge_polls",
    """SELECT i // 700 AS poll, count(*) AS row_count, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day,
              (SELECT count(*) // 700 FROM orders) + 2 AS polls
       FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) GROUP BY i // 700""",
)
def _(t):
    """What each of these polls brings, and the number of polls in the state at the end."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    drained, state = watch.watch_drain(rows, _STAMP, None, _KEY, 700, "poll")
    pages = drained.groupBy("poll").agg(
        F.count("*").alias("row_count"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day")
    )
    return pages.withColumn("polls", F.lit(state.polls).cast("bigint"))


@query(
    "watch_snapshot_polls",
    """SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS INTEGER) AS poll, count(*) AS keys_written
       FROM orders GROUP BY 1""",
)
def _(t):
    """The keys that three polls of a growing table have written."""
    rows, state = t.orders.select("o_orderkey", "o_orderstatus"), None
    for present in ("F", "FO", "FOP"):
        shown = rows.where(F.col("o_orderstatus").isin(*present))
        _, state = watch.watch_poll(shown, _SNAPSHOT, state, _KEY)
    return state.keys.groupBy(F.col("_poll").alias("poll")).agg(F.count("*").alias("keys_written"))


@query("watch_reset_on_change", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def _(t):
    """A cursor of another strategy is not used: the poll starts over."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return watch.watch_poll(rows, _STAMP, watch.WatchState("increment", 100), _KEY)[0]
