"""Polling a table for new rows by increment, timestamp or key difference.

Single values of a state live on the driver, so the next poll's bound reaches
the file scan; sets of keys live in written tables and are only ever joined.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.config import DEFAULT_PER_POLL, Sort, WatchStrategy
from rowferry.functions.literals import value_literal
from rowferry.functions.text import row_key
from rowferry.operators.row_index import row_index_sequence
from rowferry.operators.top import top_rows
from rowferry.session import freeze, scratch_path

POLL = "poll"


@dataclass(frozen=True)
class WatchState:
    """What one strategy remembers between polls.

    ``blank`` holds the keys of the sent rows without a tracked value. ``place``
    is the folder of a snapshot's seen keys, to which each poll adds a subfolder
    with its new ones; ``keys`` reads those of the polls so far.
    """

    kind: str
    cursor: Any = None
    keys: DataFrame | None = field(default=None, compare=False)
    polls: int = 0
    blank: DataFrame | None = field(default=None, compare=False)
    place: str | None = field(default=None, compare=False)


def empty_state(strategy: WatchStrategy) -> WatchState:
    return WatchState(strategy.kind)


def state_for(strategy: WatchStrategy, state: WatchState | None) -> WatchState:
    """A stored state, or a new one when it belongs to another strategy."""
    return state if state is not None and state.kind == strategy.kind else empty_state(strategy)


def state_to_json(state: WatchState, keys_path: str | None = None) -> str:
    """Portable text of a state; its key tables are saved to ``keys_path`` and beside it.

    Seen keys that lie there already, since the state was read from there, stay.
    """
    if state.place is not None:
        if state.place != keys_path:
            state.keys.select("_key").write.parquet(f"{keys_path}/{POLL}={state.polls}")
    elif state.keys is not None:
        state.keys.write.parquet(keys_path)
    if state.blank is not None:
        if keys_path is None:
            raise ValueError("a state with keys needs a path for them")
        state.blank.write.parquet(f"{keys_path}-blank")
    value = state.cursor.isoformat() if hasattr(state.cursor, "isoformat") else state.cursor
    return json.dumps(
        {
            "kind": state.kind,
            "cursor": value,
            "stamp": hasattr(state.cursor, "isoformat"),
            "keys": keys_path if state.keys is not None else None,
            "polls": state.polls,
            "added": state.place is not None,
            "blank": f"{keys_path}-blank" if state.blank is not None else None,
        }
    )


def state_from_json(spark: SparkSession, strategy: WatchStrategy, text: str | None) -> WatchState:
    """A state from its text; damaged text starts over."""
    import datetime as dt

    try:
        stored = json.loads(text)
        cursor = stored["cursor"]
        if stored["stamp"]:
            cursor = dt.datetime.fromisoformat(cursor)
        added = stored["keys"] if stored.get("added") else None
        if added:
            keys = _seen(spark, added, stored["polls"])
        else:
            keys = spark.read.parquet(stored["keys"]) if stored["keys"] else None
        blank = spark.read.parquet(stored["blank"]) if stored.get("blank") else None
        state = WatchState(stored["kind"], cursor, keys, stored["polls"], blank, added)
    except (TypeError, ValueError, KeyError):
        return empty_state(strategy)
    return state_for(strategy, state)


def _check_cap(limit: int) -> None:
    if limit < 1:
        raise ValueError(f"a poll takes at least one row, not {limit}")


def _seen(spark: SparkSession, place: str, polls: int) -> DataFrame:
    """The keys that a snapshot watch has seen up to a poll."""
    held = spark.read.schema(f"_key string, {POLL} int").option("basePath", place).parquet(place)
    return held.where(F.col(POLL) <= polls).select("_key", F.col(POLL).alias("_poll"))


def _add_seen(fresh: DataFrame, place: str | None, number: int) -> WatchState:
    """Write the keys of one poll beside those of the polls before."""
    spark = fresh.sparkSession
    place = place or scratch_path(spark, "seen")
    fresh.select("_key").write.mode("overwrite").parquet(f"{place}/{POLL}={number}")
    return WatchState("snapshot", None, _seen(spark, place, number), number, place=place)


def _blank_keys(df: DataFrame, strategy: WatchStrategy, keys: Sequence[str]) -> DataFrame | None:
    """Keys of the rows without a tracked value; None where the column always has one."""
    if not df.select(strategy.column).schema[0].nullable:
        return None
    return df.where(F.col(strategy.column).isNull()).select(
        row_key(df.schema, list(keys)).alias("_key")
    )


def _unsent(df: DataFrame, strategy: WatchStrategy, state: WatchState, keys: Sequence[str]) -> DataFrame:
    """All rows past the cursor, and those without a tracked value, that were not sent."""
    tracked = F.col(strategy.column)
    blank = df.where(tracked.isNull())
    if state.blank is not None:
        blank = blank.withColumn("_key", row_key(df.schema, list(keys)))
        blank = blank.join(state.blank, "_key", "left_anti").drop("_key")
    rows = df if state.blank is None else df.where(tracked.isNotNull())
    if state.cursor is not None:
        bound = value_literal(state.cursor)
        rows = df.where(tracked > bound if strategy.kind == "increment" else tracked >= bound)
        if strategy.kind == "timestamp" and state.keys is not None:
            # later rows cannot be in the boundary, so only its instant is joined
            at_bound = rows.where(tracked == bound).withColumn(
                "_key", row_key(df.schema, list(keys))
            )
            fresh = at_bound.join(state.keys, "_key", "left_anti").drop("_key")
            rows = rows.where(tracked > bound).unionByName(fresh)
    if state.blank is not None or state.cursor is not None:
        rows = rows.unionByName(blank)
    return rows


def watch_page(
    df: DataFrame,
    strategy: WatchStrategy,
    state: WatchState,
    keys: Sequence[str],
    limit: int = DEFAULT_PER_POLL,
) -> DataFrame:
    """Rows of the next poll in order, without those already sent.

    The boundary keys are taken out before the limit, so an instant with more
    rows than a page still moves on. Rows without a tracked value come last,
    never hold the cursor back, and are sent once per key, in whichever page has
    room for them. A snapshot poll takes all unseen rows.
    """
    _check_cap(limit)
    if strategy.kind == "snapshot":
        unseen = df.withColumn("_key", row_key(df.schema, list(keys)))
        if state.keys is not None:
            unseen = unseen.join(state.keys.select("_key"), "_key", "left_anti")
        return unseen.drop("_key")
    tracked = F.col(strategy.column)
    rows = _unsent(df, strategy, state, keys)
    ties = [F.col(k).asc_nulls_first() for k in keys if k != strategy.column]
    return top_rows(rows, [tracked.asc_nulls_last(), *ties], limit)


def watch_poll(
    df: DataFrame,
    strategy: WatchStrategy,
    state: WatchState | None,
    keys: Sequence[str],
    limit: int = DEFAULT_PER_POLL,
) -> tuple[DataFrame, WatchState]:
    """New rows (written once, so that state and rows agree) and the next state."""
    state = state_for(strategy, state)
    page = freeze(watch_page(df, strategy, state, keys, limit), "poll")
    if strategy.kind == "snapshot":
        return page, _next_snapshot(page, strategy, state, keys)
    return page, _next_tracked(page, strategy, state, keys, 1)


def _next_tracked(page: DataFrame, strategy: WatchStrategy, state: WatchState, keys: Sequence[str], polls: int) -> WatchState:
    """The state after the rows of so many polls."""
    newest, number = page.agg(F.max(strategy.column)).first()[0], state.polls + polls
    blank, sent = state.blank, _blank_keys(page, strategy, keys)
    if sent is not None and not sent.isEmpty():
        blank = freeze(sent if blank is None else blank.unionByName(sent), "blank")
    if newest is None:
        return replace(state, polls=number, blank=blank)
    if strategy.kind == "increment":
        return WatchState("increment", newest, None, number, blank)
    boundary = page.where(F.col(strategy.column) == value_literal(newest)).select(
        row_key(page.schema, list(keys)).alias("_key")
    )
    if newest == state.cursor and state.keys is not None:
        boundary = boundary.unionByName(state.keys).distinct()
    return WatchState("timestamp", newest, freeze(boundary, "boundary"), number, blank)


def _next_snapshot(page, strategy, state, keys) -> WatchState:
    """Seen keys and the new ones, which alone are written.

    With ``max_tracked`` the set is bounded, and its newest keys are written anew.
    """
    number = state.polls + 1
    fresh = page.select(
        row_key(page.schema, list(keys)).alias("_key"), F.lit(number).alias("_poll")
    )
    if strategy.max_tracked is None and (state.keys is None or state.place is not None):
        return _add_seen(fresh, state.place, number)
    seen = fresh if state.keys is None else state.keys.unionByName(fresh)
    if strategy.max_tracked is None:
        return _add_seen(seen, None, number)
    if seen.count() > strategy.max_tracked:
        # ranked in range partitions: the first poll may find any number of keys
        ranked = row_index_sequence(seen, [Sort("_poll", "desc"), Sort("_key", "desc")])
        seen = ranked.where(F.col("row_index") < strategy.max_tracked).select("_key", "_poll")
    return WatchState("snapshot", None, freeze(seen, "seen"), number)


def watch_start_now(
    df: DataFrame, strategy: WatchStrategy, keys: Sequence[str]
) -> WatchState:
    """A state that passes over the rows present now; an empty table gives the beginning."""
    if strategy.kind == "snapshot":
        present = df.select(row_key(df.schema, list(keys)).alias("_key"))
        if strategy.max_tracked is None:
            return _add_seen(present, None, 0)
        return WatchState("snapshot", None, freeze(present.withColumn("_poll", F.lit(0)), "seen"), 0)
    newest = df.agg(F.max(strategy.column)).first()[0]
    blank = _blank_keys(df, strategy, keys)
    blank = None if blank is None else freeze(blank, "blank")
    if newest is None:
        return replace(empty_state(strategy), blank=blank)
    if strategy.kind == "increment":
        return WatchState("increment", newest, blank=blank)
    boundary = df.where(F.col(strategy.column) == value_literal(newest)).select(
        row_key(df.schema, list(keys)).alias("_key")
    )
    return WatchState("timestamp", newest, freeze(boundary, "boundary"), blank=blank)


def watch_drain(
    df: DataFrame,
    strategy: WatchStrategy,
    state: WatchState | None,
    keys: Sequence[str],
    limit: int = DEFAULT_PER_POLL,
    poll: str | None = None,
) -> tuple[DataFrame, WatchState]:
    """The rows of all polls until one finds nothing, and the state after that one.

    Polls cut one total order (tracked value, keys) into pages, so the poll of a
    row is its row number by the page size: any backlog is one numbering job,
    with rows and end state as single polls leave them. ``poll`` names a column
    for the number of the poll. An increment column is taken to be unique.
    """
    _check_cap(limit)
    state = state_for(strategy, state)
    if strategy.kind == "snapshot":
        page, after = watch_poll(df, strategy, state, keys, limit)
        numbered = page if poll is None else page.withColumn(poll, F.lit(state.polls).cast("bigint"))
        return numbered, replace(after, polls=after.polls + 1)
    rows = _unsent(df, strategy, state, keys)
    # rows without a tracked value come last
    ordered = rows.withColumn("_blank", F.col(strategy.column).isNull())
    order = [Sort("_blank"), Sort(strategy.column)]
    page = row_index_sequence(ordered, order, keys, limit, "_index", "_page").drop("_index", "_blank")
    count = page.agg(F.max("_page")).first()[0]
    after = _next_tracked(page.drop("_page"), strategy, state, keys, (0 if count is None else count + 1) + 1)
    if poll is None:
        return page.drop("_page"), after
    return page.withColumn(poll, F.col("_page") + state.polls).drop("_page"), after
