"""Change events of four engines brought into one shape.

The common shape is ``op``, ``position``, ``ordinal`` and the row image as a
struct ``row`` (or JSON text where the source has no schema). ``ordinal``
orders changes that share a position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import OPERATIONS, Filter
from rowferry.functions.literals import value_literal
from rowferry.functions.positions import position_order
from rowferry.functions.predicates import compile_filters, matches_glob

# Event names of the sources.
ROW_EVENTS = {"writerows": "insert", "updaterows": "update", "deleterows": "delete"}
DOCUMENT_EVENTS = {
    "insert": "insert",
    "update": "update",
    "replace": "update",
    "delete": "delete",
}
# the position that each partition of a log has reached
Vector = dict[str, list]
KEY_DELETE_EVENTS = ("del", "unlink", "expired", "evicted")


def _renamed(events: dict[str, str], column: Column) -> Column:
    pairs = [F.lit(item) for entry in events.items() for item in entry]
    return F.create_map(*pairs)[column]


def normalize_changes_pg(feed: DataFrame, schema: str, table: str) -> DataFrame:
    """Messages of one table; a delete carries the old row, else its key."""
    wanted = (
        F.col("tag").isin(*OPERATIONS)
        & (F.col("relation.schema") == schema)
        & (F.col("relation.name") == table)
    )
    image = F.when(F.col("tag") == "delete", F.coalesce("old", "key")).otherwise(F.col("new"))
    ordinal = F.col("ordinal") if "ordinal" in feed.columns else F.lit(0).cast("bigint")
    return feed.where(wanted).select(
        F.col("tag").alias("op"),
        F.col("lsn").alias("position"),
        ordinal.alias("ordinal"),
        image.alias("row"),
    )


def normalize_changes_mysql(feed: DataFrame) -> DataFrame:
    """One change per row of an event, each with its own position.

    Rows of an event are fanned out by a generator, which streams them.
    """
    rows = feed.where(F.col("event").isin(*ROW_EVENTS)).select(
        _renamed(ROW_EVENTS, F.col("event")).alias("op"),
        "file",
        "next_position",
        F.posexplode("rows").alias("ordinal", "change"),
    )
    image = F.when(F.col("op") == "delete", F.col("change.before")).otherwise(F.col("change.after"))
    return rows.select(
        "op",
        F.concat_ws(
            ":", "file", F.col("next_position").cast("string"), F.col("ordinal").cast("string")
        ).alias("position"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        image.alias("row"),
    )


def normalize_changes_mongo(feed: DataFrame) -> DataFrame:
    """Document changes; a replace is an update, other event types are dropped."""
    op = _renamed(DOCUMENT_EVENTS, F.col("operationType"))
    image = F.when(
        F.col("operationType") == "delete", F.coalesce("fullDocumentBeforeChange", "documentKey")
    ).otherwise(F.coalesce("fullDocument", "documentKey"))
    return feed.where(F.col("operationType").isin(*DOCUMENT_EVENTS)).select(
        op.alias("op"),
        F.col("_id").alias("position"),
        F.lit(0).cast("bigint").alias("ordinal"),
        image.alias("row"),
    )


def normalize_changes_redis(
    feed: DataFrame, keyspace: DataFrame, key_glob: str | None = None
) -> DataFrame:
    """Key events with the current value of the key; deletes carry the key only.

    The keyspace side has unique keys, so AQE can split a hot key of the feed.
    """
    events = feed.where(matches_glob(F.col("key"), key_glob)) if key_glob else feed
    removed = F.col("event").isin(*KEY_DELETE_EVENTS)
    joined = events.withColumn("op", F.when(removed, "delete").otherwise("update")).join(
        keyspace.select("key", "type", "value"), "key", "left"
    )
    written = F.col("op") != "delete"
    return joined.select(
        "op",
        "position",
        F.lit(0).cast("bigint").alias("ordinal"),
        F.struct(
            "key",
            "event",
            F.when(written, F.coalesce("type", F.lit("none"))).alias("type"),
            F.when(written, F.col("value")).alias("value"),
        ).alias("row"),
    )


NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "postgres": normalize_changes_pg,
    "mysql": normalize_changes_mysql,
    "mongodb": normalize_changes_mongo,
    "redis": normalize_changes_redis,
}


def filter_change_ops(
    feed: DataFrame, operations: Sequence[str], engine: str = "postgres", op: str = "op"
) -> DataFrame:
    """Changes of the enabled operations.

    A key-value source cannot tell insert from update, so either one admits
    every write.
    """
    unknown = [o for o in operations if o not in OPERATIONS]
    if unknown or not operations:
        raise ValueError(f"operations must be among {OPERATIONS}, not {list(operations)}")
    admitted = set(operations)
    if engine == "redis" and admitted & {"insert", "update"}:
        admitted |= {"insert", "update"}
    name = F.when(F.col(op) == "replace", "update").otherwise(F.col(op))
    return feed.where(name.isin(*sorted(admitted)))


def filter_changes(
    feed: DataFrame, filters: Iterable[Filter], dialect: str = "sql", op: str = "op"
) -> DataFrame:
    """Source filters on the row image; deletes always pass."""
    return feed.where((F.col(op) == "delete") | compile_filters(filters, dialect))


def after_position(feed: DataFrame, order: Sequence[str], position: Sequence | None) -> DataFrame:
    """Changes strictly after a position given as order column values."""
    if position is None:
        return feed
    later = F.lit(False)
    for column, value in reversed(list(zip(order, position))):
        bound = value_literal(value)
        later = (F.col(column) > bound) | ((F.col(column) == bound) & later)
    # the plain bound on the leading column reaches the file scan
    return feed.where((F.col(order[0]) >= value_literal(position[0])) & later)


def after_vector(feed: DataFrame, order: Sequence[str], partition: str | None, vector: Vector) -> DataFrame:
    """Changes past the position that their own log partition has reached.

    The vector has one entry per partition of the log, which is what is
    broadcast; changes of a partition it does not name are all new.
    """
    if not vector:
        return feed
    if partition is None:
        return feed.where(F.struct(*order) > F.struct(*[value_literal(v).alias(c) for c, v in zip(order, vector[""])]))
    kinds = ", ".join(f"_r_{c} {feed.schema[c].dataType.simpleString()}" for c in order)
    reached = feed.sparkSession.createDataFrame([(part, *place) for part, place in sorted(vector.items())], f"_part string, {kinds}")
    joined = feed.withColumn("_part", F.coalesce(F.col(partition).cast("string"), F.lit(""))).join(F.broadcast(reached), "_part", "left")
    later = F.struct(*order) > F.struct(*[F.col(f"_r_{c}").alias(c) for c in order])
    return joined.where(F.col(f"_r_{order[0]}").isNull() | later).select(*feed.columns)


def vector_ends(feed: DataFrame, order: Sequence[str], partition: str | None, lowest: bool = False) -> Vector:
    """The highest (or lowest) position of each log partition: one row per partition."""
    part = F.coalesce(F.col(partition).cast("string"), F.lit("")) if partition else F.lit("")
    edge = (F.min if lowest else F.max)(F.struct(*order))
    found = feed.groupBy(part.alias("part")).agg(edge.alias("edge")).collect()
    return {r["part"]: list(r["edge"]) for r in found if r["edge"] is not None}


def element_wise_max(left: Vector, right: Vector) -> Vector:
    """The further of two positions for each partition."""
    return {p: max(x for x in (left.get(p), right.get(p)) if x is not None) for p in {*left, *right}}


def dedupe_positions(
    feed: DataFrame, order: Sequence[str], watermark: Sequence | None = None
) -> DataFrame:
    """Changes after the watermark, each position once."""
    return after_position(feed, order, watermark).dropDuplicates(list(order))


def change_feed_read(
    feed: DataFrame,
    order: Sequence[str],
    start: Sequence | str | None = None,
) -> DataFrame:
    """An ordered log from a stored position, from its beginning, or from now.

    ``start`` is a position, ``None`` for the beginning, or ``"now"``.
    """
    if start != "now":
        return after_position(feed, order, start)
    return after_position(feed, order, log_end(feed, order))


def log_end(feed: DataFrame, order: Sequence[str]) -> tuple | None:
    """The highest position of a log: one row, from a map-side reduced max."""
    newest = feed.agg(F.max(F.struct(*order)).alias("p")).first()["p"]
    return tuple(newest) if newest is not None else None


def cdc_start(
    feed: DataFrame, order: Sequence[str], stored: Sequence | None
) -> tuple | None:
    """Where to start: at the stored position, else at the end of the log."""
    return tuple(stored) if stored is not None else log_end(feed, order)


def gap_detect(feed: DataFrame, order: Sequence[str], stored: Sequence) -> DataFrame:
    """One row that tells whether the log no longer reaches back to ``stored``.

    A lost gap means a restart from now; ``restart`` carries that position.
    """
    kept = F.struct(*order)
    wanted = F.struct(*[value_literal(v).alias(c) for c, v in zip(order, stored)])
    edges = feed.agg(F.min(kept).alias("oldest"), F.max(kept).alias("newest"))
    lost = F.coalesce(F.col("oldest") > wanted, F.lit(False))
    restart = F.when(lost, F.col("newest")).otherwise(wanted)
    return edges.select(
        lost.alias("history_lost"),
        *[F.col(f"oldest.{c}").alias(f"oldest_{c}") for c in order],
        *[restart[c].alias(f"restart_{c}") for c in order],
    )


def as_feed(changes: DataFrame, engine: str) -> tuple[DataFrame, list[str]]:
    """Normalized changes as a flat feed, and the columns that give its order.

    The row image becomes plain columns and the text position sortable ones. A
    position that cannot be read never counts as new, so its change is dropped.
    """
    columns = position_order(engine, F.col("position"))
    feed = changes.select(
        "op",
        "position",
        *[column.alias(name) for name, column in columns.items()],
        F.col("ordinal").alias("order_ordinal"),
        "row.*",
    )
    order = [*columns, "order_ordinal"]
    return feed.where(F.col(order[0]).isNotNull()), order
