"""Inserts, updates, upserts, deletes and change application.

Every operator is a function of DataFrames that returns the new target. The
target side is only streamed through anti or left joins whose other side is
the delta's keys, so a delta under the broadcast threshold (measured by AQE at
run time) leaves the target unshuffled, and a large one shuffles it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.operators.skew import group_for_join, keys_for_join

_CHANGED = "_changed"
_PRESENT = "_present"


def _need_keys(keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ValueError("key columns are needed to match rows")
    return list(keys)


def _equal_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & (left[key] == right[key])
    return condition


def split_null_keys(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be matched by key, and the rejects with a NULL in it."""
    complete = F.lit(True)
    for key in _need_keys(keys):
        complete = complete & F.col(key).isNotNull()
    return rows.where(complete), rows.where(~complete)


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``.

    ``row_number = 1`` lets Spark keep one row per key on the map side before
    the shuffle, so a hot key sends one row per map task.
    """
    newest = Window.partitionBy(*_need_keys(keys)).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def touched_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys, reduced on the map side."""
    return rows.select(*keys).distinct()


def without_keys(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` whose key does not occur in ``rows``.

    The keys need not be unique in ``target``: a hot one can be split.
    """
    return target.join(keys_for_join(rows, keys), list(keys), "left_anti")


def insert_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; target columns that they lack become NULL."""
    if not rows.columns:
        raise ValueError("cannot insert rows without values")
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"the target has no column {unknown}")
    return target.unionByName(rows, allowMissingColumns=True)


def update_rows(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set the given columns where the key matches; ``changes`` has one row per key."""
    keys = _need_keys(keys)
    given = [c for c in changes.columns if c not in keys]
    if not given:
        raise ValueError("no changes given")
    patch = changes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_v_{c}") for c in given],
        F.lit(True).alias(_CHANGED),
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_k_{key}"))
    joined = target.join(patch, condition, "left")
    return joined.select(
        *[
            F.when(F.col(_CHANGED), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c)
            if c in given
            else F.col(c)
            for c in target.columns
        ]
    )


def delete_rows(target: DataFrame, identities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the rows whose key is listed; keys are always needed."""
    return without_keys(target, identities, _need_keys(keys))


def upsert_rows(
    target: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    partial: bool = False,
    on_insert_only: Sequence[str] = (),
) -> DataFrame:
    """Insert rows, or overwrite the matching ones.

    With ``order`` the last row of a key wins; without it ``rows`` must hold
    one row per key. ``partial`` keeps the target's value of every column that
    ``rows`` lacks. ``on_insert_only`` columns are never overwritten. Rows that
    carry only key columns leave a matching row as it is.
    """
    keys = _need_keys(keys)
    if not rows.columns:
        raise ValueError("cannot upsert rows without values")
    unknown = [c for c in rows.columns if c not in target.columns and c not in order]
    if unknown:
        raise ValueError(f"the target has no column {unknown}")
    delta = last_per_key(rows, keys, order) if order else rows
    delta = delta.select(*[c for c in rows.columns if c in target.columns])
    given = [c for c in delta.columns if c not in keys and c not in on_insert_only]
    if not given:
        existing = target.select(*keys).join(touched_keys(rows, keys), keys, "left_semi")
        return insert_rows(target, without_keys(delta, existing, keys))
    missing = [c for c in target.columns if c not in delta.columns]
    if not on_insert_only and not (partial and missing):
        kept = target.join(touched_keys(rows, keys), keys, "left_anti")
        return insert_rows(kept, delta)
    return _patched(target, delta, keys, given, [c for c in on_insert_only if c in delta.columns])


def _patched(
    target: DataFrame, delta: DataFrame, keys: Sequence[str], given: Sequence[str], inserted: Sequence[str]
) -> DataFrame:
    """Target rows with the values that the delta gives them, and the delta's other rows as new ones.

    One full join, so the target is read once and the delta once. Each key is
    there once in the delta, so no key makes more rows than it has. The join is
    on the keys by which ``last_per_key`` has placed the delta.
    """
    patch = delta.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_v_{c}") for c in (*given, *inserted)],
        F.lit(True).alias(_CHANGED),
    )
    matched = F.lit(True)
    for key in keys:
        matched = matched & (F.col(key) == F.col(f"_k_{key}"))
    joined = target.withColumn(_PRESENT, F.lit(True)).join(patch, matched, "full_outer")

    def value(column: str):
        if column in keys:
            return F.coalesce(F.col(column), F.col(f"_k_{column}"))
        if column in given:
            return F.when(F.col(_CHANGED), F.col(f"_v_{column}")).otherwise(F.col(column))
        if column in inserted:
            return F.when(F.col(_PRESENT), F.col(column)).otherwise(F.col(f"_v_{column}"))
        return F.col(column)

    return joined.select(*[value(c).alias(c) for c in target.columns])


def upsert_keyspace(keyspace: DataFrame, rows: DataFrame) -> DataFrame:
    """Set key and value, both as text; a set always clears type and expiry.

    A ``ttl`` column in ``rows`` sets the expiry when positive.
    """
    ttl = F.when(F.col("ttl") > 0, F.col("ttl")).otherwise(-1) if "ttl" in rows.columns else F.lit(-1)
    written = rows.where(F.col("key").cast("string") != "").select(
        F.col("key").cast("string").alias("key"),
        F.lit("string").alias("type"),
        ttl.cast("bigint").alias("ttl"),
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"),
    )
    return upsert_rows(keyspace, written, ["key"])


def apply_last_changes(
    target: DataFrame, last: DataFrame, keys: Sequence[str], op: str = "op"
) -> DataFrame:
    """Apply a stable table that holds one change per key."""
    kept = target.join(last.select(*_need_keys(keys)), list(keys), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*target.columns))


def apply_changes(
    target: DataFrame,
    feed: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    old_keys: Sequence[str] = (),
) -> DataFrame:
    """Apply a change feed in log order: delete by key, else upsert.

    Only the last change of a key matters. ``old_keys`` names columns with the
    key before the change; when it differs, the old row goes as well.
    """
    keys = _need_keys(keys)
    columns = target.columns
    last = last_per_key(feed.select(*dict.fromkeys([op, *order, *columns, *old_keys])), keys, order)
    gone = touched_keys(feed, keys)
    if old_keys:
        moved = feed.where(F.col(op) != "delete").select(
            *[F.col(o).alias(k) for o, k in zip(old_keys, keys)]
        )
        gone = gone.unionByName(moved.dropna()).distinct()
        last = _drop_moved_away(last, feed, keys, order, op, old_keys)
    kept = target.join(gone, keys, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*columns))


def _drop_moved_away(last, feed, keys, order, op, old_keys):
    """Keep a key's last change unless a later change moved the row elsewhere."""
    same = F.lit(True)
    for old, key in zip(old_keys, keys):
        same = same & (F.col(old) == F.col(key))
    departures = (
        feed.where((F.col(op) != "delete") & ~same)
        .groupBy(*[F.col(o).alias(k) for o, k in zip(old_keys, keys)])
        .agg(F.max(F.struct(*order)).alias("_left_at"))
    )
    joined = last.join(departures, keys, "left")
    stays = F.col("_left_at").isNull() | (F.struct(*order) > F.col("_left_at"))
    return joined.where(stays).drop("_left_at")


def apply_changes_append(
    target: DataFrame,
    feed: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op: str = "op",
) -> DataFrame:
    """Insert mode: every other change appends, a delete removes what came before it.

    The last delete of each key comes from a map-side reduced aggregate, and
    joins the feed as its unique side, so AQE can split a hot key of the feed.
    """
    keys = _need_keys(keys)
    columns = target.columns
    position = F.struct(*order)
    deletes = group_for_join(
        feed.where(F.col(op) == "delete"),
        {key: F.col(key) for key in keys},
        F.max(position).alias("_deleted_at"),
    )
    appended = (
        feed.where(F.col(op) != "delete")
        .select(*dict.fromkeys([*columns, *order]))
        .join(deletes, keys, "left")
        .where(F.col("_deleted_at").isNull() | (position > F.col("_deleted_at")))
        .select(*columns)
    )
    return without_keys(target, deletes, keys).unionByName(appended)
