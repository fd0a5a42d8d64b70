"""Key-value exports: rows of key, type, ttl and value (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.predicates import matches_glob

# Fixed value: members of a list or sorted set shown in a preview.
PREVIEW_MEMBERS = 25
VALUE_LIST = "array<string>"


def list_members(value: Column) -> Column:
    """Members of a list, set or sorted set as text."""
    return F.from_json(value, VALUE_LIST)


def _shorten(value: Column, keep: int) -> Column:
    members = F.from_json(value, "array<variant>")
    return F.when(F.size(members) > keep, F.to_json(F.slice(members, 1, keep))).otherwise(value)


def scan_keyspace(df: DataFrame, match: str | None = None, full: bool = False) -> DataFrame:
    """Keys that contain ``match`` (its wildcards stay active) with their values.

    Previews keep 25 members of a list and 25 member and score pairs of a
    sorted set; ``full`` keeps all, which dumps need.
    """
    rows = df.where(matches_glob(F.col("key"), f"*{match}*")) if match else df
    if full:
        return rows
    shown = (
        F.when(F.col("type") == "list", _shorten(F.col("value"), PREVIEW_MEMBERS))
        .when(F.col("type") == "zset", _shorten(F.col("value"), 2 * PREVIEW_MEMBERS))
        .otherwise(F.col("value"))
    )
    return rows.withColumn("value", shown)


def zset_pairs(flat: Column) -> Column:
    """``[member, score, member, score]`` as an array of pairs; a lone tail is dropped."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1),
        lambda i: F.struct(
            F.element_at(flat, i * 2 + 1).alias("member"),
            F.element_at(flat, i * 2 + 2).cast("double").alias("score"),
        ),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<member:string,score:double>>")
    return F.when(F.size(flat) > 1, pairs).otherwise(empty)


def keyspace_stats(df: DataFrame) -> DataFrame:
    """Keys per type and how many of them expire."""
    return df.groupBy("type").agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("ttl") > 0).alias("expiring"),
    )
