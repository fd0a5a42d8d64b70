"""Bridges as a graph: edges, labels, usage and configuration faults.

``bridges`` has bridge_id, name, source_connection, source_table,
trigger_kind, watch_strategy, watch_column, enabled, selected_keys, http_method,
http_url and targets, an array of (connection, schema, table, write_mode,
key_columns, mapping).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.operators.ledger import bridge_status
from rowferry.operators.skew import group_for_join, keys_for_join


def _table_label(target: Column) -> Column:
    return F.when(
        target["schema"].isNotNull(), F.concat(target["schema"], F.lit("."), target["table"])
    ).otherwise(target["table"])


def _host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def destination_labels(bridges: DataFrame) -> DataFrame:
    """A short label for the destination of each bridge."""
    first = F.get("targets", F.lit(0))
    count = F.coalesce(F.size("targets"), F.lit(0))
    database = F.concat(
        F.coalesce(_table_label(first), F.lit("database")),
        F.when(count > 1, F.concat(F.lit(" +"), (count - 1).cast("string"))).otherwise(""),
    )
    http = F.concat(F.col("http_method"), F.lit(" "), _host(F.col("http_url")))
    return bridges.select(
        "bridge_id", F.when(F.col("http_url").isNotNull(), http).otherwise(database).alias("label")
    )


def destination_nodes(bridges: DataFrame) -> DataFrame:
    """One row per bridge and destination node."""
    nodes = F.when(
        F.col("http_url").isNotNull(),
        F.array(F.concat(F.lit("http:"), _host(F.col("http_url")))),
    ).otherwise(
        F.transform(
            "targets",
            lambda t: F.concat(F.lit("db:"), t["connection"], F.lit(":"), _table_label(t)),
        )
    )
    return bridges.select("bridge_id", F.explode(nodes).alias("node")).distinct()


def bridge_lineage(bridges: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges source to bridge and bridge to destination with the bridge status."""
    bridge_node = F.concat(F.lit("bridge:"), F.col("bridge_id").cast("string"))
    sources = bridges.select(
        "bridge_id",
        F.concat(F.lit("conn:"), F.col("source_connection")).alias("source"),
        bridge_node.alias("target"),
    )
    destinations = destination_nodes(bridges).select(
        "bridge_id", bridge_node.alias("source"), F.col("node").alias("target")
    )
    return sources.unionByName(destinations).join(bridge_status(bridges, runs), "bridge_id")


def connection_usage(bridges: DataFrame) -> DataFrame:
    """Number of bridges that use each connection as source or target.

    A connection that a third of all bridges use is counted map-side first.
    """
    used = bridges.select(
        "bridge_id",
        F.explode(
            F.array_distinct(
                F.array_append(
                    F.coalesce(
                        F.transform("targets", lambda t: t["connection"]),
                        F.array().cast("array<string>"),
                    ),
                    F.col("source_connection"),
                )
            )
        ).alias("connection"),
    )
    return used.groupBy("connection").agg(F.count("*").alias("bridges"))


def bridge_problems(bridges: DataFrame) -> DataFrame:
    """One row per configuration fault."""
    database = F.col("http_url").isNull()
    has_targets = F.coalesce(F.size("targets"), F.lit(0)) > 0
    needs_keys = F.exists(
        "targets", lambda t: (t["write_mode"] == "upsert") & (F.size(t["key_columns"]) == 0)
    )
    no_table = F.exists("targets", lambda t: F.trim(t["table"]) == "")
    watch_blind = (
        (F.col("trigger_kind") == "watch")
        & (F.col("watch_strategy") != "snapshot")
        & (F.coalesce(F.col("watch_column"), F.lit("")) == "")
    )
    faults = F.array_compact(
        F.array(
            F.when(database & ~has_targets, "no target"),
            F.when(~database & (F.trim("http_url") == ""), "no url"),
            F.when(database & needs_keys, "upsert without keys"),
            F.when(database & no_table, "no table"),
            F.when(F.size("columns") == 0, "no columns"),
            F.when(watch_blind, "watch without column"),
            F.when(
                F.col("selected_keys").isNotNull()
                & ((F.size("source_key") != 1) | (F.col("selected_keys") == 0)),
                "key selection without a one-column key",
            ),
        )
    )
    return bridges.select("bridge_id", F.explode(faults).alias("problem"))


def fk_edges(tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Foreign keys as edges between known tables.

    A reference without a schema means the child's schema. An unknown table
    falls back to the first table of that name; unresolved ones are dropped.
    Both lookup sides are unique per key, so AQE can split a child side in
    which most references name one table.
    """
    known = tables.select(
        F.col("schema_name").alias("_schema"), F.col("table_name").alias("_table"),
        F.lit(True).alias("_exact"),
    )
    by_name = group_for_join(
        tables, {"_name": F.col("table_name")}, F.min("schema_name").alias("_first_schema")
    )
    wanted = F.coalesce("referenced_schema", "schema_name")
    resolved = (
        foreign_keys.withColumn("_wanted", wanted)
        .join(
            known,
            (F.col("_wanted") == F.col("_schema")) & (F.col("referenced_table") == F.col("_table")),
            "left",
        )
        .join(by_name, F.col("referenced_table") == F.col("_name"), "left")
        .withColumn(
            "target_schema", F.when(F.col("_exact"), F.col("_wanted")).otherwise(F.col("_first_schema"))
        )
        .where(F.col("target_schema").isNotNull())
    )
    return resolved.select(
        "fk_name",
        F.concat_ws(".", "schema_name", "table_name").alias("source"),
        F.concat_ws(".", "target_schema", "referenced_table").alias("target"),
        F.col("columns").alias("label"),
    )


def orphan_check(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, edge: str
) -> DataFrame:
    """Foreign key values without a parent, with the number of child rows.

    The child is reduced to distinct values before the join, so a hot value
    costs one row.
    """
    values = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count("*").alias("row_count"))
    )
    parents = parent.select(F.col(parent_key).alias("key"))
    return values.join(parents, "key", "left_anti").select(
        F.lit(edge).alias("edge"), F.col("key").cast("bigint").alias("key"), "row_count"
    )


def select_rows_by_key(df: DataFrame, keys: DataFrame, primary_key: str) -> DataFrame:
    """Rows whose single primary key is in the list."""
    return df.join(keys_for_join(keys, [primary_key]), primary_key, "left_semi")
