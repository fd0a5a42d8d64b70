"""One query per filter operator, and the filters of keys and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import Filter
from rowferry.functions.predicates import apply_filters, compile_filters, matches_glob
from rowferry.operators.changes import filter_change_ops
from rowferry.operators.lineage import select_rows_by_key
from rowferry.operators.merge import touched_keys
from rowferry.plans.registry import query

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_PARTS = ["p_partkey", "p_name", "p_type"]
_SELECT_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "
_SELECT_PARTS = "SELECT p_partkey, p_name, p_type FROM part WHERE "


def _orders(name, where, *filters):
    @query(name, _SELECT_ORDERS + where)
    def _(t):
        return t.orders.where(compile_filters(filters)).select(*_ORDERS)


def _parts(name, where, *filters, dialect="sql"):
    @query(name, _SELECT_PARTS + where)
    def _(t):
        return t.part.where(compile_filters(filters, dialect)).select(*_PARTS)


_orders("filter_eq", "o_orderstatus = 'O'", Filter("o_orderstatus", "eq", "O"))
_orders("filter_lt", "o_totalprice < 50000", Filter("o_totalprice", "lt", 50000.0))
_orders("filter_lte", "o_custkey <= 100", Filter("o_custkey", "lte", 100))
_orders("filter_gt", "o_totalprice > 400000", Filter("o_totalprice", "gt", 400000.0))
_orders("filter_gte", "o_custkey >= 100", Filter("o_custkey", "gte", 100))
_orders("filter_in", "o_orderstatus IN ('F', 'P')", Filter("o_orderstatus", "in", ["F", "P"]))
_orders("filter_in_empty", "false", Filter("o_orderstatus", "in", []))
_orders(
    "filter_and",
    "o_orderstatus <> 'P' AND o_totalprice >= 1000 AND o_totalprice < 300000 AND o_custkey > 50",
    Filter("o_orderstatus", "neq", "P"),
    Filter("o_totalprice", "gte", 1000.0),
    Filter("o_totalprice", "lt", 300000.0),
    Filter("o_custkey", "gt", 50),
)
_parts("filter_contains", "p_name ILIKE '%R_N%'", Filter("p_name", "contains", "R_N"))
_parts("filter_starts_with", "p_type ILIKE 'eco%'", Filter("p_type", "startsWith", "eco"))
_parts("filter_ends_with", "p_name ILIKE '%Bolt'", Filter("p_name", "endsWith", "Bolt"))
_parts(
    "filter_contains_document",
    "contains(lower(p_name), 'r_n')",
    Filter("p_name", "contains", "R_N"),
    dialect="document",
)
_parts(
    "filter_affixes_document",
    "starts_with(lower(p_name), 'hot') AND ends_with(lower(p_name), 'bolt')",
    Filter("p_name", "startsWith", "HOT"),
    Filter("p_name", "endsWith", "BOLT"),
    dialect="document",
)

_SPARSE = "SELECT o_orderkey, o_custkey, o_orderpriority FROM @sparse_orders WHERE "


def _sparse(name, where, *filters, dialect="sql"):
    @query(name, _SPARSE + where)
    def _(t):
        rows = t.sparse_orders.where(compile_filters(filters, dialect))
        return rows.select("o_orderkey", "o_custkey", "o_orderpriority")


_sparse("filter_neq", "o_orderpriority <> '1-URGENT'", Filter("o_orderpriority", "neq", "1-URGENT"))
_sparse(
    "filter_neq_document",
    "o_orderpriority IS DISTINCT FROM '1-URGENT'",
    Filter("o_orderpriority", "neq", "1-URGENT"),
    dialect="document",
)
_sparse("filter_is_null", "o_custkey IS NULL", Filter("o_custkey", "isNull"))
_sparse("filter_not_null", "o_orderpriority IS NOT NULL", Filter("o_orderpriority", "notNull"))


@query(
    "filter_key_glob",
    "SELECT key, type FROM @keyspace WHERE regexp_matches(key, '^user:.5.*$')",
)
def _(t):
    return t.keyspace.where(matches_glob(F.col("key"), "user:?5*")).select("key", "type")


@query(
    "select_rows_by_key",
    """SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""",
)
def _(t):
    """Rows picked by key, from a list as large as the lines with a high quantity."""
    picked = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return select_rows_by_key(t.orders, touched_keys(picked, ["o_orderkey"]), "o_orderkey").select(
        *t.orders.columns
    )


@query(
    "filter_change_ops",
    "SELECT op, position, order_key FROM @change_log WHERE op IN ('update', 'delete')",
)
def _(t):
    return filter_change_ops(t.change_log, ["update", "delete"]).select("op", "position", "order_key")


@query(
    "filter_change_ops_keyspace",
    "SELECT op, position, order_key FROM @change_log WHERE op IN ('insert', 'update')",
)
def _(t):
    """A key-value source that has insert enabled admits every write."""
    rows = filter_change_ops(t.change_log, ["insert"], "redis")
    return rows.select("op", "position", "order_key")


@query("filter_in_long", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 300000 AND o_totalprice > 1000")
def _(t):
    """A list of 100 000 keys is joined, not written out."""
    rows = apply_filters(t.orders, [Filter("o_orderkey", "in", list(range(0, 300_000, 3))), Filter("o_totalprice", "gt", 1000.0)])
    return rows.select("o_orderkey", "o_totalprice")
