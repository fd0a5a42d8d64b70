"""Catalog, lineage and key check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.operators import catalog, lineage
from rowferry.plans.ledgers import BRIDGE_STATUS_SQL
from rowferry.plans.registry import query

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_WIDTHS = dict(zip(_TABLES, (2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4)))


@query(
    "list_tables",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST({_WIDTHS[n]} AS BIGINT) AS column_count, count(*) AS row_count FROM {n}"
        for n in _TABLES
    ),
)
def _(t):
    return catalog.list_relations({name: getattr(t, name) for name in _TABLES})


@query(
    "list_databases",
    "SELECT schema_name AS database_name, count(*) AS relations FROM @catalog_tables GROUP BY schema_name",
)
def _(t):
    return t.catalog_tables.groupBy(F.col("schema_name").alias("database_name")).agg(
        F.count("*").alias("relations")
    )


@query(
    "describe_columns",
    """SELECT c.schema_name, c.table_name, c.column_name, c.ordinal, c.data_type,
              c.nullable AND NOT coalesce(k.p, false) AS nullable, coalesce(k.p, false) AS is_primary_key,
              coalesce(k.u, false) AS is_unique, f.r AS references_table
       FROM @catalog_columns c
       LEFT JOIN (SELECT schema_name, table_name, column_name, bool_or(is_primary) AS p, bool_or(is_unique) AS u
                  FROM @catalog_keys GROUP BY ALL) k
         ON (k.schema_name, k.table_name, k.column_name) = (c.schema_name, c.table_name, c.column_name)
       LEFT JOIN (SELECT schema_name, table_name, column_name, arg_min(referenced_table, fk_name) AS r
                  FROM @catalog_fks GROUP BY ALL) f
         ON (f.schema_name, f.table_name, f.column_name) = (c.schema_name, c.table_name, c.column_name)""",
)
def _(t):
    return catalog.describe_columns(t.catalog_columns, t.catalog_keys, t.catalog_fks)


@query(
    "describe_keys",
    """SELECT schema_name, table_name, key_name, key_kind, string_agg(column_name, ',' ORDER BY position) AS columns,
              count(*) AS column_count FROM @catalog_keys GROUP BY schema_name, table_name, key_name, key_kind""",
)
def _(t):
    return catalog.describe_keys(t.catalog_keys)


@query(
    "search_catalog",
    "SELECT schema_name, table_name, kind FROM @catalog_tables WHERE contains(lower(table_name), 'ab_1')",
)
def _(t):
    return catalog.search_catalog(t.catalog_tables, "AB_1").select("schema_name", "table_name", "kind")


@query(
    "fk_edges",
    """SELECT f.fk_name, f.schema_name || '.' || f.table_name AS source,
              CASE WHEN e.table_name IS NOT NULL THEN coalesce(f.referenced_schema, f.schema_name) ELSE n.first_schema END
                || '.' || f.referenced_table AS target, f.columns AS label
       FROM @catalog_fks f
       LEFT JOIN @catalog_tables e ON e.schema_name = coalesce(f.referenced_schema, f.schema_name)
                                  AND e.table_name = f.referenced_table
       JOIN (SELECT table_name, min(schema_name) AS first_schema FROM @catalog_tables GROUP BY table_name) n
         ON n.table_name = f.referenced_table""",
)
def _(t):
    return lineage.fk_edges(t.catalog_tables, t.catalog_fks)


@query(
    "orphan_check",
    """SELECT 'lineitem.l_partkey -> customer' AS edge, l_partkey AS key, count(*) AS row_count FROM lineitem
       WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY l_partkey
       UNION ALL
       SELECT 'orders.o_custkey -> customer', o_custkey, count(*) FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
       UNION ALL
       SELECT 'labels.doc_id -> documents', doc_id, count(*) FROM labels
       WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id""",
)
def _(t):
    """Three edges; the first points part keys at customers, so it has orphans."""
    def check(child, parent, key, parent_key, edge):
        return lineage.orphan_check(child, parent, key, parent_key, edge)

    return (
        check(t.lineitem, t.customer, "l_partkey", "c_custkey", "lineitem.l_partkey -> customer")
        .unionByName(check(t.orders, t.customer, "o_custkey", "c_custkey", "orders.o_custkey -> customer"))
        .unionByName(check(t.labels, t.documents, "doc_id", "doc_id", "labels.doc_id -> documents"))
    )


_LABEL = "CASE WHEN schema_name IS NULL THEN table_name ELSE schema_name || '.' || table_name END"
_NODES = f"""
    SELECT DISTINCT b.bridge_id, CASE WHEN http_host IS NOT NULL THEN 'http:' || http_host
           ELSE 'db:' || connection || ':' || {_LABEL} END AS node
    FROM @bridge_rows b LEFT JOIN @bridge_targets g ON g.bridge_id = b.bridge_id
    WHERE http_host IS NOT NULL OR g.bridge_id IS NOT NULL"""


@query(
    "bridge_lineage",
    f"""SELECT e.bridge_id, source, target, status FROM (
          SELECT bridge_id, 'conn:' || source_connection AS source, 'bridge:' || bridge_id AS target FROM @bridge_rows
          UNION ALL SELECT bridge_id, 'bridge:' || bridge_id, node FROM ({_NODES})) e
        JOIN ({BRIDGE_STATUS_SQL}) s ON s.bridge_id = e.bridge_id""",
)
def _(t):
    return lineage.bridge_lineage(t.bridges, t.runs)


@query(
    "destination_labels",
    f"""SELECT b.bridge_id, CASE WHEN http_host IS NOT NULL THEN 'POST ' || http_host
               ELSE coalesce({_LABEL}, 'database') || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END END AS label
        FROM @bridge_rows b LEFT JOIN @bridge_targets g ON g.bridge_id = b.bridge_id AND g.at = 0
        LEFT JOIN (SELECT bridge_id, count(*) AS n FROM @bridge_targets GROUP BY bridge_id) c ON c.bridge_id = b.bridge_id""",
)
def _(t):
    return lineage.destination_labels(t.bridges)


@query("destination_nodes", _NODES)
def _(t):
    return lineage.destination_nodes(t.bridges)


@query(
    "connection_usage",
    """SELECT connection, count(DISTINCT bridge_id) AS bridges FROM
         (SELECT bridge_id, source_connection AS connection FROM @bridge_rows
          UNION ALL SELECT bridge_id, connection FROM @bridge_targets) GROUP BY connection""",
)
def _(t):
    return lineage.connection_usage(t.bridges)


@query(
    "bridge_problems",
    """SELECT bridge_id, 'no target' AS problem FROM @bridge_rows b WHERE http_host IS NULL
          AND bridge_id NOT IN (SELECT bridge_id FROM @bridge_targets)
       UNION ALL SELECT DISTINCT bridge_id, 'upsert without keys' FROM @bridge_targets
          WHERE write_mode = 'upsert' AND key_count = 0
       UNION ALL SELECT DISTINCT bridge_id, 'no table' FROM @bridge_targets WHERE trim(table_name) = ''
       UNION ALL SELECT bridge_id, 'no columns' FROM @bridge_rows WHERE column_count = 0
       UNION ALL SELECT bridge_id, 'watch without column' FROM @bridge_rows
          WHERE trigger_kind = 'watch' AND watch_strategy <> 'snapshot' AND watch_column IS NULL
       UNION ALL SELECT bridge_id, 'key selection without a one-column key' FROM @bridge_rows
          WHERE selected_keys IS NOT NULL AND (source_key_count <> 1 OR selected_keys = 0)""",
)
def _(t):
    return lineage.bridge_problems(t.bridges)
