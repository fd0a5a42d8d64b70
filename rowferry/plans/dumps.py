"""Dump, restore and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.operators import dump
from rowferry.plans.registry import query
from rowferry.session import scratch_path

_KEYSPACE_COLUMNS = ["key", "type", "ttl", "value"]


@query(
    "backup_json",
    """SELECT 'customer' AS table_name, c_custkey AS key, c_name AS name FROM customer
       UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation""",
)
def _(t):
    """Fields read back from the written lines of a two-table dump."""
    path = scratch_path(t.spark, "dump")
    dump.backup_json(
        {"customer": t.customer, "nation": t.nation},
        path,
        {"customer": ["c_custkey"], "nation": ["n_nationkey"]},
    )

    def lines(name, key, label):
        text = t.spark.read.text(f"{path}/rows/{name}")
        return text.select(
            F.lit(name).alias("table_name"),
            F.get_json_object("value", f"$.{key}").cast("bigint").alias("key"),
            F.get_json_object("value", f"$.{label}").alias("name"),
        )

    return lines("customer", "c_custkey", "c_name").unionByName(lines("nation", "n_nationkey", "n_name"))


@query(
    "backup_documents",
    """SELECT field, count(*) AS documents FROM
         (SELECT unnest(json_keys(doc)) AS field FROM @event_docs) GROUP BY field""",
)
def _(t):
    """The column union of a document dump."""
    return dump.backup_documents(t.event_docs, "doc", ["event_id"])[1].select("field", "documents")


@query(
    "backup_keyspace",
    """SELECT '{"key":"' || key || '","type":"' || type || '","ttl":' || ttl || ',"value":' ||
              CASE type WHEN 'string' THEN '"' || value || '"' ELSE value END || '}' AS line FROM @keyspace""",
)
def _(t):
    return dump.backup_keyspace(t.keyspace)


@query(
    "backup_sql",
    """SELECT 'INSERT INTO "orders" ("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate") VALUES (' ||
              o_orderkey || ', ' || coalesce('''' || o_orderpriority || '''', 'NULL') || ', ' ||
              coalesce(CAST(o_custkey AS VARCHAR), 'NULL') || ', ''' ||
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || ''');' AS line FROM @sparse_orders""",
)
def _(t):
    rows = t.sparse_orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate")
    return dump.backup_sql(rows, "orders", "postgres")


@query(
    "restore_json",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus AS raw FROM @sparse_orders""",
)
def _(t):
    """Dump and restore with bytes, NULLs, doubles and stamps."""
    path = scratch_path(t.spark, "restore")
    rows = t.sparse_orders.withColumn("raw", F.encode("o_orderstatus", "UTF-8")).drop("o_orderstatus")
    dump.backup_json({"orders": rows}, path, {"orders": ["o_orderkey"]})
    return dump.restore_json(t.spark, path)["orders"].withColumn("raw", F.decode("raw", "UTF-8"))


@query(
    "restore_documents",
    """SELECT _id, p_partkey, p_name FROM @id_docs
       UNION ALL SELECT 'supplier-' || s_suppkey, s_suppkey, s_name FROM supplier""",
)
def _(t):
    """Documents whose id exists are passed over, new ones are inserted."""
    collection = t.id_docs.select("_id", "p_partkey", "p_name")
    again = collection.withColumn("p_name", F.lit("changed"))
    fresh = t.supplier.select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("_id"),
        F.col("s_suppkey").alias("p_partkey"),
        F.col("s_name").alias("p_name"),
    )
    return dump.restore_documents(collection, again.unionByName(fresh))


@query(
    "restore_documents_equal_ids",
    """SELECT 'c' || o_custkey AS _id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""",
)
def _(t):
    """A dump with one document per order under the id of its customer: the first of each id stays."""
    lines = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("_id"), "o_orderkey", F.col("o_orderkey").alias("line"))
    return dump.restore_documents(lines.drop("line").limit(0), lines, order=["line"])


@query(
    "restore_keyspace",
    """SELECT key, type, CASE WHEN ttl > 0 THEN ttl ELSE -1 END AS ttl, value FROM @keyspace
       UNION ALL SELECT 'old:' || s_suppkey, 'string', CAST(5 AS BIGINT), s_name FROM supplier""",
)
def _(t):
    """The export restored over a store with one key to replace per customer."""
    stale = t.customer.select(
        F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"),
        F.lit("string").alias("type"),
        F.lit(5).cast("bigint").alias("ttl"),
        F.lit("stale").alias("value"),
    )
    others = t.supplier.select(
        F.concat(F.lit("old:"), F.col("s_suppkey").cast("string")).alias("key"),
        F.lit("string").alias("type"),
        F.lit(5).cast("bigint").alias("ttl"),
        F.col("s_name").alias("value"),
    )
    return dump.restore_keyspace(stale.unionByName(others), t.keyspace).select(*_KEYSPACE_COLUMNS)


@query(
    "export_csv",
    """SELECT doc_id || ',' || CASE WHEN regexp_matches(text, '[",\\n\\r]')
              THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang || ',' || n_chars AS line
       FROM documents""",
)
def _(t):
    return dump.export_csv(t.documents.select("doc_id", "text", "lang", "n_chars"))


@query(
    "export_json",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || coalesce(CAST(o_custkey AS VARCHAR), 'null') ||
              ',"o_orderpriority":' || coalesce('"' || o_orderpriority || '"', 'null') || '}' AS line FROM @sparse_orders""",
)
def _(t):
    return dump.export_json(t.sparse_orders.select("o_orderkey", "o_custkey", "o_orderpriority"))
