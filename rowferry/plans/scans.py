"""Scans, document and key-value sources, counts and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import Filter, Sort
from rowferry.operators import counts, paging
from rowferry.operators.changes import change_feed_read
from rowferry.operators.row_index import row_index_sequence
from rowferry.plans.inputs import ORDER
from rowferry.plans.registry import query
from rowferry.sources.documents import document_fields, matching_documents, scan_documents, search_documents
from rowferry.sources.keyspace import keyspace_stats, scan_keyspace
from rowferry.sources.relational import key_cuts, key_ranges, range_predicates, scan_query, scan_table


@query(
    "scan_table",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice >= 100000""",
)
def _(t):
    return scan_table(
        t.orders,
        [Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "gte", 100000.0)],
        [Sort("o_orderdate")],
        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
        keys=["o_orderkey"],
    )


@query(
    "scan_query",
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
       JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000""",
)
def _(t):
    t.customer.createOrReplaceTempView("rf_customer")
    t.orders.createOrReplaceTempView("rf_orders")
    return scan_query(
        t.spark,
        """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM rf_customer
           JOIN rf_orders ON c_custkey = o_custkey WHERE o_totalprice > :floor""",
        {"floor": 250000.0},
    )


@query(
    "scan_query_capped",
    """SELECT o_orderkey, o_totalprice, true AS truncated FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""",
)
def _(t):
    t.orders.createOrReplaceTempView("rf_orders")
    return scan_query(
        t.spark,
        "SELECT o_orderkey, o_totalprice FROM rf_orders ORDER BY o_totalprice DESC, o_orderkey",
        max_rows=500,
    )


@query(
    "scan_jdbc_partitioned",
    """SELECT CAST((o_orderkey - lo) // ((hi - lo + 16) // 16) AS INTEGER) AS part,
              count(*) AS row_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
       FROM orders, (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) GROUP BY 1""",
)
def _(t):
    """The key ranges of a parallel read, each row counted in its range."""
    low, high = t.orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    part = F.lit(None).cast("int")
    for number, predicate in enumerate(key_ranges("o_orderkey", low, high, 16)):
        part = F.when(F.expr(predicate), number).otherwise(part)
    return (
        t.orders.withColumn("part", part)
        .groupBy("part")
        .agg(
            F.count("*").alias("row_count"),
            F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
        )
    )


@query(
    "key_ranges",
    """SELECT 'c_name' AS key_name, count(*) AS row_count, CAST(16 AS BIGINT) AS parts, true AS balanced FROM customer
       UNION ALL SELECT 'ts', count(*), 16, true FROM events
       UNION ALL SELECT 'o_totalprice', count(*), 16, true FROM orders""",
)
def _(t):
    """Ranges of a text, a timestamp and a price: none holds more than twice the mean."""

    def shares(table, key):
        part = F.lit(None).cast("int")
        for number, predicate in enumerate(range_predicates(key, key_cuts(table, key, 16), "`")):
            part = F.when(F.expr(predicate), number).otherwise(part)
        sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        total = F.sum("n").cast("bigint")
        return sizes.agg(
            total.alias("row_count"), F.count("*").alias("parts"), (F.max("n") * F.count("*") <= total * 2).alias("balanced")
        ).select(F.lit(key).alias("key_name"), "row_count", "parts", "balanced")

    return shares(t.customer, "c_name").unionByName(shares(t.events, "ts")).unionByName(shares(t.orders, "o_totalprice"))


@query(
    "scan_documents",
    """SELECT CAST(json_extract(doc, '$._id') AS BIGINT) AS _id, doc ->> '$.kind' AS kind,
              CAST(json_extract(doc, '$.k') AS BIGINT) AS k,
              CAST(json_extract(doc, '$.basket[0]') AS BIGINT) AS basket_first,
              CAST(json_extract(doc, '$.who.id') AS BIGINT) AS who_id,
              CAST(json_extract(doc, '$.seen') AS BOOLEAN) AS seen
       FROM @event_docs""",
)
def _(t):
    return scan_documents(t.event_docs, "doc").select(
        "_id",
        "kind",
        "k",
        F.get("basket", F.lit(0)).alias("basket_first"),
        F.col("who.id").alias("who_id"),
        "seen",
    )


@query(
    "document_fields",
    """SELECT field, documents, true AS nullable,
              CASE jt WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean'
                      WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS data_type
       FROM (SELECT field, count(*) AS documents, arg_min(json_type(doc, '$.' || field), event_id) AS jt
             FROM (SELECT event_id, doc, unnest(json_keys(doc)) AS field FROM @event_docs)
             GROUP BY field)""",
)
def _(t):
    return document_fields(t.event_docs, "doc", ["event_id"])


@query(
    "find_documents",
    """SELECT CAST(json_extract(doc, '$._id') AS BIGINT) AS _id, doc ->> '$.kind' AS kind,
              CAST(json_extract(doc, '$.k') AS BIGINT) AS k
       FROM @event_docs WHERE CAST(json_extract(doc, '$.k') AS BIGINT) >= 50
          AND doc ->> '$.kind' ILIKE '%IC%'
       ORDER BY k DESC, _id LIMIT 100""",
)
def _(t):
    return search_documents(
        t.event_docs,
        "doc",
        {"_id": "bigint", "kind": "string", "k": "bigint"},
        [Filter("k", "gte", 50), Filter("kind", "contains", "IC")],
        [Sort("k", "desc"), Sort("_id")],
    )


@query(
    "scan_documents_odd_names",
    """SELECT event_id, CAST(event_id AS BIGINT) AS void_name, event_type AS object_name, CAST(event_id % 3 AS BIGINT) AS nested,
              CASE WHEN event_id % 2 = 0 THEN 'even' END AS dotted
       FROM events""",
)
def _(t):
    """Fields whose names look like types, or hold dots, quotes and colons."""
    doc = F.concat(
        F.lit('{"a: VOID": '), F.col("event_id").cast("string"),
        F.lit(', "OBJECT<x": "'), F.col("event_type"),
        F.lit('", "in": {"b: VOID, c": '), (F.col("event_id") % 3).cast("string"),
        F.lit("}"),
        F.when(F.col("event_id") % 2 == 0, F.lit(', "d.e`f": "even"')).otherwise(""),
        F.lit("}"),
    )
    found = scan_documents(t.events.select("event_id", doc.alias("doc")), "doc", ["event_id"])
    return found.select(
        "event_id",
        F.col("`a: VOID`").alias("void_name"),
        F.col("`OBJECT<x`").alias("object_name"),
        F.col("in")["b: VOID, c"].alias("nested"),
        F.col("`d.e``f`").alias("dotted"),
    )


@query(
    "scan_keyspace",
    """SELECT key, type, ttl,
              CASE WHEN type = 'list' THEN CAST(to_json(list_slice(TRY_CAST(value AS JSON[]), 1, 25)) AS VARCHAR)
                   WHEN type = 'zset' THEN CAST(to_json(list_slice(TRY_CAST(value AS JSON[]), 1, 50)) AS VARCHAR)
                   ELSE value END AS value
       FROM @keyspace WHERE regexp_matches(key, '^.*:.1.*$')""",
)
def _(t):
    return scan_keyspace(t.keyspace, ":?1")


@query("keyspace_stats", """SELECT type, count(*) AS keys, count(*) FILTER (ttl > 0) AS expiring
                            FROM @keyspace GROUP BY type""")
def _(t):
    return keyspace_stats(t.keyspace)


@query(
    "change_feed_read",
    """SELECT op, position, order_key, price FROM @change_log
       WHERE (pos_file, pos_offset, pos_ordinal) > (2500, 40000, 0)""",
)
def _(t):
    return change_feed_read(t.change_log, ORDER, (2500, 40000, 0)).select(
        "op", "position", "order_key", "price"
    )


# counts


@query("count_exact", "SELECT count(*) AS total, false AS estimated FROM orders WHERE o_totalprice > 200000")
def _(t):
    return counts.count_rows(t.orders, [Filter("o_totalprice", "gt", 200000.0)])


@query("count_documents", """SELECT count(*) AS total, false AS estimated FROM @event_docs
                             WHERE CAST(json_extract(doc, '$.k') AS BIGINT) < 30""")
def _(t):
    return counts.count_rows(matching_documents(t.event_docs, "doc", [Filter("k", "lt", 30)]))


@query("count_estimated", "SELECT count(*) AS total, true AS estimated FROM lineitem")
def _(t):
    return counts.count_estimated(t.lineitem)


@query("cursor_max", "SELECT max(o_orderdate) AS cursor FROM orders")
def _(t):
    return counts.cursor_max(t.orders, "o_orderdate")


@query(
    "key_candidates",
    """SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS row_count, count(DISTINCT o_orderkey) AS distinct_keys,
              CAST(0 AS BIGINT) AS null_keys, true AS is_key FROM orders
       UNION ALL
       SELECT 'lineitem', CAST(sum(n) AS BIGINT), count(*), CAST(0 AS BIGINT), max(n) = 1
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL
       SELECT 'conversations', CAST(sum(n) AS BIGINT), count(*), CAST(0 AS BIGINT), max(n) = 1
       FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, turn)
       UNION ALL
       SELECT 'sparse_orders', CAST(sum(n) AS BIGINT), count(*),
              CAST(sum(CASE WHEN o_custkey IS NULL THEN n ELSE 0 END) AS BIGINT), false
       FROM (SELECT o_custkey, count(*) AS n FROM @sparse_orders GROUP BY o_custkey)""",
)
def _(t):
    def check(name, df, keys):
        return counts.key_candidates(df, keys).withColumn("table_name", F.lit(name))

    return (
        check("orders", t.orders, ["o_orderkey"])
        .unionByName(check("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"]))
        .unionByName(check("conversations", t.conversations, ["conv_id", "turn"]))
        .unionByName(check("sparse_orders", t.sparse_orders, ["o_custkey"]))
    )


@query(
    "table_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count FROM @sparse_orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def _(t):
    """The exact part of the statistics; distinct counts are sketches."""
    return counts.table_stats(t.sparse_orders).drop("approx_distinct")


# sorting and paging

_BY_STATUS = [Sort("o_orderstatus"), Sort("o_totalprice", "desc")]


@query(
    "sort_multi",
    """SELECT o_orderkey, row_number() OVER (
                ORDER BY o_orderpriority ASC NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS rank
       FROM @sparse_orders""",
)
def _(t):
    """The order made visible as a rank."""
    return row_index_sequence(
        t.sparse_orders.select("o_orderkey", "o_orderpriority", "o_totalprice"),
        [Sort("o_orderpriority"), Sort("o_totalprice", "desc")],
        ["o_orderkey"],
        index="rank",
    ).select("o_orderkey", "rank")


@query(
    "page_offset",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, true AS has_more FROM orders
       ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 400""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return paging.page_offset(rows, _BY_STATUS, ["o_orderkey"], 200, 400)


@query(
    "page_offset_long",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) > 10 + 6000 AS has_more FROM orders
       ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 6000 OFFSET 10""",
)
def _(t):
    """A page longer than a browser shows: the length asked for holds."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return paging.page_offset(rows, _BY_STATUS, ["o_orderkey"], 6000, 10)


@query(
    "page_keyset",
    """SELECT * FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 200""",
)
def _(t):
    return paging.page_keyset(t.orders, ["o_orderkey"], [700])


@query(
    "resolve_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
       WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (500, 3, 0, 0)
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""",
)
def _(t):
    """The next page of a table with a composite key, in its resolved order."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    order, _ = paging.resolve_order([], key)
    rows = t.lineitem.select(*key, "l_quantity")
    return paging.page_keyset(rows, [s.column for s in order], [500, 3, 0, 0], 1000)


@query(
    "row_index_sequence",
    """SELECT o_orderkey, i AS row_index, i // 200 AS sequence
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return row_index_sequence(rows, [Sort("o_orderdate")], ["o_orderkey"], 200).select(
        "o_orderkey", "row_index", "sequence"
    )


@query(
    "seek_resume",
    """SELECT o_orderkey, i AS row_index
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
       WHERE i >= 900""",
)
def _(t):
    numbered = row_index_sequence(t.orders.select("o_orderkey"), keys=["o_orderkey"])
    return paging.seek_resume(numbered, 900).select("o_orderkey", "row_index")
