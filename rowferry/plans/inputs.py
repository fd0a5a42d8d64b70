"""Inputs that the registered queries derive from the given tables.

Each is written twice, as a Spark plan and as SQL, and grows with the tables:
a change log (one event per line item), a ledger (one run per order, one
delivery per order line), a key-value export, a catalog and bridges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Type names as engines print them.
TYPE_NAMES = (
    "varchar(255)",
    "bigint",
    "integer",
    "timestamp with time zone",
    "jsonb",
    "boolean",
    "uuid",
    "numeric(10,2)",
    "interval",
    "longtext",
    "longblob",
    "bigserial",
    "objectId",
    "bytea",
    "time",
    "time without time zone",
    "decimal(38,10)",
    "date",
    "ARRAY",
    "tinyint(1)",
    "int unsigned",
    "bit",
    "uuid[]",
    "character varying",
    "double precision",
)

# order_state: the target that the change log applies to


def _order_state(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("changed_at"),
        F.col("o_custkey").alias("ref_key"),
    )


_ORDER_STATE = """
SELECT o_orderkey AS order_key, o_totalprice AS price, o_orderstatus AS state,
       o_orderdate AS changed_at, o_custkey AS ref_key
FROM orders"""

# change_log: every line item is one change of its order; the end of the log
# came twice, as after a reconnect


def _change_log(t) -> DataFrame:
    once = t.lineitem.select(
        F.when(F.col("l_returnflag") == "N", "insert")
        .when(F.col("l_returnflag") == "A", "update")
        .otherwise("delete")
        .alias("op"),
        F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1992-01-01")))
        .cast("bigint")
        .alias("pos_file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos_offset"),
        (F.col("l_partkey") * 1000003 + F.col("l_suppkey")).alias("pos_ordinal"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linestatus").alias("state"),
        F.col("l_shipdate").alias("changed_at"),
        F.col("l_partkey").alias("ref_key"),
    )
    log = once.unionByName(once.where(F.col("changed_at") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    return log.withColumn("position", _position_text())


def _position_text():
    return F.concat(
        F.lit("binlog."),
        F.lpad(F.col("pos_file").cast("string"), 6, "0"),
        F.lit(":"),
        F.col("pos_offset").cast("string"),
        F.lit(":"),
        F.col("pos_ordinal").cast("string"),
    )


ORDER = ["pos_file", "pos_offset", "pos_ordinal"]

_CHANGE_ONCE = """
SELECT CASE l_returnflag WHEN 'N' THEN 'insert' WHEN 'A' THEN 'update' ELSE 'delete' END AS op,
       CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos_file,
       l_orderkey * 8 + l_linenumber AS pos_offset,
       l_partkey * 1000003 + l_suppkey AS pos_ordinal,
       l_orderkey AS order_key, l_extendedprice AS price, l_linestatus AS state,
       l_shipdate AS changed_at, l_partkey AS ref_key,
       'binlog.' || lpad(CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR), 6, '0')
         || ':' || CAST(l_orderkey * 8 + l_linenumber AS VARCHAR)
         || ':' || CAST(l_partkey * 1000003 + l_suppkey AS VARCHAR) AS position
FROM lineitem"""
_CHANGE_LOG = """
SELECT * FROM @change_once
UNION ALL
SELECT * FROM @change_once WHERE changed_at >= TIMESTAMP '2001-01-01'"""
_LAST_CHANGE = """
SELECT * FROM @change_log
QUALIFY row_number() OVER (PARTITION BY order_key
                           ORDER BY pos_file DESC, pos_offset DESC, pos_ordinal DESC) = 1"""

_LAST_FINAL_CHANGE = """
SELECT * FROM @change_log WHERE state = 'F' OR op = 'delete'
QUALIFY row_number() OVER (PARTITION BY order_key
                           ORDER BY pos_file DESC, pos_offset DESC, pos_ordinal DESC) = 1"""
_MOVED_LOG = """
SELECT *, CASE WHEN op = 'update' THEN ref_key ELSE order_key END AS old_key FROM @change_log"""

# sparse_orders: orders with NULLs


def _sparse_orders(t) -> DataFrame:
    return t.orders.withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    ).withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))


_SPARSE_ORDERS = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority
FROM orders"""

# event_docs: events as schemaless documents whose fields depend on the type


def _event_docs(t) -> DataFrame:
    user = F.col("user_id").cast("string")
    extra = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit(', "basket": ['), user, F.lit(", 7]")))
        .when(F.col("event_type") == "click", F.lit(', "at": null'))
        .when(F.col("event_type") == "signup", F.concat(F.lit(', "who": {"id": '), user, F.lit("}")))
        .when(F.col("event_type") == "view", F.lit(', "seen": true'))
        .otherwise("")
    )
    doc = F.concat(
        F.lit('{"_id": '),
        F.col("event_id").cast("string"),
        F.lit(', "kind": "'),
        F.col("event_type"),
        F.lit('"'),
        extra,
        F.lit(", "),
        F.substring("props", F.lit(2), F.length("props")),
    )
    return t.events.select("event_id", doc.alias("doc"))


_EVENT_DOCS = """
SELECT event_id,
       '{"_id": ' || event_id || ', "kind": "' || event_type || '"' ||
       CASE event_type
         WHEN 'purchase' THEN ', "basket": [' || user_id || ', 7]'
         WHEN 'click' THEN ', "at": null'
         WHEN 'signup' THEN ', "who": {"id": ' || user_id || '}'
         WHEN 'view' THEN ', "seen": true'
         ELSE '' END || ', ' || substr(props, 2) AS doc
FROM events"""

# keyspace: one hash per customer, sets and sorted sets of 64 neighbours, lists
# of 40 events, one string per part


def _keyspace(t) -> DataFrame:
    def text_list(columns):
        return F.concat(F.lit("["), F.array_join(columns, ","), F.lit("]"))

    users = t.customer.select(
        F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"),
        F.lit("hash").alias("type"),
        F.lit(-1).cast("bigint").alias("ttl"),
        F.concat(
            F.lit('{"name":"'), F.col("c_name"), F.lit('","nation":"'),
            F.col("c_nationkey").cast("string"), F.lit('"}'),
        ).alias("value"),
    )
    block = F.expr("c_custkey div 64").cast("string")
    segments = (
        t.customer.groupBy("c_mktsegment", block.alias("block"))
        .agg(F.array_sort(F.collect_list("c_custkey")).alias("m"))
        .select(
            F.concat(F.lit("seg:"), F.col("c_mktsegment"), F.lit(":"), F.col("block")).alias("key"),
            F.lit("set").alias("type"),
            F.lit(3600).cast("bigint").alias("ttl"),
            text_list(F.transform("m", lambda k: k.cast("string"))).alias("value"),
        )
    )
    score = F.round(F.col("c_acctbal") * 100).cast("bigint")
    ranks = (
        t.customer.groupBy(block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(score.alias("s"), F.col("c_custkey").alias("k")))).alias("m"))
        .select(
            F.concat(F.lit("rank:"), F.col("block")).alias("key"),
            F.lit("zset").alias("type"),
            F.lit(-1).cast("bigint").alias("ttl"),
            text_list(
                F.transform(
                    "m",
                    lambda p: F.concat(
                        F.lit('"'), p["k"].cast("string"), F.lit('","'), p["s"].cast("string"), F.lit('"')
                    ),
                )
            ).alias("value"),
        )
    )
    logs = (
        t.events.groupBy(F.expr("event_id div 40").alias("block"))
        .agg(
            F.array_sort(F.collect_list("event_id")).alias("m"),
            F.max("user_id").alias("u"),
        )
        .select(
            F.concat(F.lit("log:"), F.col("block").cast("string")).alias("key"),
            F.lit("list").alias("type"),
            F.col("u").alias("ttl"),
            text_list(F.transform("m", lambda k: k.cast("string"))).alias("value"),
        )
    )
    parts = t.part.select(
        F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"),
        F.lit("string").alias("type"),
        (F.col("p_size") - 1).cast("bigint").alias("ttl"),
        F.col("p_name").alias("value"),
    )
    return users.unionByName(segments).unionByName(ranks).unionByName(logs).unionByName(parts)


_KEYSPACE = """
SELECT 'user:' || c_custkey AS key, 'hash' AS type, CAST(-1 AS BIGINT) AS ttl,
       '{"name":"' || c_name || '","nation":"' || c_nationkey || '"}' AS value
FROM customer
UNION ALL
SELECT 'seg:' || c_mktsegment || ':' || (c_custkey // 64), 'set', CAST(3600 AS BIGINT),
       '[' || string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) || ']'
FROM customer GROUP BY c_mktsegment, c_custkey // 64
UNION ALL
SELECT 'rank:' || (c_custkey // 64), 'zset', CAST(-1 AS BIGINT),
       '[' || string_agg('"' || c_custkey || '","' || CAST(round(c_acctbal * 100) AS BIGINT) || '"', ','
                         ORDER BY CAST(round(c_acctbal * 100) AS BIGINT), c_custkey) || ']'
FROM customer GROUP BY c_custkey // 64
UNION ALL
SELECT 'log:' || (event_id // 40), 'list', max(user_id),
       '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || ']'
FROM events GROUP BY event_id // 40
UNION ALL
SELECT 'p:' || p_partkey, 'string', CAST(p_size - 1 AS BIGINT), p_name FROM part"""

# id_docs: documents keyed by 24 hexadecimal digits (parts), others by short text


def _id_docs(t) -> DataFrame:
    return t.part.select(
        F.when(
            F.col("p_size") > 10,
            F.concat(F.lit("ABCDEF00"), F.lpad(F.hex("p_partkey"), 16, "0")),
        )
        .otherwise(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
        .alias("_id"),
        "p_partkey",
        "p_name",
        "p_retailprice",
    )


_ID_DOCS = """
SELECT CASE WHEN p_size > 10 THEN 'ABCDEF00' || lpad(upper(hex(p_partkey)), 16, '0')
            ELSE 'part-' || p_partkey END AS _id,
       p_partkey, p_name, p_retailprice
FROM part"""

# runs and deliveries: one run per order, one delivery per order line number


def _runs(t) -> DataFrame:
    total = (F.floor(F.col("o_totalprice") / 1000) + 100).cast("bigint")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("bridge_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
        .alias("status"),
        F.floor(F.col("o_totalprice") / 4000).cast("bigint").alias("cursor_offset"),
        F.lit(100).cast("bigint").alias("batch_size"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", total).alias("total_count"),
        F.col("o_orderdate").alias("started_at"),
    )


_RUNS = """
SELECT o_orderkey AS run_id, o_custkey AS bridge_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CAST(floor(o_totalprice / 4000) AS BIGINT) AS cursor_offset,
       CAST(100 AS BIGINT) AS batch_size,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
            THEN CAST(floor(o_totalprice / 1000) AS BIGINT) + 100 END AS total_count,
       o_orderdate AS started_at
FROM orders"""


def _deliveries(t) -> DataFrame:
    flags = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"),
        F.min("l_linestatus").alias("line"),
        F.max("l_quantity").cast("int").alias("qty"),
    )
    status = F.when(F.col("flag") == "N", "success").when(F.col("flag") == "A", "skipped").otherwise("failed")
    return flags.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("sequence"),
        ((F.col("l_linenumber") - 1) * 100).cast("bigint").alias("row_index"),
        F.lit(100).cast("bigint").alias("row_count"),
        status.alias("status"),
        F.when(status == "success", 200)
        .when(status == "failed", F.when(F.col("line") == "F", F.lit(503)).when(F.col("qty") > 40, F.lit(None)).otherwise(F.lit(400)))
        .alias("http_status"),
        F.expr("1 + qty div 20").cast("int").alias("attempts"),
    )


_DELIVERIES = """
SELECT run_id, sequence, sequence * 100 AS row_index, CAST(100 AS BIGINT) AS row_count, status,
       CASE status WHEN 'success' THEN 200
                   WHEN 'failed' THEN CASE WHEN line = 'F' THEN 503 WHEN qty > 40 THEN NULL ELSE 400 END
       END AS http_status,
       1 + qty // 20 AS attempts
FROM (SELECT l_orderkey AS run_id, CAST(l_linenumber - 1 AS BIGINT) AS sequence,
             CASE min(l_returnflag) WHEN 'N' THEN 'success' WHEN 'A' THEN 'skipped' ELSE 'failed' END AS status,
             min(l_linestatus) AS line, CAST(max(l_quantity) AS INTEGER) AS qty
      FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_PLANNED = """
SELECT run_id, sequence, sequence * batch_size AS row_index,
       least(batch_size, total_count - sequence * batch_size) AS row_count
FROM (SELECT run_id, batch_size, total_count,
             unnest(generate_series(0, CAST(ceil(total_count / batch_size) AS BIGINT) - 1)) AS sequence
      FROM @runs WHERE total_count > 0)"""
_SETTLED = "SELECT run_id, sequence FROM @deliveries WHERE status IN ('success', 'skipped')"

_RESENT = """
SELECT l.* FROM @change_log l
JOIN @deliveries d ON d.run_id = l.order_key AND d.sequence = l.pos_offset - l.order_key * 8 - 1
JOIN @runs r ON r.run_id = l.order_key
WHERE d.status = 'failed' AND r.status <> 'running'"""

# catalog: one relation per supplier, columns and references from line items


def _catalog_tables(t) -> DataFrame:
    return t.supplier.select(
        F.concat(
            F.lit("ns_"), F.col("s_nationkey").cast("string"), F.lit("_"),
            (F.col("s_suppkey") % 2).cast("string"),
        ).alias("schema_name"),
        F.concat(F.lit("Tab_"), F.expr("s_suppkey div 2").cast("string")).alias("table_name"),
        F.when(F.col("s_acctbal") < 1000, "view").otherwise("table").alias("kind"),
        F.col("s_suppkey").alias("table_id"),
    )


_CATALOG_TABLES = """
SELECT 'ns_' || s_nationkey || '_' || (s_suppkey % 2) AS schema_name,
       'Tab_' || (s_suppkey // 2) AS table_name,
       CASE WHEN s_acctbal < 1000 THEN 'view' ELSE 'table' END AS kind, s_suppkey AS table_id
FROM supplier"""


def _catalog_columns(t) -> DataFrame:
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    kind = F.element_at(names, ((F.col("p_size") - 1) % len(TYPE_NAMES) + 1).cast("int"))
    return (
        pairs.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(_catalog_tables(t), F.col("l_suppkey") == F.col("table_id"))
        .select(
            "schema_name",
            "table_name",
            F.concat(F.lit("c_"), F.col("l_partkey").cast("string")).alias("column_name"),
            F.col("l_partkey").alias("ordinal"),
            kind.alias("data_type"),
            (F.col("p_size") % 3 != 0).alias("nullable"),
            (F.col("p_brand") == "Brand#1").alias("is_key"),
        )
    )


_CATALOG_COLUMNS = f"""
SELECT schema_name, table_name, 'c_' || l_partkey AS column_name, l_partkey AS ordinal,
       list_extract([{', '.join(f"'{n}'" for n in TYPE_NAMES)}],
                    (p_size - 1) % {len(TYPE_NAMES)} + 1) AS data_type,
       p_size % 3 <> 0 AS nullable, p_brand = 'Brand#1' AS is_key
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) p
JOIN part ON l_partkey = p_partkey
JOIN @catalog_tables ON l_suppkey = table_id"""


def _catalog_keys(t) -> DataFrame:
    """Key columns: the primary key of each table and one index per flag."""
    lines = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    return lines.join(_catalog_tables(t), F.col("l_suppkey") == F.col("table_id")).select(
        "schema_name",
        "table_name",
        F.concat(F.lit("key_"), F.col("l_returnflag"), F.lit("_"), F.expr("l_partkey div 8").cast("string")).alias("key_name"),
        F.when(F.col("l_returnflag") == "N", "primary")
        .when(F.col("l_returnflag") == "A", "unique")
        .otherwise("index")
        .alias("key_kind"),
        F.col("l_partkey").alias("position"),
        F.concat(F.lit("c_"), F.col("l_partkey").cast("string")).alias("column_name"),
        (F.col("l_returnflag") == "N").alias("is_primary"),
        (F.col("l_returnflag") != "R").alias("is_unique"),
    )


_CATALOG_KEYS = """
SELECT schema_name, table_name, 'key_' || l_returnflag || '_' || (l_partkey // 8) AS key_name,
       CASE l_returnflag WHEN 'N' THEN 'primary' WHEN 'A' THEN 'unique' ELSE 'index' END AS key_kind,
       l_partkey AS position, 'c_' || l_partkey AS column_name,
       l_returnflag = 'N' AS is_primary, l_returnflag <> 'R' AS is_unique
FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)
JOIN @catalog_tables ON l_suppkey = table_id"""


def _catalog_fks(t) -> DataFrame:
    name = F.concat_ws("_", F.lit("fk"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    schema = F.when(F.col("l_returnflag") == "A", F.col("schema_name")).when(
        F.col("l_returnflag") == "R", F.lit("ns_gone")
    )
    return t.lineitem.join(_catalog_tables(t), F.col("l_suppkey") == F.col("table_id")).select(
        name.alias("fk_name"),
        "schema_name",
        "table_name",
        F.concat(F.lit("c_"), F.col("l_partkey").cast("string")).alias("column_name"),
        F.concat(F.lit("c_"), F.col("l_partkey").cast("string")).alias("columns"),
        schema.alias("referenced_schema"),
        F.concat(F.lit("Tab_"), F.expr("l_orderkey div 100").cast("string")).alias("referenced_table"),
    )


_CATALOG_FKS = """
SELECT concat_ws('_', 'fk', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fk_name,
       schema_name, table_name, 'c_' || l_partkey AS column_name, 'c_' || l_partkey AS columns,
       CASE l_returnflag WHEN 'A' THEN schema_name WHEN 'R' THEN 'ns_gone' END AS referenced_schema,
       'Tab_' || (l_orderkey // 100) AS referenced_table
FROM lineitem JOIN @catalog_tables ON l_suppkey = table_id"""

# column_defs: column definitions with good and bad names, types and defaults


def _column_defs(t) -> DataFrame:
    kind = F.col("p_type")
    return t.part.select(
        F.concat(F.lit("t_"), F.expr("p_partkey div 5").cast("string")).alias("table_name"),
        F.col("p_partkey").alias("ordinal"),
        F.when(F.col("p_size") == 50, F.col("p_name"))
        .when(F.col("p_size") == 49, F.concat(F.lit("9_"), kind))
        .otherwise(F.concat(F.lit("c_"), F.col("p_partkey").cast("string")))
        .alias("name"),
        F.when(F.col("p_size") == 48, "text; drop").when(kind == "LARGE", "VARCHAR(20)").when(
            kind == "SMALL", "INTEGER"
        ).otherwise("TEXT").alias("type"),
        (F.col("p_size") > 25).alias("nullable"),
        (F.col("p_size") < 5).alias("primary_key"),
        (F.col("p_size") == 1).alias("auto_increment"),
        (F.col("p_size") < 10).alias("is_unique"),
        F.when(F.col("p_size") == 47, F.concat(F.lit("'"), F.col("p_name"), F.lit("'; x")))
        .when(F.col("p_size") > 40, F.concat(F.lit("'"), F.col("p_name"), F.lit("''s'")))
        .when(F.col("p_size") > 30, F.lit("CURRENT_TIMESTAMP"))
        .when(F.col("p_size") > 20, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5")))
        .alias("default_value"),
    )


_COLUMN_DEFS = """
SELECT 't_' || (p_partkey // 5) AS table_name, p_partkey AS ordinal,
       CASE WHEN p_size = 50 THEN p_name WHEN p_size = 49 THEN '9_' || p_type
            ELSE 'c_' || p_partkey END AS name,
       CASE WHEN p_size = 48 THEN 'text; drop' WHEN p_type = 'LARGE' THEN 'VARCHAR(20)'
            WHEN p_type = 'SMALL' THEN 'INTEGER' ELSE 'TEXT' END AS type,
       p_size > 25 AS nullable, p_size < 5 AS primary_key, p_size = 1 AS auto_increment,
       p_size < 10 AS is_unique,
       CASE WHEN p_size = 47 THEN '''' || p_name || '''; x'
            WHEN p_size > 40 THEN '''' || p_name || '''''s'''
            WHEN p_size > 30 THEN 'CURRENT_TIMESTAMP'
            WHEN p_size > 20 THEN '-' || p_size || '.5' END AS default_value
FROM part"""

# bridges: one per customer; kinds and faults depend on segment and balance

_TARGET_TYPE = (
    "array<struct<connection:string,schema:string,table:string,write_mode:string,"
    "key_columns:array<string>,mapping:array<struct<source:string,target:string>>>>"
)


def _bridges(t) -> DataFrame:
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    table = F.lower(segment)
    mapping = F.array(F.struct(F.lit("c_name").alias("source"), F.lit("name").alias("target")))

    def target(connection, schema, name, mode, keys):
        return F.struct(
            connection.alias("connection"),
            schema.alias("schema"),
            name.alias("table"),
            mode.alias("write_mode"),
            keys.alias("key_columns"),
            mapping.alias("mapping"),
        )

    conn = F.concat(F.lit("conn_"), (nation + 1).cast("string"))
    keys = F.when(segment == "FURNITURE", F.array().cast("array<string>")).otherwise(F.array(F.lit("id")))
    mode = F.when(F.col("c_acctbal") < 2000, "insert").otherwise("upsert")
    first = target(conn, F.lit("public"), F.when(F.col("c_acctbal") > 9900, " ").otherwise(table), mode, keys)
    second = target(F.lit("archive"), F.lit(None).cast("string"), table, F.lit("insert"), keys)
    targets = (
        F.when(segment == "BUILDING", F.array().cast(_TARGET_TYPE))
        .when(segment == "AUTOMOBILE", F.array(first, second))
        .otherwise(F.array(first))
    )
    trigger = (
        F.when(segment == "MACHINERY", "watch").when(segment == "HOUSEHOLD", "cdc").otherwise("replay")
    )
    return t.customer.select(
        F.col("c_custkey").alias("bridge_id"),
        F.concat(F.lit("sync "), F.col("c_name")).alias("name"),
        F.concat(F.lit("conn_"), nation.cast("string")).alias("source_connection"),
        table.alias("source_table"),
        trigger.alias("trigger_kind"),
        F.when(segment == "MACHINERY", F.when(F.col("c_acctbal") > 5000, "snapshot").otherwise("timestamp")).alias("watch_strategy"),
        F.when(F.col("c_acctbal") > 1000, "updated_at").alias("watch_column"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.when(nation < 3, (nation * 2).cast("bigint")).alias("selected_keys"),
        F.when(nation == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("id"))).alias("source_key"),
        F.when(nation == 24, F.array().cast("array<string>")).otherwise(F.array(F.lit("c_name"))).alias("columns"),
        F.when(segment == "BUILDING", "POST").alias("http_method"),
        F.when((segment == "BUILDING") & (F.col("c_acctbal") > 0), F.concat(F.lit("https://hooks"), nation.cast("string"), F.lit(".example.com/in"))).alias("http_url"),
        targets.alias("targets"),
    )


_BRIDGE_TARGETS = """
SELECT c_custkey AS bridge_id, 0 AS at, 'conn_' || (c_nationkey + 1) AS connection, 'public' AS schema_name,
       CASE WHEN c_acctbal > 9900 THEN ' ' ELSE lower(c_mktsegment) END AS table_name,
       CASE WHEN c_acctbal < 2000 THEN 'insert' ELSE 'upsert' END AS write_mode,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END AS key_count
FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL
SELECT c_custkey, 1, 'archive', NULL, lower(c_mktsegment), 'insert', 1
FROM customer WHERE c_mktsegment = 'AUTOMOBILE'"""
_BRIDGE_ROWS = """
SELECT c_custkey AS bridge_id, 'conn_' || c_nationkey AS source_connection,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'watch' WHEN 'HOUSEHOLD' THEN 'cdc' ELSE 'replay' END AS trigger_kind,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_acctbal > 5000 THEN 'snapshot' ELSE 'timestamp' END
       END AS watch_strategy,
       CASE WHEN c_acctbal > 1000 THEN 'updated_at' END AS watch_column,
       c_acctbal >= 0 AS enabled,
       CASE WHEN c_nationkey < 3 THEN CAST(c_nationkey * 2 AS BIGINT) END AS selected_keys,
       CASE WHEN c_nationkey = 1 THEN 2 ELSE 1 END AS source_key_count,
       CASE WHEN c_nationkey = 24 THEN 0 ELSE 1 END AS column_count,
       CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0
            THEN 'hooks' || c_nationkey || '.example.com' END AS http_host
FROM customer"""

DERIVED = {
    "order_state": _order_state,
    "change_log": _change_log,
    "sparse_orders": _sparse_orders,
    "event_docs": _event_docs,
    "keyspace": _keyspace,
    "id_docs": _id_docs,
    "runs": _runs,
    "deliveries": _deliveries,
    "catalog_tables": _catalog_tables,
    "catalog_columns": _catalog_columns,
    "catalog_keys": _catalog_keys,
    "catalog_fks": _catalog_fks,
    "column_defs": _column_defs,
    "bridges": _bridges,
}

DERIVED_SQL = {
    "order_state": _ORDER_STATE,
    "change_once": _CHANGE_ONCE,
    "change_log": _CHANGE_LOG,
    "last_change": _LAST_CHANGE,
    "last_final_change": _LAST_FINAL_CHANGE,
    "moved_log": _MOVED_LOG,
    "sparse_orders": _SPARSE_ORDERS,
    "event_docs": _EVENT_DOCS,
    "keyspace": _KEYSPACE,
    "id_docs": _ID_DOCS,
    "runs": _RUNS,
    "deliveries": _DELIVERIES,
    "planned": _PLANNED,
    "settled": _SETTLED,
    "resent": _RESENT,
    "catalog_tables": _CATALOG_TABLES,
    "catalog_columns": _CATALOG_COLUMNS,
    "catalog_keys": _CATALOG_KEYS,
    "catalog_fks": _CATALOG_FKS,
    "column_defs": _COLUMN_DEFS,
    "bridge_targets": _BRIDGE_TARGETS,
    "bridge_rows": _BRIDGE_ROWS,
}
