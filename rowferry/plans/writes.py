"""Inserts, updates, upserts, deletes, change application and DDL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import Bridge, ColumnMapping, Delivery, Filter, Target
from rowferry.operators import ddl, merge, runs
from rowferry.operators.commit import SnapshotTable, atomic_commit
from rowferry.operators.fanout import fan_out, write_target
from rowferry.operators.row_index import row_index_sequence
from rowferry.plans.inputs import ORDER
from rowferry.plans.registry import query
from rowferry.session import scratch_path


def _new_customers(t):
    """Suppliers that enter the customer table under keys after the last one."""
    return t.supplier.select(
        (F.col("s_suppkey") + 100000000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"),
    )


@query(
    "insert_rows",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
       UNION ALL SELECT s_suppkey + 100000000, s_name, NULL, s_acctbal, NULL FROM supplier""",
)
def _(t):
    return merge.insert_rows(t.customer, _new_customers(t))


def _balances(t):
    """A new balance for each customer with orders."""
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal")
    )


_BALANCES = "SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY o_custkey"


@query(
    "update_rows",
    f"""SELECT c.c_custkey, c_name, c_nationkey, coalesce(b.c_acctbal, c.c_acctbal) AS c_acctbal, c_mktsegment
        FROM customer c LEFT JOIN ({_BALANCES}) b ON b.c_custkey = c.c_custkey""",
)
def _(t):
    return merge.update_rows(t.customer, _balances(t), ["c_custkey"])


@query(
    "delete_rows",
    "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.delete_rows(t.customer, gone, ["c_custkey"]).select(*t.customer.columns)


def _order_deltas(t):
    """Several versions of a customer row, one per order; the newest order wins."""
    return t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.lit(7).alias("c_nationkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderstatus").alias("c_mktsegment"),
        "o_orderdate",
        "o_orderkey",
    )


_NEWEST_ORDER = """
    SELECT * FROM orders QUALIFY row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


@query(
    "upsert_rows",
    f"""SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL
        SELECT o_custkey, 'order ' || o_orderkey, 7, o_totalprice, o_orderstatus FROM ({_NEWEST_ORDER})""",
)
def _(t):
    return merge.upsert_rows(
        t.customer, _order_deltas(t), ["c_custkey"], ["o_orderdate", "o_orderkey"]
    ).select(*t.customer.columns)


@query(
    "upsert_partial",
    f"""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, c_nationkey,
               coalesce(o_totalprice, c_acctbal) AS c_acctbal, c_mktsegment
        FROM customer FULL JOIN ({_NEWEST_ORDER}) ON c_custkey = o_custkey""",
)
def _(t):
    delta = _order_deltas(t).select("c_custkey", "c_acctbal", "o_orderdate", "o_orderkey")
    return merge.upsert_rows(
        t.customer, delta, ["c_custkey"], ["o_orderdate", "o_orderkey"], partial=True
    )


@query(
    "upsert_keys_only",
    """SELECT c_custkey, c_name FROM customer
       UNION ALL SELECT DISTINCT l_orderkey, CAST(NULL AS VARCHAR) FROM lineitem
       WHERE l_orderkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    keys = t.lineitem.select(F.col("l_orderkey").alias("c_custkey")).distinct()
    return merge.upsert_rows(t.customer.select("c_custkey", "c_name"), keys, ["c_custkey"])


@query(
    "upsert_set_on_insert",
    """SELECT coalesce(p.p_partkey, l.l_partkey) AS p_partkey,
              CASE WHEN p.p_partkey IS NULL THEN 'new-' || l.l_partkey ELSE p._id END AS _id,
              coalesce(l.price, p.p_retailprice) AS p_retailprice
       FROM @id_docs p FULL JOIN
         (SELECT l_orderkey AS l_partkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey) l
         ON p.p_partkey = l.l_partkey""",
)
def _(t):
    """Rows keyed by another column set ``_id`` on insert only."""
    delta = t.lineitem.groupBy(F.col("l_orderkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("p_retailprice")
    )
    delta = delta.withColumn("_id", F.concat(F.lit("new-"), F.col("p_partkey").cast("string")))
    target = t.id_docs.select("p_partkey", "_id", "p_retailprice")
    return merge.upsert_rows(target, delta, ["p_partkey"], on_insert_only=["_id"])


@query(
    "upsert_keyspace",
    """SELECT key, type, ttl, value FROM @keyspace WHERE key NOT IN (SELECT 'user:' || s_suppkey FROM supplier)
       UNION ALL
       SELECT 'user:' || s_suppkey, 'string', CASE WHEN s_nationkey > 0 THEN CAST(s_nationkey AS BIGINT) ELSE -1 END, s_name
       FROM supplier""",
)
def _(t):
    rows = t.supplier.select(
        F.concat(F.lit("user:"), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_name").alias("value"),
        F.col("s_nationkey").alias("ttl"),
    )
    return merge.upsert_keyspace(t.keyspace, rows)


@query(
    "apply_changes",
    """SELECT * FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @change_log)
       UNION ALL
       SELECT order_key, price, state, changed_at, ref_key FROM @last_change WHERE op <> 'delete'""",
)
def _(t):
    return merge.apply_changes(t.order_state, t.change_log, ["order_key"], ORDER)


@query(
    "apply_changes_moved_keys",
    """SELECT * FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @moved_log)
          AND order_key NOT IN (SELECT old_key FROM @moved_log WHERE op <> 'delete')
       UNION ALL
       SELECT order_key, price, state, changed_at, ref_key FROM @last_change LEFT JOIN
         (SELECT old_key, max((pos_file, pos_offset, pos_ordinal)) AS left_at FROM @moved_log
          WHERE op <> 'delete' AND old_key <> order_key GROUP BY old_key) a ON a.old_key = order_key
       WHERE op <> 'delete' AND (left_at IS NULL OR (pos_file, pos_offset, pos_ordinal) > left_at)""",
)
def _(t):
    """Updates that moved the row from another key also remove the old row."""
    old = F.when(F.col("op") == "update", F.col("ref_key")).otherwise(F.col("order_key"))
    return merge.apply_changes(
        t.order_state, t.change_log.withColumn("old_key", old), ["order_key"], ORDER, old_keys=["old_key"]
    )


@query(
    "apply_changes_append",
    """SELECT * FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @change_log WHERE op = 'delete')
       UNION ALL
       SELECT l.order_key, price, state, changed_at, ref_key FROM @change_log l
       LEFT JOIN (SELECT order_key, max((pos_file, pos_offset, pos_ordinal)) AS gone FROM @change_log
                  WHERE op = 'delete' GROUP BY order_key) d ON d.order_key = l.order_key
       WHERE op <> 'delete' AND (gone IS NULL OR (pos_file, pos_offset, pos_ordinal) > gone)""",
)
def _(t):
    return merge.apply_changes_append(t.order_state, t.change_log, ["order_key"], ORDER)


_PEOPLE = Target(
    "people",
    "crm",
    key_columns=("id",),
    mapping=(ColumnMapping("c_custkey", "id"), ColumnMapping("c_name", "name")),
)
_COPIES = Target("copies", write_mode="insert")
_KEYLESS = Target("keyless")
_ABSENT = Target("absent", key_columns=("c_custkey",), create_missing=False)


@query(
    "fan_out",
    """SELECT target, status, error, CASE status WHEN 'failed' THEN 0 ELSE (SELECT count(*) FROM customer) END AS affected,
              'failed' AS outcome
       FROM (VALUES ('crm.people', 'success', NULL), ('copies', 'success', NULL),
                    ('keyless', 'failed', 'keyless replaces rows by key and names no key column'),
                    ('absent', 'failed', 'there is no absent, and the bridge may not make one'))
            v(target, status, error)""",
)
def _(t):
    """Outcome per target of one write to four targets, two of them faulty."""
    targets = [_PEOPLE, _COPIES, _KEYLESS, _ABSENT]
    return fan_out(t.customer, targets, {"keyless": t.customer})[1]


@query(
    "fan_out_rows",
    """SELECT 'crm.people' AS target, c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT 'copies', c_custkey, c_name FROM customer""",
)
def _(t):
    """The rows that two targets hold after one write."""
    written, _ = fan_out(t.customer, [_PEOPLE, _COPIES], {})
    people = written["crm.people"].select(F.lit("crm.people").alias("target"), "id", "name")
    copies = written["copies"].select(
        F.lit("copies").alias("target"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return people.unionByName(copies)


@query(
    "bridge_chain",
    """SELECT order_key AS id, price AS amount FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @change_log)
       UNION ALL SELECT order_key, price FROM @last_change WHERE op <> 'delete'""",
)
def _(t):
    """A to B by change log, then B to C by mapped upsert."""
    first = merge.apply_changes(t.order_state, t.change_log, ["order_key"], ORDER)
    second = Target(
        "totals",
        key_columns=("id",),
        mapping=(ColumnMapping("order_key", "id"), ColumnMapping("price", "amount")),
    )
    return write_target(first, second, None)


@query("atomic_commit", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    """Two batches and a repeat of the first, published as versions of one table."""
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    table = SnapshotTable(t.spark, scratch_path(t.spark, "commit"), rows.schema, ["c_custkey"], 8)

    def put(current, delta):
        return merge.upsert_rows(current, delta, ["c_custkey"])

    atomic_commit(table, rows.withColumn("c_name", F.lit("draft")), put, "batch-1")
    atomic_commit(table, rows, put, "batch-2")
    atomic_commit(table, rows.withColumn("c_name", F.lit("draft")), put, "batch-1")
    return table.read()


@query("ensure_target", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(t):
    """A missing target is created in the mapped shape and then filled."""
    return write_target(t.customer, _PEOPLE, None)


@query(
    "create_table",
    """SELECT table_name, CASE WHEN fault IS NULL THEN 'CREATE TABLE "' || table_name || '" (' || cols ||
              CASE WHEN pk IS NULL THEN '' ELSE ', PRIMARY KEY (' || pk || ')' END || ')' END AS statement, fault
       FROM (
         SELECT table_name, min(fault) AS fault, string_agg(txt, ', ' ORDER BY ordinal) AS cols,
                string_agg(CASE WHEN primary_key THEN '"' || name || '"' END, ', ' ORDER BY ordinal) AS pk
         FROM (
           SELECT *, CASE WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*') THEN 'name'
                          WHEN NOT regexp_full_match(type, '[A-Za-z0-9_ (),]+') THEN 'type'
                          WHEN default_value LIKE '%; x' THEN 'default' END AS fault,
                  '"' || name || '" ' || CASE WHEN auto_increment THEN 'SERIAL' ELSE type END ||
                  CASE WHEN nullable THEN '' ELSE ' NOT NULL' END ||
                  CASE WHEN is_unique AND NOT primary_key THEN ' UNIQUE' ELSE '' END ||
                  CASE WHEN default_value IS NULL THEN '' ELSE ' DEFAULT ' || default_value END AS txt
           FROM @column_defs)
         GROUP BY table_name)""",
)
def _(t):
    return ddl.create_table_statements(t.column_defs, "postgres")


@query(
    "check_constraints",
    """SELECT 'unique' AS rule, 'l_orderkey,l_linenumber' AS columns,
              '[' || l_orderkey || ',' || l_linenumber || ']' AS key_value, count(*) AS row_count
       FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
       UNION ALL
       SELECT 'not_null', 'l_shipdate', NULL, count(*) FROM lineitem WHERE l_shipdate IS NULL HAVING count(*) > 0""",
)
def _(t):
    return ddl.check_constraints(t.lineitem, ["l_shipdate"], [["l_orderkey", "l_linenumber"]])


@query(
    "apply_defaults",
    """SELECT s_suppkey AS id, CAST(42 AS INTEGER) AS n, 'it''s ok' AS label, true AS active, s_name AS note FROM supplier""",
)
def _(t):
    shape = ddl.create_table(
        t.spark,
        ddl.TableSpec(
            "safe_defaults",
            (
                ddl.ColumnSpec("id", "bigint", primary_key=True),
                ddl.ColumnSpec("n", "integer", default="42"),
                ddl.ColumnSpec("label", "text", default="'it''s ok'"),
                ddl.ColumnSpec("active", "boolean", default="TRUE"),
                ddl.ColumnSpec("note", "text", default="'unused'"),
            ),
        ),
    )
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("note"))
    return ddl.apply_defaults(rows, shape)


@query("truncate_table", "SELECT * FROM orders WHERE false")
def _(t):
    return ddl.truncate_table(t.orders)


@query(
    "drop_table",
    """SELECT schema_name, table_name, kind FROM @catalog_tables
       WHERE table_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')""",
)
def _(t):
    """Catalog after the relations named by some lines were dropped."""
    named = t.lineitem.where("l_quantity > 49 AND l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("table_id")
    )
    return ddl.drop_relations(t.catalog_tables, named).select("schema_name", "table_name", "kind")


@query(
    "create_drop_database",
    """SELECT DISTINCT schema_name AS database_name FROM @catalog_tables
       WHERE schema_name NOT IN (SELECT schema_name FROM @catalog_tables WHERE kind = 'view')
       UNION
       SELECT DISTINCT name FROM @column_defs WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*')""",
)
def _(t):
    """Databases after one was created per defined name and those with views were dropped."""
    database = F.col("schema_name").alias("database_name")
    present = t.catalog_tables.select(database).distinct()
    gone = t.catalog_tables.where("kind = 'view'").select(database)
    names = t.column_defs.select(F.col("name").alias("database_name"))
    return ddl.create_relations(ddl.drop_relations(present, gone), names, "database_name")


# bulk copy runs


def _copy(t, label):
    """A bridge from orders to a table of large orders, in deliveries of 250 rows."""
    bridge = Bridge(
        "large-orders",
        "orders",
        primary_key=("o_orderkey",),
        filters=(Filter("o_totalprice", "gte", 50000.0),),
        targets=(
            Target(
                "large",
                key_columns=("id",),
                mapping=(ColumnMapping("o_orderkey", "id"), ColumnMapping("o_totalprice", "amount")),
            ),
        ),
        delivery=Delivery(batch_size=250),
    )
    schema = T.StructType().add("id", T.LongType()).add("amount", T.DoubleType())
    path = scratch_path(t.spark, label)
    return bridge, {"large": SnapshotTable(t.spark, path, schema, ["id"], 8)}


@query("replay_run", "SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_totalprice >= 50000")
def _(t):
    """The target after a bulk copy and the same copy again."""
    bridge, tables = _copy(t, "replay-run")
    first = runs.run_replay(bridge, t.orders, tables, "run-1")
    runs.run_replay(bridge, t.orders, tables, "run-1", first.deliveries)
    return tables["large"].read()


_REPLAY_LEDGER = """
    SELECT 'run-1' AS run_id, i // 250 AS sequence, min(i) AS row_index, count(*) AS row_count,
           'success' AS status, CAST(1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_totalprice >= 50000)
    GROUP BY 2"""


@query("replay_ledger", _REPLAY_LEDGER)
def _(t):
    """The ledger of a bulk copy."""
    bridge, tables = _copy(t, "replay-ledger")
    return runs.run_replay(bridge, t.orders, tables, "run-1").deliveries


@query(
    "replay_resumed",
    """SELECT o_orderkey AS id, o_totalprice AS amount FROM
         (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_totalprice >= 50000)
       WHERE i >= 1000 OR i // 250 = 2""",
)
def _(t):
    """A resumed copy writes what the ledger does not settle: here all but
    deliveries 0, 1 and 3."""
    bridge, tables = _copy(t, "replay-resumed")
    settled = t.spark.createDataFrame(
        [("run-1", s, s * 250, 250, "success", 1, None) for s in (0, 1, 3)], runs.LEDGER_SCHEMA
    )
    runs.run_replay(bridge, t.orders, tables, "run-1", settled, attempt=2)
    return tables["large"].read()


def _tables(t, label, schema, keys, *names):
    return {name: SnapshotTable(t.spark, scratch_path(t.spark, f"{label}-{name}"), schema, keys, 8) for name in names}


def _two_journals(batch_size):
    """A bridge that appends orders to two tables."""
    mapping = (ColumnMapping("o_orderkey", "id"), ColumnMapping("o_totalprice", "amount"))
    return Bridge(
        "journals", "orders", primary_key=("o_orderkey",),
        targets=tuple(Target(name, write_mode="insert", mapping=mapping) for name in ("left", "right")),
        delivery=Delivery(batch_size=batch_size),
    )


_AMOUNTS = T.StructType().add("id", T.LongType()).add("amount", T.DoubleType())


def _both(tables):
    left, right = (table.read().select(F.lit(name).alias("target"), "id", "amount") for name, table in tables.items())
    return left.unionByName(right)


_TWICE = "SELECT target, o_orderkey AS id, o_totalprice AS amount FROM orders, (VALUES ('left'), ('right')) v(target)"


def _retried(t, label):
    """A copy whose second target is missing, and its retry when an order more has come."""
    bridge = _two_journals(7)
    tables = _tables(t, label, _AMOUNTS, ["id"], "left", "right")
    early = t.orders.join(t.orders.agg(F.max("o_orderkey").alias("newest")), F.col("o_orderkey") < F.col("newest"), "left_semi")
    failed = runs.run_replay(bridge, early, {"left": tables["left"]}, "run-1")
    return runs.run_replay(bridge, t.orders, tables, "run-1", failed.deliveries), tables


@query("replay_retry_insert", _TWICE)
def _(t):
    """Both tables after the retry: every order once, in the one that had its rows as well."""
    return _both(_retried(t, "retry")[1])


@query(
    "replay_retry_ledger",
    """SELECT 'run-1' AS run_id, i // 7 AS sequence, min(i) AS row_index, count(*) AS row_count, 'success' AS status,
              CAST(CASE WHEN i // 7 <= (SELECT count(*) - 2 FROM orders) // 7 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
              CAST(NULL AS VARCHAR) AS error
       FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY i // 7""",
)
def _(t):
    """The ledger after the retry."""
    return _retried(t, "retry-ledger")[0].deliveries


def _restarted(t, label):
    """A copy that began in the middle, then from the start without a ledger."""
    bridge = _two_journals(10)
    tables = _tables(t, label, _AMOUNTS, ["id"], "left", "right")
    runs.run_replay(bridge, t.orders, tables, "run-1", cursor_offset=500)
    return runs.run_replay(bridge, t.orders, tables, "run-1"), tables


@query("replay_resumed_from_start", _TWICE)
def _(t):
    """Both tables after a copy from offset 500 and the same copy from its start."""
    return _both(_restarted(t, "restart")[1])


@query("replay_spans", "SELECT target, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM orders, (VALUES ('left'), ('right')) v(target) GROUP BY target")
def _(t):
    """What each table knows to have of that run: one span of all rows."""
    tables = _restarted(t, "spans")[1]
    left, right = (table.delivered("run-1").select(F.lit(name).alias("target"), "first", "last") for name, table in tables.items())
    return left.unionByName(right)


# the highest price in the second half of the orders is no number
_ODD = """
    SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 AND i >= n // 2 THEN 'much' ELSE CAST(o_totalprice AS VARCHAR) END AS amount, i
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"""


def _odd_amounts(t, label, on_error):
    """A copy of which some amounts are no numbers."""
    numbered = row_index_sequence(t.orders, keys=["o_orderkey"])
    half = F.lit(t.orders.count() // 2)
    odd = (F.col("o_totalprice") > 400000) & (F.col("row_index") >= half)
    rows = numbered.select(
        F.col("o_orderkey").alias("id"), F.when(odd, "much").otherwise(F.col("o_totalprice").cast("string")).alias("amount")
    )
    bridge = Bridge(
        "odd", "orders", primary_key=("id",), targets=(Target("left", write_mode="insert"), Target("right", key_columns=("id",))),
        delivery=Delivery(batch_size=5, on_error=on_error),
    )
    tables = _tables(t, label, _AMOUNTS, ["id"], "left", "right")
    return runs.run_replay(bridge, rows, tables, "run-1"), tables


_ODD_SEQUENCES = f"SELECT i // 5 AS sequence, count(*) FILTER (amount = 'much') AS odd FROM ({_ODD}) GROUP BY 1"
_STOP = f"SELECT min(sequence) FROM ({_ODD_SEQUENCES}) WHERE odd > 0"


@query(
    "replay_abort",
    f"""SELECT target, id, CAST(amount AS DOUBLE) AS amount FROM ({_ODD}), (VALUES ('left'), ('right')) v(target)
        WHERE i // 5 < coalesce(({_STOP}), 1000000000000)""",
)
def _(t):
    """What two tables hold after a copy that stops at its first failed delivery."""
    return _both(_odd_amounts(t, "abort", "abort")[1])


_ODD_LEDGER = f"""
    SELECT 'run-1' AS run_id, sequence, sequence * 5 AS row_index,
           least(5, (SELECT count(*) FROM orders) - sequence * 5) AS row_count,
           CASE WHEN odd > 0 THEN 'failed' ELSE 'success' END AS status, CAST(1 AS INTEGER) AS attempts,
           CASE WHEN odd > 0 THEN 'left: amount is no double' END AS error
    FROM ({_ODD_SEQUENCES})"""


@query("replay_abort_ledger", f"{_ODD_LEDGER} WHERE sequence <= coalesce(({_STOP}), 1000000000000)")
def _(t):
    """The ledger of that copy ends with the failed delivery."""
    return _odd_amounts(t, "abort-ledger", "abort")[0].deliveries


@query(
    "replay_continue",
    f"""SELECT target, id, CAST(amount AS DOUBLE) AS amount FROM ({_ODD}), (VALUES ('left'), ('right')) v(target)
        WHERE i // 5 NOT IN (SELECT sequence FROM ({_ODD_SEQUENCES}) WHERE odd > 0)""",
)
def _(t):
    """The same copy when it goes on after a failure: only the failed deliveries are missing."""
    return _both(_odd_amounts(t, "continue", "continue")[1])


@query("replay_continue_ledger", _ODD_LEDGER)
def _(t):
    """A status for each delivery of that copy."""
    return _odd_amounts(t, "continue-ledger", "continue")[0].deliveries
