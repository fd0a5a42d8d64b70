"""Change-log queries: normalization, positions, replay and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import Bridge, ColumnMapping, Delivery, Filter, Target
from rowferry.functions.positions import binlog_order, lsn_order
from rowferry.operators import changes, merge
from rowferry.operators.commit import SnapshotTable
from rowferry.plans.inputs import ORDER
from rowferry.plans.registry import query
from rowferry.session import scratch_path
from rowferry.streaming.bridge import (
    apply_batch,
    apply_to_targets,
    change_log_stream,
    start_bridge,
)
from rowferry.streaming.pipeline import Entry, StreamLedger, prepare_start, start_pipeline

_IMAGE = ["order_key", "price", "state", "changed_at", "ref_key"]


def _pg_feed(t):
    """Log messages of two tables; deletes of lines with status O carry the key only."""
    image = F.struct(*_IMAGE)
    key_only = F.struct(
        "order_key",
        *[F.lit(None).cast(kind).alias(name) for name, kind in _IMAGE_TYPES.items() if name != "order_key"],
    )
    gone = F.col("op") == "delete"
    return t.change_log.select(
        F.concat(F.hex("pos_file"), F.lit("/"), F.hex("pos_offset")).alias("lsn"),
        F.col("pos_ordinal").alias("ordinal"),
        F.col("op").alias("tag"),
        F.struct(
            F.lit("public").alias("schema"),
            F.when(F.col("price") < 50000, "orders").otherwise("audit").alias("name"),
        ).alias("relation"),
        F.when(~gone, image).alias("new"),
        F.when(gone & (F.col("state") == "F"), image).alias("old"),
        F.when(gone, key_only).alias("key"),
    )


_IMAGE_TYPES = {
    "order_key": "bigint",
    "price": "double",
    "state": "string",
    "changed_at": "timestamp_ntz",
    "ref_key": "bigint",
}


@query(
    "normalize_changes_pg",
    """SELECT op, upper(to_hex(pos_file)) || '/' || upper(to_hex(pos_offset)) AS position, pos_ordinal AS ordinal,
              order_key, CASE WHEN op <> 'delete' OR state = 'F' THEN price END AS price,
              CASE WHEN op <> 'delete' OR state = 'F' THEN changed_at END AS changed_at
       FROM @change_log WHERE price < 50000""",
)
def _(t):
    return changes.normalize_changes_pg(_pg_feed(t), "public", "orders").select(
        "op", "position", "ordinal", "row.order_key", "row.price", "row.changed_at"
    )


def _mysql_feed(t):
    """Row events of two rows each: the change and an echo with half the price."""
    image = F.struct("order_key", "price", "state", "ref_key")
    echo = F.struct("order_key", (F.col("price") / 2).alias("price"), "state", "ref_key")
    none = F.lit(None).cast("struct<order_key:bigint,price:double,state:string,ref_key:bigint>")
    gone, added = F.col("op") == "delete", F.col("op") == "insert"

    def change(row):
        return F.struct(
            F.when(~added, row).otherwise(none).alias("before"),
            F.when(~gone, row).otherwise(none).alias("after"),
        )

    return t.change_log.select(
        F.when(added, "writerows").when(gone, "deleterows").otherwise("updaterows").alias("event"),
        F.concat(F.lit("binlog."), F.lpad(F.col("pos_file").cast("string"), 6, "0")).alias("file"),
        F.col("pos_offset").alias("next_position"),
        F.array(change(image), change(echo)).alias("rows"),
    )


@query(
    "normalize_changes_mysql",
    """SELECT op, 'binlog.' || lpad(CAST(pos_file AS VARCHAR), 6, '0') || ':' || pos_offset || ':' || i AS position,
              CAST(i AS BIGINT) AS ordinal, order_key, CASE WHEN i = 0 THEN price ELSE price / 2 END AS price
       FROM @change_log, (VALUES (0), (1)) v(i)""",
)
def _(t):
    return changes.normalize_changes_mysql(_mysql_feed(t)).select(
        "op", "position", "ordinal", "row.order_key", "row.price"
    )


def _mongo_feed(t):
    """Document events: cheap updates are replaces, some carry no document, and a
    few lines are not changes of a document at all."""
    image = F.struct("order_key", "price")
    key = F.struct("order_key", F.lit(None).cast("double").alias("price"))
    gone = F.col("op") == "delete"
    kind = (
        F.when(F.col("price") > 99900, "drop")
        .when((F.col("op") == "update") & (F.col("price") < 30000), "replace")
        .otherwise(F.col("op"))
    )
    return t.change_log.select(
        F.col("position").alias("_id"),
        kind.alias("operationType"),
        F.when(~gone & (F.col("state") == "F"), image).alias("fullDocument"),
        F.when(gone & (F.col("state") == "O"), image).alias("fullDocumentBeforeChange"),
        key.alias("documentKey"),
    )


@query(
    "normalize_changes_mongo",
    """SELECT op, position, order_key,
              CASE WHEN (op <> 'delete' AND state = 'F') OR (op = 'delete' AND state = 'O') THEN price END AS price
       FROM @change_log WHERE price <= 99900""",
)
def _(t):
    return changes.normalize_changes_mongo(_mongo_feed(t)).select(
        "op", "position", "row.order_key", "row.price"
    )


@query(
    "normalize_changes_redis",
    """SELECT CASE WHEN event IN ('del', 'expired') THEN 'delete' ELSE 'update' END AS op, position, e.key, event,
              CASE WHEN event IN ('del', 'expired') THEN NULL ELSE coalesce(k.type, 'none') END AS type,
              CASE WHEN event IN ('del', 'expired') THEN NULL ELSE k.value END AS value
       FROM (SELECT 'user:' || order_key AS key, position,
                    CASE op WHEN 'insert' THEN 'hset' WHEN 'update' THEN 'expire'
                            ELSE CASE state WHEN 'F' THEN 'del' ELSE 'expired' END END AS event
             FROM @change_log) e LEFT JOIN @keyspace k ON k.key = e.key""",
)
def _(t):
    event = (
        F.when(F.col("op") == "insert", "hset")
        .when(F.col("op") == "update", "expire")
        .when(F.col("state") == "F", "del")
        .otherwise("expired")
    )
    feed = t.change_log.select(
        F.concat(F.lit("user:"), F.col("order_key").cast("string")).alias("key"),
        "position",
        event.alias("event"),
    )
    return changes.normalize_changes_redis(feed, t.keyspace, "user:*").select("op", "position", "row.*")


@query(
    "position_order_lsn",
    """SELECT position, pos_file * 4294967296 + pos_offset AS number, pos_ordinal AS ordinal,
              false AS noise_is_new
       FROM @change_log""",
)
def _(t):
    lsn = F.concat(F.hex("pos_file"), F.lit("/"), F.hex("pos_offset"))
    return t.change_log.select(
        "position",
        lsn_order(lsn).cast("bigint").alias("number"),
        F.col("pos_ordinal").alias("ordinal"),
        F.coalesce(lsn_order(F.col("op")) > 0, F.lit(False)).alias("noise_is_new"),
    )


@query(
    "position_order_binlog",
    """SELECT position, 'binlog.' || lpad(CAST(pos_file AS VARCHAR), 6, '0') AS file, pos_offset AS pos,
              pos_ordinal AS row_at, CAST(-1 AS BIGINT) AS short_row, CAST(0 AS BIGINT) AS bare_pos
       FROM @change_log""",
)
def _(t):
    full = binlog_order(F.col("position"))
    short = binlog_order(F.concat(F.lit("binlog.1:"), F.col("pos_offset").cast("string")))
    bare = binlog_order(F.col("op"))
    return t.change_log.select(
        "position",
        full["file"].alias("file"),
        full["pos"].alias("pos"),
        full["row"].alias("row_at"),
        short["row"].alias("short_row"),
        bare["pos"].alias("bare_pos"),
    )


@query("last_change_per_key", "SELECT op, position, order_key, price FROM @last_change")
def _(t):
    return merge.last_per_key(
        t.change_log.select("op", "position", "order_key", "price", *ORDER), ["order_key"], ORDER
    ).select("op", "position", "order_key", "price")


@query(
    "dedupe_positions",
    """SELECT DISTINCT op, position, order_key, price FROM @change_log
       WHERE (pos_file, pos_offset, pos_ordinal) > (2000, 0, 0)""",
)
def _(t):
    return changes.dedupe_positions(t.change_log, ORDER, (2000, 0, 0)).select(
        "op", "position", "order_key", "price"
    )


@query(
    "cdc_start_modes",
    """SELECT 'stored' AS mode, position, order_key FROM @change_log
       WHERE (pos_file, pos_offset, pos_ordinal) > (3000, 0, 0)""",
)
def _(t):
    """Changes delivered from a stored position, and none when starting from now."""
    stored = changes.cdc_start(t.change_log, ORDER, (3000, 0, 0))
    now = changes.cdc_start(t.change_log, ORDER, None)

    def delivered(mode, start):
        rows = changes.after_position(t.change_log, ORDER, start)
        return rows.select(F.lit(mode).alias("mode"), "position", "order_key")

    return delivered("stored", stored).unionByName(delivered("now", now))


@query(
    "gap_detect",
    """SELECT stored_file, min(pos_file) > stored_file AS history_lost, min(pos_file) AS oldest_pos_file,
              CASE WHEN min(pos_file) > stored_file THEN max(pos_file) ELSE stored_file END AS restart_pos_file
       FROM @change_log, (VALUES (CAST(1 AS BIGINT)), (CAST(2500 AS BIGINT))) v(stored_file) GROUP BY stored_file""",
)
def _(t):
    def check(stored):
        return changes.gap_detect(t.change_log, ORDER, (stored, 0, 0)).select(
            F.lit(stored).cast("bigint").alias("stored_file"),
            "history_lost",
            "oldest_pos_file",
            "restart_pos_file",
        )

    return check(1).unionByName(check(2500))


_SYNCED = """SELECT * FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @change_log)
             UNION ALL
             SELECT order_key, price, state, changed_at, ref_key FROM @last_change WHERE op <> 'delete'"""


def _target(t, label):
    """order_state published as the first version of a table."""
    state = t.order_state
    table = SnapshotTable(t.spark, scratch_path(t.spark, label), state.schema, ["order_key"], 8)
    table.apply(state, merge.insert_rows, "initial copy")
    return table


@query("cdc_apply_stream", _SYNCED)
def _(t):
    """The change log as a stream in two sittings, the second one after a restart."""
    table, log = _target(t, "stream-target"), scratch_path(t.spark, "change-log")
    checkpoint = scratch_path(t.spark, "stream-checkpoint")
    feed = t.change_log
    early, late = feed.where("pos_file < 2500"), feed.where("pos_file >= 2500")
    for part in (early, late):
        part.write.mode("append").parquet(log)
        stream = change_log_stream(t.spark, log, feed.schema)
        start_bridge(stream, table, ORDER, checkpoint, "orders").awaitTermination()
    return table.read()


@query(
    "cdc_fan_out",
    """SELECT 'totals' AS target, order_key AS id, price AS amount FROM @last_final_change WHERE op <> 'delete'
       UNION ALL
       SELECT 'journal', c.order_key, price
       FROM (SELECT DISTINCT * FROM @change_log WHERE op <> 'delete' AND state = 'F') c
       LEFT JOIN (SELECT order_key, max((pos_file, pos_offset, pos_ordinal)) AS gone FROM @change_log
                  WHERE op = 'delete' GROUP BY order_key) d ON d.order_key = c.order_key
       WHERE gone IS NULL OR (pos_file, pos_offset, pos_ordinal) > gone""",
)
def _(t):
    """Two targets of one bridge: an upsert target and a journal that appends.

    The bridge keeps state F; deletes pass its filter whatever their state.
    """
    mapping = (ColumnMapping("order_key", "id"), ColumnMapping("price", "amount"))
    bridge = Bridge(
        "final",
        "orders",
        filters=(Filter("state", "eq", "F"),),
        targets=(
            Target("totals", key_columns=("id",), mapping=mapping),
            Target("journal", key_columns=("id",), mapping=mapping, write_mode="insert"),
        ),
        trigger="cdc",
    )
    schema = T.StructType().add("id", T.LongType()).add("amount", T.DoubleType())
    tables = {
        name: SnapshotTable(t.spark, scratch_path(t.spark, name), schema, ["id"], 8)
        for name in ("totals", "journal")
    }
    for batch in ("batch-1", "batch-1"):
        apply_to_targets(bridge, t.change_log, tables, ORDER, batch)
    first, second = (
        table.read().select(F.lit(name).alias("target"), "id", "amount")
        for name, table in tables.items()
    )
    return first.unionByName(second)


@query("exactly_once_replay", _SYNCED)
def _(t):
    """The same batch three times, once under another name: nothing changes."""
    table = _target(t, "replay-target")
    for batch in ("batch-1", "batch-1", "sent again"):
        apply_batch(t.change_log, table, ORDER, batch)
    return table.read()


# the log in two partitions by even and odd orders; the odd ones arrive later, with lower positions among them
_PARTED = """SELECT DISTINCT *, CAST(order_key % 2 AS INTEGER) AS log_part FROM @change_log"""


def _two_partitions(t, label, **settings):
    """The change log as a pipeline in two sittings, and the same sittings from a new checkpoint."""
    table, log = _target(t, label), scratch_path(t.spark, "parted-log")
    bridge = Bridge("parted", "orders", ("order_key",), targets=(Target("orders", key_columns=("order_key",)),), trigger="cdc", **settings)
    ledger = StreamLedger(t.spark, scratch_path(t.spark, "stream-ledger"), "run-1")
    feed = t.change_log.withColumn("log_part", F.expr("CAST(order_key % 2 AS INT)"))
    first = scratch_path(t.spark, "checkpoint")
    for part, checkpoint in ((0, first), (1, first), (None, scratch_path(t.spark, "checkpoint"))):
        if part is not None:
            feed.where(F.col("log_part") == part).write.mode("append").option("compression", "zstd").parquet(log)
        stream = change_log_stream(t.spark, log, feed.schema)
        start_pipeline(stream, bridge, {"orders": table}, ORDER, checkpoint, ledger, "log_part").awaitTermination()
        table.vacuum(keep=1)
    return table, ledger


@query("cdc_pipeline", _SYNCED)
def _(t):
    """The target after two interleaved log partitions, read twice."""
    return _two_partitions(t, "pipeline-target")[0].read()


@query(
    "cdc_pipeline_ledger",
    f"""SELECT 'run-1' AS run_id, CASE log_part WHEN 0 THEN i // 4 ELSE CAST(ceil(evens / 4) AS BIGINT) + (i - evens) // 4 END AS sequence,
               count(*) AS row_count, 'success' AS status, CAST(1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT log_part, row_number() OVER (ORDER BY log_part, pos_file, pos_offset, pos_ordinal) - 1 AS i,
                     count(*) FILTER (log_part = 0) OVER () AS evens FROM ({_PARTED}))
        GROUP BY ALL""",
)
def _(t):
    """One record per four changes; the second reading of the log adds none."""
    deliveries = _two_partitions(t, "pipeline-ledger", delivery=Delivery(batch_size=4))[1].read()
    return deliveries.select("run_id", "sequence", "row_count", "status", "attempts", "error")


@query(
    "cdc_start_now",
    """SELECT position, order_key FROM (SELECT DISTINCT * FROM @change_log) WHERE op <> 'delete' AND pos_file >= 2500
       AND (order_key, pos_file, pos_offset, pos_ordinal) NOT IN (
         SELECT c.order_key, c.pos_file, c.pos_offset, c.pos_ordinal FROM @change_log c JOIN @change_log d ON d.order_key = c.order_key
         WHERE d.op = 'delete' AND d.pos_file >= 2500
           AND (d.pos_file, d.pos_offset, d.pos_ordinal) >= (c.pos_file, c.pos_offset, c.pos_ordinal))""",
)
def _(t):
    """A journal of a stream that started from now, when the log had reached file 2499."""
    return _started(t, "start-now", "now", None).read()


@query(
    "cdc_history_lost",
    """SELECT CAST(min(pos_file) > 2000 AS BOOLEAN) AS lost, max(pos_file) AS restart_file FROM @change_log WHERE pos_file >= 2500""",
)
def _(t):
    """A stream that had come to file 2000 and finds a log that begins with file 2500."""
    ledger = StreamLedger(t.spark, scratch_path(t.spark, "gap-ledger"), "run-1")
    ledger.commit(Entry("earlier", 0, 10, {"": [2000, 0, 0]}))
    entry = prepare_start(ledger, t.change_log.where("pos_file >= 2500"), ORDER, None)
    note = F.lit(entry.note).isNotNull().alias("lost")
    return t.change_log.agg(F.max("pos_file").alias("end")).select(note, F.lit(entry.vector[""][0]).cast("bigint").alias("restart_file"))


def _started(t, label, start, partition):
    log, checkpoint = scratch_path(t.spark, "log"), scratch_path(t.spark, "checkpoint")
    schema = t.change_log.select("position", "order_key").schema
    table = SnapshotTable(t.spark, scratch_path(t.spark, label), schema, ["order_key"], 8)
    mapping = tuple(ColumnMapping(c, c) for c in schema.names)
    bridge = Bridge("late", "orders", targets=(Target("journal", key_columns=("order_key",), write_mode="insert", mapping=mapping),), trigger="cdc")
    ledger = StreamLedger(t.spark, scratch_path(t.spark, "ledger"), "run-1")
    for part in ("pos_file < 2500", "pos_file >= 2500"):
        t.change_log.where(part).write.mode("append").parquet(log)
        stream = change_log_stream(t.spark, log, t.change_log.schema)
        held = t.spark.read.schema(t.change_log.schema).parquet(log)
        start_pipeline(stream, bridge, {"journal": table}, ORDER, checkpoint, ledger, partition, log=held, start=start).awaitTermination()
    return table
