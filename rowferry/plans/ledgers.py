"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import Delivery, Payload
from rowferry.operators import ledger
from rowferry.operators.payload import render_batch, retry_due
from rowferry.operators.row_index import row_index_sequence
from rowferry.plans.inputs import ORDER
from rowferry.plans.registry import query


@query(
    "pending_deliveries",
    "SELECT * FROM @planned WHERE (run_id, sequence) NOT IN (SELECT (run_id, sequence) FROM @settled)",
)
def _(t):
    return ledger.pending_deliveries(t.runs, t.deliveries)


@query(
    "planned_deliveries",
    """SELECT run_id, CAST(ceil(total_count / batch_size) AS BIGINT) AS delivery_count,
              total_count - (CAST(ceil(total_count / batch_size) AS BIGINT) - 1) * batch_size AS last_batch_size
       FROM @runs""",
)
def _(t):
    return ledger.planned_deliveries(t.runs)


_COUNTERS = """
    SELECT run_id, CAST(coalesce(sum(row_count) FILTER (status = 'success'), 0) AS BIGINT) AS sent_count,
           CAST(coalesce(sum(row_count) FILTER (status = 'failed'), 0) AS BIGINT) AS failed_count,
           CAST(coalesce(sum(row_count) FILTER (status = 'skipped'), 0) AS BIGINT) AS skipped_count
    FROM @deliveries GROUP BY run_id"""


@query("run_counters", _COUNTERS)
def _(t):
    return ledger.run_counters(t.deliveries)


@query(
    "run_progress",
    f"""SELECT run_id, total_count, settled,
               CASE WHEN total_count IS NOT NULL THEN greatest(0, total_count - settled) END AS pending,
               CASE WHEN total_count > 0
                    THEN least(100, CAST(floor(settled * 100.0 / total_count + 0.5) AS BIGINT)) END AS percent,
               CASE WHEN sent + failed > 0
                    THEN CAST(floor(sent * 100.0 / (sent + failed) + 0.5) AS BIGINT) END AS success_rate
        FROM (SELECT r.run_id, total_count, coalesce(sent_count, 0) AS sent, coalesce(failed_count, 0) AS failed,
                     coalesce(sent_count + failed_count + skipped_count, 0) AS settled
              FROM @runs r LEFT JOIN ({_COUNTERS}) c ON c.run_id = r.run_id)""",
)
def _(t):
    return ledger.run_progress(t.runs, t.deliveries)


@query("settled_sequences", "SELECT run_id, sequence FROM @settled")
def _(t):
    return ledger.settled_sequences(t.deliveries)


def _outcomes(t):
    """Failed deliveries sent again, and deliveries that were never recorded."""
    again = t.deliveries.where("status = 'failed'").select(
        "run_id", "sequence", F.lit("success").alias("status"), F.lit(200).alias("http_status"),
        (F.col("attempts") + 1).alias("attempts"), "row_index", "row_count",
    )
    fresh = t.runs.select(
        "run_id", F.lit(9).cast("bigint").alias("sequence"), F.lit("failed").alias("status"),
        F.lit(500).alias("http_status"), F.lit(1).alias("attempts"),
        F.lit(900).cast("bigint").alias("row_index"), F.lit(100).cast("bigint").alias("row_count"),
    )
    return again.unionByName(fresh)


@query(
    "record_deliveries",
    """SELECT run_id, sequence, row_index, row_count, CASE status WHEN 'failed' THEN 'success' ELSE status END AS status,
              CASE status WHEN 'failed' THEN 200 ELSE http_status END AS http_status,
              CASE status WHEN 'failed' THEN attempts + 1 ELSE attempts END AS attempts
       FROM @deliveries
       UNION ALL SELECT run_id, 9, 900, 100, 'failed', 500, 1 FROM @runs""",
)
def _(t):
    return ledger.record_deliveries(t.deliveries, _outcomes(t))


_SKIPPED = """
    SELECT w.run_id, w.sequence, w.sequence * batch_size AS row_index,
           CASE WHEN w.sequence = CAST(ceil(total_count / batch_size) AS BIGINT) - 1
                THEN total_count - w.sequence * batch_size ELSE batch_size END AS row_count,
           'skipped' AS status, CAST(0 AS INTEGER) AS attempts
    FROM ({wanted}) w JOIN @runs r ON r.run_id = w.run_id
    WHERE (w.run_id, w.sequence) NOT IN (SELECT (run_id, sequence) FROM @deliveries)"""


@query(
    "skip_sequences",
    _SKIPPED.format(wanted="SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS sequence FROM lineitem"),
)
def _(t):
    """Asks to skip the sequence after each recorded one."""
    wanted = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("sequence")
    )
    return ledger.skip_sequences(t.runs, t.deliveries, wanted)


@query(
    "skip_range",
    _SKIPPED.format(
        wanted="SELECT run_id, unnest(generate_series(2, 2 + cursor_offset % 7)) AS sequence FROM @runs"
    ),
)
def _(t):
    ranges = t.runs.select(
        "run_id",
        F.lit(2).cast("bigint").alias("first"),
        (2 + F.col("cursor_offset") % 7).alias("last"),
    )
    return ledger.skip_range(t.runs, t.deliveries, ranges)


@query(
    "resume_plan",
    """SELECT p.run_id, p.sequence, p.row_index, p.row_count FROM @planned p JOIN @runs r ON r.run_id = p.run_id
       WHERE r.status = 'failed' AND p.sequence >= r.cursor_offset // r.batch_size
         AND (p.run_id, p.sequence) NOT IN (SELECT (run_id, sequence) FROM @settled)""",
)
def _(t):
    return ledger.resume_plan(t.runs, t.deliveries)


@query(
    "retry_failed_plan",
    """SELECT p.run_id, p.sequence, p.row_index, p.row_count FROM @planned p JOIN @runs r ON r.run_id = p.run_id
       WHERE r.status IN ('failed', 'completed')
         AND p.run_id IN (SELECT run_id FROM @deliveries WHERE status = 'failed')
         AND (p.run_id, p.sequence) NOT IN (SELECT (run_id, sequence) FROM @settled)""",
)
def _(t):
    return ledger.retry_failed_plan(t.runs, t.deliveries)


def _captured(t):
    """Rows recorded with each delivery: the changes of its line."""
    return t.change_log.withColumn("run_id", F.col("order_key")).withColumn(
        "sequence", F.col("pos_offset") - F.col("order_key") * 8 - 1
    )


@query(
    "resend_failed",
    """SELECT * FROM @order_state WHERE order_key NOT IN (SELECT order_key FROM @resent)
       UNION ALL
       SELECT order_key, price, state, changed_at, ref_key FROM
         (SELECT * FROM @resent QUALIFY row_number() OVER (PARTITION BY order_key
            ORDER BY pos_file DESC, pos_offset DESC, pos_ordinal DESC) = 1) WHERE op <> 'delete'""",
)
def _(t):
    """The target after the failed deliveries of ended runs were applied again."""
    return ledger.resend_failed(
        t.order_state, t.runs, t.deliveries, _captured(t), ["order_key"], ORDER
    )[0]


@query(
    "resend_failed_ledger",
    """SELECT d.run_id, sequence, CASE WHEN d.status = 'failed' AND r.status <> 'running' THEN 'success' ELSE d.status END AS status,
              CASE WHEN d.status = 'failed' AND r.status <> 'running' THEN attempts + 1 ELSE attempts END AS attempts
       FROM @deliveries d JOIN @runs r ON r.run_id = d.run_id""",
)
def _(t):
    """The ledger after the same resend."""
    sent = ledger.resend_failed(
        t.order_state, t.runs, t.deliveries, _captured(t), ["order_key"], ORDER
    )[1]
    return sent.select("run_id", "sequence", "status", "attempts")


@query(
    "abort_cut",
    """SELECT d.run_id, d.sequence, d.status FROM @deliveries d LEFT JOIN
         (SELECT run_id, min(sequence) AS stop FROM @deliveries WHERE status = 'failed' GROUP BY run_id) f
         ON f.run_id = d.run_id WHERE stop IS NULL OR sequence <= stop""",
)
def _(t):
    return ledger.abort_cut(t.deliveries).select("run_id", "sequence", "status")


@query(
    "row_keys",
    """SELECT i // 50 AS sequence, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) || ']' AS row_keys,
              count(*) AS row_count
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1""",
)
def _(t):
    """Keys recorded for each delivery of 50 rows."""
    numbered = row_index_sequence(t.orders.select("o_orderkey"), keys=["o_orderkey"], batch_size=50)
    batches = render_batch(numbered, Payload(), "orders", "", keys=["o_orderkey"])
    return batches.select("sequence", "row_keys", "row_count")


@query(
    "delivery_window",
    """SELECT run_id, sequence, status, attempts FROM @deliveries
       WHERE run_id = 5 AND sequence BETWEEN 1 AND 5 ORDER BY sequence LIMIT 3 OFFSET 1""",
)
def _(t):
    return ledger.delivery_window(t.deliveries, 5, first=1, last=5, offset=1, limit=3).select(
        "run_id", "sequence", "status", "attempts"
    )


@query(
    "list_runs",
    "SELECT * FROM @runs WHERE bridge_id = 7 ORDER BY started_at DESC, run_id DESC LIMIT 50",
)
def _(t):
    return ledger.list_runs(t.runs, 7)


_LATEST = """
    SELECT bridge_id, run_id, status AS last_status, status = 'running' AS active FROM @runs
    QUALIFY row_number() OVER (PARTITION BY bridge_id ORDER BY started_at DESC, run_id DESC) = 1"""


@query("latest_run_per_bridge", _LATEST)
def _(t):
    return ledger.latest_run_per_bridge(t.runs)


BRIDGE_STATUS_SQL = f"""
    SELECT b.bridge_id, CASE WHEN NOT enabled THEN 'disabled' WHEN active THEN 'active'
           WHEN last_status = 'failed' THEN 'failed' ELSE 'idle' END AS status
    FROM @bridge_rows b LEFT JOIN ({_LATEST}) l ON l.bridge_id = b.bridge_id"""


@query("bridge_status", BRIDGE_STATUS_SQL)
def _(t):
    return ledger.bridge_status(t.bridges, t.runs)


@query(
    "retry_due",
    """SELECT run_id, sequence, attempts, http_status,
              CAST(least(1500, 500 * pow(2, attempts - 1)) AS BIGINT) AS delay_ms
       FROM @deliveries WHERE status = 'failed' AND (http_status IS NULL OR http_status = 503) AND attempts < 3""",
)
def _(t):
    due = retry_due(t.deliveries, Delivery(backoff_max_ms=1500))
    return due.select("run_id", "sequence", "attempts", "http_status", "delay_ms")
