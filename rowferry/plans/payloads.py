"""Payload queries. JSON is compared as text where only integers and plain strings occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import Payload
from rowferry.operators import payload
from rowferry.operators.row_index import row_index_sequence
from rowferry.plans.registry import query

_NOW = "2024-01-01T00:00:00.000Z"
_GAPS = '{"n": "{{$index}}", "id": "{{c_custkey}}", "name": "{{c_name}}", "gone": "{{gone}}", "text": "<{{lost}}>"}'


@query(
    "render_row",
    """SELECT c_custkey, '{"id":' || c_custkey || ',"label":"customer-' || c_custkey || ' (' || c_mktsegment || ')",' ||
              '"tags":["' || c_mktsegment || '",null],"k_' || c_nationkey || '":{"name":"' || c_name || '","fixed":1}}' AS body
       FROM customer""",
)
def _(t):
    template = (
        '{"id": "{{c_custkey}}", "label": "customer-{{ c_custkey }} ({{c_mktsegment}})",'
        ' "tags": ["{{c_mktsegment}}", "{{missing}}"],'
        ' "k_{{c_nationkey}}": {"name": "{{c_name}}", "fixed": 1}}'
    )
    return payload.render_row(t.customer, Payload(template), "customer", _NOW).select("c_custkey", "body")


@query(
    "render_row_text",
    """SELECT conv_id, turn, text AS text_back, role || ': ' || text AS mixed_back FROM conversations""",
)
def _(t):
    """Free text with quotes and newlines comes back unchanged from the body."""
    template = '{"whole": "{{text}}", "mixed": "{{role}}: {{text}}"}'
    rendered = payload.render_row(t.conversations, Payload(template), "conversations", _NOW)
    return rendered.select(
        "conv_id",
        "turn",
        F.get_json_object("body", "$.whole").alias("text_back"),
        F.get_json_object("body", "$.mixed").alias("mixed_back"),
    )


@query(
    "render_tokens",
    f"""SELECT c_custkey, '{{"row":{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}},"table":"customer","now":"{_NOW}","at":'
              || (row_number() OVER (ORDER BY c_custkey) - 1) || ',"op":"update"}}' AS body FROM customer""",
)
def _(t):
    rows = row_index_sequence(t.customer.select("c_custkey", "c_name"), keys=["c_custkey"])
    template = '{"row": "{{$row}}", "table": "{{$table}}", "now": "{{$now}}", "at": "{{$index}}", "op": "{{$op}}"}'
    return payload.render_row(
        rows.withColumn("op", F.lit("update")),
        Payload(template, fields=("c_custkey", "c_name")),
        "customer",
        _NOW,
        index="row_index",
        op="op",
        hidden=["sequence"],
    ).select("c_custkey", "body")


@query(
    "render_batch",
    """SELECT i // 40 AS sequence, min(i) AS row_index, count(*) AS row_count,
              '[' || string_agg('{"at":' || i || ',"id":' || c_custkey || '}', ',' ORDER BY i) || ']' AS body
       FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) GROUP BY 1""",
)
def _(t):
    rows = row_index_sequence(t.customer.select("c_custkey"), keys=["c_custkey"], batch_size=40)
    template = '{"at": "{{$index}}", "id": "{{c_custkey}}"}'
    return payload.render_batch(rows, Payload(template), "customer", _NOW)


@query(
    "render_wrap",
    """SELECT c_custkey, '{"data":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}' AS body FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return payload.render_row(rows, Payload(wrap_key="data"), "customer", _NOW).select("c_custkey", "body")


@query(
    "drop_forbidden_keys",
    """SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN '{"ok":1}'
              ELSE '{"' || c_mktsegment || '":' || c_custkey || ',"ok":1}' END AS body FROM customer""",
)
def _(t):
    """Static and computed keys that would change the object are left out."""
    key = F.when(F.col("c_nationkey") < 12, "__proto__").otherwise(F.col("c_mktsegment"))
    rows = t.customer.select("c_custkey", key.alias("dynamic"))
    template = '{"constructor": 1, "{{dynamic}}": "{{c_custkey}}", "ok": 1}'
    return payload.render_row(rows, Payload(template), "customer", _NOW).select("c_custkey", "body")


@query(
    "payload_outbox",
    """SELECT sequence, row_index, row_count, row_keys, 'run-1:' || sequence AS idempotency_key, body,
              substr(body, 1, 16384) AS logged_body
       FROM (SELECT i // 500 AS sequence, min(i) AS row_index, count(*) AS row_count,
                    '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) || ']' AS row_keys,
                    '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}', ',' ORDER BY i) || ']' AS body
             FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    numbered = row_index_sequence(rows, keys=["o_orderkey"], batch_size=500)
    rename = {"o_orderkey": "id", "o_orderstatus": "status", "o_orderpriority": "priority"}
    return payload.payload_outbox(
        numbered, Payload(rename=rename), "orders", _NOW, "run-1", ["o_orderkey"]
    )


@query(
    "change_outbox",
    """SELECT position, '[' || order_key || ']' AS row_keys, 'run-2:' || position AS idempotency_key,
              '{"order_key":' || order_key || ',"state":"' || state || '","$op":"' || op || '"}' AS body
       FROM @change_log""",
)
def _(t):
    """One request per change; without a field list the row carries its operation."""
    rows = t.change_log.select("order_key", "state", "op", "position")
    return payload.change_outbox(rows, Payload(), "orders", _NOW, "run-2", ["order_key"])


@query(
    "preview_rows",
    "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 10",
)
def _(t):
    from rowferry.config import ColumnMapping
    from rowferry.operators.paging import preview_rows

    mapping = [ColumnMapping("c_custkey", "id"), ColumnMapping("c_name", "name")]
    return preview_rows(t.customer, mapping, 10, ["c_custkey"])


@query(
    "preview_payload",
    """SELECT i AS row_index, '{"n":' || i || ',"id":' || c_custkey || ',"name":"' || c_name || '","gone":null,"text":"<>"}' AS body,
              'gone,lost' AS warnings
       FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer WHERE c_nationkey <> 3) WHERE i < 10""",
)
def _(t):
    """What a payload bridge would send first, with the tokens that resolve to nothing."""
    from rowferry.operators.preview import preview_payload

    rows = t.customer.where("c_nationkey <> 3")
    shown = preview_payload(rows, Payload(_GAPS), "customer", _NOW, 10, ("c_acctbal", "c_custkey"))
    return shown.withColumn("warnings", F.array_join("warnings", ","))


@query(
    "render_warnings",
    """SELECT w AS token, c_mktsegment, count(*) AS bodies FROM customer, (SELECT unnest(['gone', 'lost']) AS w) GROUP BY 1, 2""",
)
def _(t):
    """How many bodies each unresolved token leaves a gap in, by segment."""
    missing = payload.render_warnings(t.customer, Payload(_GAPS))
    counts = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("bodies"))
    token = F.explode(F.array(*map(F.lit, missing))).alias("token")
    return counts.select(token, "c_mktsegment", "bodies")


@query(
    "preview_bridge",
    "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderkey LIMIT 10",
)
def _(t):
    """The first mapped rows of a bridge that writes to a table."""
    from rowferry.config import Bridge, ColumnMapping, Filter, Target
    from rowferry.operators.preview import preview_bridge

    mapping = (ColumnMapping("o_orderkey", "id"), ColumnMapping("o_orderstatus", "state"))
    bridge = Bridge("b", "orders", ("o_orderkey",), (Filter("o_totalprice", "gte", 1000),), targets=(Target("copy", key_columns=("id",), mapping=mapping),))
    return preview_bridge(bridge, t.orders, _NOW, 10).bodies
