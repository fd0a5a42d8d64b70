"""Mapping, renaming, types and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.config import ColumnMapping
from rowferry.functions.stamps import ts_norm
from rowferry.functions.text import (
    bytes_tag,
    bytes_untag,
    csv_cell,
    plain_text,
    quote_ident,
    row_key,
    sql_literal,
)
from rowferry.functions.types import is_safe_default, is_safe_name
from rowferry.operators import projection
from rowferry.operators.ddl import normalize_types, translate_schema
from rowferry.plans.registry import query
from rowferry.sources.keyspace import list_members, zset_pairs


@query(
    "map_columns",
    "SELECT c_custkey AS id, c_name AS full_name, CAST(NULL AS VARCHAR) AS email FROM customer",
)
def _(t):
    return projection.map_columns(
        t.customer,
        [
            ColumnMapping("c_custkey", "id"),
            ColumnMapping("c_name", "full_name"),
            ColumnMapping("c_email", "email"),
        ],
    )


@query("map_identity", "SELECT * FROM customer")
def _(t):
    return projection.map_columns(t.customer)


@query(
    "source_column_for",
    """SELECT c.table_name || '.' || c.column_name AS target, coalesce(m.source, c.table_name || '.' || c.column_name) AS source
       FROM (SELECT DISTINCT table_name, column_name FROM @catalog_columns) c
       LEFT JOIN (SELECT target, arg_min(source, position) AS source FROM
                    (SELECT table_name || '.' || column_name AS target, key_name AS source,
                            key_name || schema_name AS position FROM @catalog_keys) GROUP BY target) m
         ON m.target = c.table_name || '.' || c.column_name""",
)
def _(t):
    target = F.concat_ws(".", "table_name", "column_name").alias("target")
    targets = t.catalog_columns.select(target).distinct()
    mapping = t.catalog_keys.select(
        target, F.col("key_name").alias("source"), F.concat("key_name", "schema_name").alias("position")
    )
    return projection.source_column_for(targets, mapping)


@query("project_fields_rename", "SELECT c_custkey AS id, c_name, c_mktsegment AS segment FROM customer")
def _(t):
    return projection.project_fields_rename(
        t.customer,
        ["c_mktsegment", "c_name", "c_custkey"],
        {"c_custkey": "id", "c_mktsegment": "segment"},
    )


_PORTABLE_SQL = """
    CASE WHEN regexp_matches(lower(data_type), '(^| )uuid') THEN 'uuid'
         WHEN regexp_matches(lower(data_type), 'bool') THEN 'boolean'
         WHEN regexp_matches(lower(data_type), 'timestamp|datetime|^date$| date|time with|time without') THEN 'timestamp'
         WHEN regexp_matches(lower(data_type), 'json|object|array|bson') THEN 'json'
         WHEN regexp_matches(lower(data_type), 'bigint|int8|long') THEN 'bigint'
         WHEN regexp_matches(lower(data_type), 'serial|^int|integer|int4|int2|smallint|tinyint|mediumint') THEN 'integer'
         WHEN regexp_matches(lower(data_type), 'numeric|decimal|real|double|float|money|number') THEN 'number'
         ELSE 'text' END"""


@query(
    "normalize_types",
    f"""SELECT schema_name, table_name, column_name, data_type, {_PORTABLE_SQL} AS portable_type
        FROM @catalog_columns""",
)
def _(t):
    return normalize_types(t.catalog_columns).select(
        "schema_name", "table_name", "column_name", "data_type", "portable_type"
    )


def _translate(engine, cases):
    @query(
        f"translate_schema_{engine}" if engine != "mysql" else "translate_schema",
        f"""SELECT schema_name, table_name, column_name, portable_type, {cases} AS target_type,
                   nullable AND NOT is_key AS target_nullable, is_key AS primary_key, false AS auto_increment
            FROM (SELECT *, {_PORTABLE_SQL} AS portable_type FROM @catalog_columns)""",
    )
    def _(t):
        return translate_schema(t.catalog_columns, engine).select(
            "schema_name",
            "table_name",
            "column_name",
            "portable_type",
            "target_type",
            "target_nullable",
            "primary_key",
            "auto_increment",
        )


_translate(
    "mysql",
    """CASE portable_type WHEN 'integer' THEN 'INT' WHEN 'bigint' THEN 'BIGINT' WHEN 'number' THEN 'DOUBLE'
       WHEN 'boolean' THEN 'TINYINT(1)' WHEN 'timestamp' THEN 'DATETIME' WHEN 'json' THEN 'JSON'
       WHEN 'uuid' THEN CASE WHEN is_key THEN 'VARCHAR(255)' ELSE 'CHAR(36)' END
       ELSE CASE WHEN is_key THEN 'VARCHAR(255)' ELSE 'TEXT' END END""",
)
_translate(
    "postgres",
    """CASE portable_type WHEN 'integer' THEN 'INTEGER' WHEN 'bigint' THEN 'BIGINT' WHEN 'number' THEN 'DOUBLE PRECISION'
       WHEN 'boolean' THEN 'BOOLEAN' WHEN 'timestamp' THEN 'TIMESTAMP' WHEN 'json' THEN 'JSONB'
       WHEN 'uuid' THEN 'UUID' ELSE 'TEXT' END""",
)
_translate(
    "sqlite",
    """CASE WHEN portable_type IN ('integer', 'bigint', 'boolean') THEN 'INTEGER'
            WHEN portable_type = 'number' THEN 'REAL' ELSE 'TEXT' END""",
)
_translate(
    "mssql",
    """CASE portable_type WHEN 'integer' THEN 'INT' WHEN 'bigint' THEN 'BIGINT' WHEN 'number' THEN 'FLOAT'
       WHEN 'boolean' THEN 'BIT' WHEN 'timestamp' THEN 'DATETIME2' WHEN 'json' THEN 'NVARCHAR(MAX)'
       WHEN 'uuid' THEN 'UNIQUEIDENTIFIER' ELSE CASE WHEN is_key THEN 'NVARCHAR(255)' ELSE 'NVARCHAR(MAX)' END END""",
)


@query(
    "coerce_for_target",
    """SELECT o_orderkey, CAST(o_totalprice > 200000 AS INTEGER) AS is_large,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS o_orderdate,
              '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS info
       FROM orders""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_totalprice") > 200000).alias("is_large"),
        "o_orderdate",
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("info"),
    )
    return projection.coerce_for_target(rows, "sqlite")


@query(
    "infer_value_types",
    """SELECT column_name, data_type, (SELECT count(*) FROM events) AS value_count FROM (VALUES
         ('event_id', 'integer'), ('ts', 'timestamp'), ('event_type', 'text'), ('value', 'double'),
         ('props', 'json'), ('is_error', 'boolean'), ('micros', 'bigint')) v(column_name, data_type)""",
)
def _(t):
    events = t.events.select(
        "event_id",
        "ts",
        "event_type",
        "value",
        "props",
        (F.col("event_type") == "error").alias("is_error"),
        (F.col("event_id") * 1000 + 1700000000000000).alias("micros"),
    )
    return projection.infer_value_types(
        events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])
    )


@query(
    "coerce_object_ids",
    """SELECT _id, p_partkey, CASE WHEN length(_id) = 24 THEN lower(_id) ELSE _id END AS _id_text,
              length(_id) = 24 AS is_object_id FROM @id_docs""",
)
def _(t):
    return projection.coerce_object_ids(t.id_docs).select(
        "_id",
        "p_partkey",
        "_id_text",
        F.coalesce(F.octet_length("_id_bytes") == 12, F.lit(False)).alias("is_object_id"),
    )


# text forms


@query(
    "ts_norm",
    """SELECT event_id, ts AS from_stamp, ts AS from_text, date_trunc('millisecond', ts) AS from_millis,
              CAST(NULL AS TIMESTAMP) AS from_noise FROM events""",
)
def _(t):
    shapes = t.events.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("millis"),
        "event_type",
    )
    return shapes.select(
        "event_id",
        ts_norm(F.col("ts"), shapes.schema["ts"].dataType).alias("from_stamp"),
        ts_norm(F.col("iso"), shapes.schema["iso"].dataType).alias("from_text"),
        ts_norm(F.col("millis"), shapes.schema["millis"].dataType).alias("from_millis"),
        ts_norm(F.col("event_type"), shapes.schema["event_type"].dataType).alias("from_noise"),
    )


@query(
    "token_text",
    """SELECT o_orderkey, coalesce(o_orderpriority, '') AS priority_text,
              coalesce(CAST(o_custkey AS VARCHAR), '') AS customer_text,
              regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price_text,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS date_text FROM @sparse_orders""",
)
def _(t):
    rows = t.sparse_orders

    def text(name):
        return plain_text(F.col(name), rows.schema[name].dataType)

    return rows.select(
        "o_orderkey",
        text("o_orderpriority").alias("priority_text"),
        text("o_custkey").alias("customer_text"),
        text("o_totalprice").alias("price_text"),
        text("o_orderdate").alias("date_text"),
    )


@query(
    "sql_literal",
    """SELECT doc_id, '''' || replace(text, '''', '''''') || '''' AS text_literal,
              '''' || replace(replace(text, '''', ''''''), '\\', '\\\\') || '''' AS mysql_literal,
              CAST(n_chars AS VARCHAR) AS number_literal,
              CASE WHEN n_chars > 1000 THEN 'TRUE' ELSE 'FALSE' END AS bool_literal,
              'X''' || lower(hex(encode(lang))) || '''' AS bytes_literal FROM documents""",
)
def _(t):
    rows = t.documents.select(
        "doc_id",
        "text",
        "n_chars",
        (F.col("n_chars") > 1000).alias("is_long"),
        F.encode("lang", "UTF-8").alias("raw"),
    )

    def literal(name, dialect):
        return sql_literal(F.col(name), rows.schema[name].dataType, dialect)

    return rows.select(
        "doc_id",
        literal("text", "postgres").alias("text_literal"),
        literal("text", "mysql").alias("mysql_literal"),
        literal("n_chars", "sqlite").alias("number_literal"),
        literal("is_long", "postgres").alias("bool_literal"),
        literal("raw", "sqlite").alias("bytes_literal"),
    )


@query(
    "csv_cell",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\\n\\r]')
              THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM conversations""",
)
def _(t):
    rows = t.conversations
    return rows.select("conv_id", "turn", csv_cell(F.col("text"), rows.schema["text"].dataType).alias("cell"))


@query(
    "bytes_tag",
    """SELECT doc_id, '{"$bytes":"' || base64(encode(text)) || '"}' AS tagged, text AS restored FROM documents""",
)
def _(t):
    tagged = bytes_tag(F.encode("text", "UTF-8"))
    rows = t.documents.select("doc_id", tagged.alias("tagged"))
    return rows.select("doc_id", "tagged", F.decode(bytes_untag(F.col("tagged")), "UTF-8").alias("restored"))


@query(
    "quote_ident",
    """SELECT page_id, '"' || replace(url || '"', '"', '""') || '"' AS ansi, '`' || replace(url || '"', '`', '``') || '`' AS mysql
       FROM pages""",
)
def _(t):
    name = F.concat("url", F.lit('"'))
    return t.pages.select(
        "page_id", quote_ident(name, "postgres").alias("ansi"), quote_ident(name, "mysql").alias("mysql")
    )


@query(
    "safe_ident_check",
    """SELECT p_partkey, name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*') AS is_safe FROM
       (SELECT ordinal AS p_partkey, name FROM @column_defs)""",
)
def _(t):
    return t.column_defs.select(
        F.col("ordinal").alias("p_partkey"), "name", is_safe_name(F.col("name")).alias("is_safe")
    )


@query(
    "safe_default_check",
    """SELECT ordinal, default_value,
              coalesce(regexp_full_match(default_value, '-?\\d+(\\.\\d+)?')
                OR regexp_full_match(default_value, '''([^''\\\\]|'''')*''')
                OR lower(default_value) IN ('current_timestamp', 'now()'), true) AS is_safe
       FROM @column_defs""",
)
def _(t):
    return t.column_defs.select(
        "ordinal", "default_value", is_safe_default(F.col("default_value")).alias("is_safe")
    )


@query(
    "glob_to_regex",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://.*\\.example\\.com/.*$')",
)
def _(t):
    from rowferry.functions.predicates import matches_glob

    url = F.col("url")
    matched = matches_glob(url, "http://*.example.com/*") | matches_glob(url, "http?://*.example.com/*")
    return t.pages.where(matched).select("page_id", "url")


@query(
    "zset_pairs",
    """SELECT 'rank:' || (c_custkey // 64) AS key, CAST(c_custkey AS VARCHAR) AS member,
              CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) AS score FROM customer""",
)
def _(t):
    ranks = t.keyspace.where("type = 'zset'")
    return ranks.select("key", F.explode(zset_pairs(list_members(F.col("value")))).alias("p")).select(
        "key", "p.member", "p.score"
    )


@query("row_key", """SELECT c_custkey, '[' || c_custkey || ',"' || c_name || '"]' AS row_key,
                            '["' || c_mktsegment || '","' || c_name || '",' || c_custkey || ']' AS other_key
                     FROM customer""")
def _(t):
    schema = t.customer.schema
    return t.customer.select(
        "c_custkey",
        row_key(schema, ["c_custkey", "c_name"]).alias("row_key"),
        row_key(schema, ["c_mktsegment", "c_name", "c_custkey"]).alias("other_key"),
    )
