"""Compares registered queries with their SQL on DuckDB.

Run as a script: ``python tests/oracle.py DIRECTORY [query ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
SPARK_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, decimal.Decimal)):
        return (2, str(int(value)) if value == int(value) else str(value))
    if isinstance(value, float):
        return (3, repr(value))
    if isinstance(value, dt.datetime):
        return (4, value.isoformat())
    return (5, str(value))


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql: str, directory: str) -> list[str]:
    """Differences between a query and its SQL; an empty list means equal."""
    df = build(spark, directory)
    spark_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    problems = []
    left, right = _canonical(df.columns, spark_rows), _canonical(sql_columns, sql_rows)
    if left[0] != right[0]:
        return [f"columns {left[0]} against {right[0]}"]
    for field in df.schema.fields:
        wanted = SPARK_KINDS.get(field.dataType.simpleString(), "?")
        if wanted != sql_types[field.name]:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} against {sql_types[field.name]}")
    if len(left[1]) != len(right[1]):
        problems.append(f"{len(left[1])} rows against {len(right[1])}")
    if left[1] != right[1]:
        only_left = set(left[1]) - set(right[1])
        only_right = set(right[1]) - set(left[1])
        problems.append(
            f"values differ: {len(only_left)} only in Spark {sorted(only_left)[:2]}, "
            f"{len(only_right)} only in SQL {sorted(only_right)[:2]}"
        )
    return problems


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from rowferry.session import build_session

    directory, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(directory), 0
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            if name in oracles:
                problems = compare(spark, con, build, oracles[name], directory)
            else:
                problems = [] if build(spark, directory).count() >= 0 else []
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{time.perf_counter() - started:7.2f}s {name}", flush=True)
        for problem in problems:
            print("      ", problem, flush=True)
    print(f"{bad} of {len(names) or len(entry.queries())} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
