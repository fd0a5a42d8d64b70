"""Times the headline queries and prints one JSON line.

Each query is drained into Spark's noop sink (no rows reach the driver), once
to warm up and then three times; the median counts. The same SQL runs on DuckDB
next to it for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import duckdb

from rowferry.plans import ORACLES, QUERIES
from rowferry.session import build_session

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
# query and the tables whose rows it reads, for rows per second
HEADLINE = {
    "scan_table": ("orders",),
    "filter_and": ("orders",),
    "filter_contains": ("part",),
    "map_columns": ("customer",),
    "page_offset": ("orders",),
    "sort_multi": ("orders",),
    "row_index_sequence": ("orders",),
    "count_exact": ("orders",),
    "key_candidates": ("orders", "lineitem", "conversations"),
    "upsert_rows": ("customer", "orders"),
    "upsert_partial": ("customer", "orders"),
    "delete_rows": ("customer", "orders"),
    "apply_changes": ("orders", "lineitem"),
    "apply_changes_append": ("orders", "lineitem"),
    "last_change_per_key": ("lineitem",),
    "dedupe_positions": ("lineitem",),
    "normalize_changes_mysql": ("lineitem",),
    "normalize_changes_pg": ("lineitem",),
    "watch_snapshot": ("orders",),
    "watch_timestamp": ("orders",),
    "exactly_once_replay": ("orders", "lineitem"),
    "replay_run": ("orders",),
    "cdc_apply_stream": ("orders", "lineitem"),
    "watch_converge": ("orders",),
    "find_documents": ("events",),
    "pending_deliveries": ("orders", "lineitem"),
    "run_progress": ("orders", "lineitem"),
    "record_deliveries": ("orders", "lineitem"),
    "render_row": ("customer",),
    "payload_outbox": ("orders",),
    "export_csv": ("documents",),
    "backup_sql": ("orders",),
    "restore_json": ("orders",),
    "scan_documents": ("events",),
    "check_constraints": ("lineitem",),
    "orphan_check": ("lineitem", "orders", "labels"),
    "fk_edges": ("lineitem",),
}


def median_seconds(run, repeats: int) -> float:
    times = []
    for _ in range(repeats):
        started = time.perf_counter()
        run()
        times.append(time.perf_counter() - started)
    return statistics.median(times)


def main() -> None:
    spark = build_session(
        "rowferry-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute(f"SET threads TO {CPUS}")
    sizes = {}
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIRECTORY}/{name}.parquet'")
        sizes[name] = con.execute(f"SELECT count(*) FROM {name}").fetchone()[0]
    seconds, duck, rates = {}, {}, {}
    for name, inputs in HEADLINE.items():
        build = QUERIES[name]

        def run(build=build):
            build(spark, DIRECTORY).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(median_seconds(run, REPEATS), 3)
        rates[name] = round(sum(sizes[t] for t in inputs) / seconds[name])
        sql = ORACLES[name]
        duck[name] = round(median_seconds(lambda: con.execute(sql).to_arrow_table(), 1), 3)
        print(f"{name}: {seconds[name]}s, DuckDB {duck[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "duckdb": duck,
                "sf": os.path.basename(DIRECTORY.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "settings": {"spark.sql.shuffle.partitions": CPUS, "repeats": REPEATS},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
