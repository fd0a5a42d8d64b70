"""Row index, pages, counts, key ranges and scans."""

import pytest
from pyspark.sql import functions as F

from rowferry.config import ColumnMapping, Filter, Sort
from rowferry.operators import paging, top
from rowferry.operators.counts import analyzed_count, count_estimated, key_candidates, table_stats
from rowferry.operators.ddl import drop_table, save_table
from rowferry.operators.projection import coerce_object_ids, infer_value_types, map_columns
from rowferry.operators.row_index import row_index_sequence
from rowferry.sources.documents import document_fields, find_documents, scan_documents, search_documents
from rowferry.sources.keyspace import scan_keyspace, zset_pairs
from rowferry.functions.predicates import apply_filters
from rowferry.session import freeze
from rowferry.sources.relational import key_cuts, key_ranges, range_predicates, scan_query


def test_row_index_has_no_gaps_with_a_hot_sort_value(spark):
    """A third of the rows share one sort value; the index is still whole and even."""
    df = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("v"), F.col("id").alias("k")
    )
    indexed = row_index_sequence(df, [Sort("v", "desc")], ["k"], batch_size=7)
    got = [tuple(r) for r in indexed.orderBy("row_index").select("v", "k", "row_index", "sequence").collect()]
    wanted = sorted(((r["v"], r["k"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert got == [(v, k, i, i // 7) for i, (v, k) in enumerate(wanted)]


def test_row_index_of_nothing_and_without_order(spark):
    empty = spark.range(0)
    assert row_index_sequence(empty, keys=["id"]).count() == 0
    with pytest.raises(ValueError, match="sort or a primary key"):
        row_index_sequence(spark.range(3))


def test_null_order_is_explicit(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id int, s string")
    up = [r["id"] for r in paging.sort_rows(df, [Sort("s")]).collect()]
    down = [r["id"] for r in paging.sort_rows(df, [Sort("s", "desc")]).collect()]
    assert up == [1, 3, 2] and down == [2, 3, 1]


def test_pages_cover_the_table_once(spark, monkeypatch):
    df = spark.range(95)
    for deep in (100_000, 30):  # top-k pages, then pages cut from the row index
        monkeypatch.setattr(paging, "DEEP_PAGE_ROWS", deep)
        seen, offset = [], 0
        while True:
            page = paging.page_offset(df, [Sort("id", "desc")], ["id"], 40, offset).collect()
            seen += [r["id"] for r in page]
            if not page or not page[0]["has_more"]:
                break
            offset += 40
        assert seen == list(range(94, -1, -1))


def test_top_rows_merged_in_groups(spark, monkeypatch):
    df = spark.range(20_000, numPartitions=7).select((F.col("id") * 7919 % 20_011).alias("k"))
    plain = [r["k"] for r in top.top_rows(df, [F.desc("k")], 300).collect()]
    monkeypatch.setattr(top, "MERGED_ROWS", 10)
    grouped = top.top_rows(df, [F.desc("k")], 300)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in grouped.collect()] == plain == sorted(plain, reverse=True)
    assert plan.index("WindowGroupLimit") < plan.index("hashpartitioning(_group")


def test_top_rows_never_shuffle_all_rows(spark, monkeypatch):
    monkeypatch.setattr(top, "MERGED_ROWS", 10)
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    try:
        page = top.top_rows(spark.range(20_000, numPartitions=7), [F.desc("id")], 5001)
        assert "Exchange hashpartitioning" not in page._jdf.queryExecution().executedPlan().toString()
        assert [r["id"] for r in page.collect()] == list(range(19_999, 14_998, -1))
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)


def test_page_bounds_are_clamped_and_checked():
    assert paging.page_bounds(0, 0) == (1, 0)
    assert paging.page_bounds(10**6, 3) == (10**6, 3)
    assert paging.page_bounds(10**6, 3, "sql") == (5000, 3)
    assert paging.page_bounds(10**6, 0, "document") == (1000, 0)
    assert paging.page_bounds(10**6, 0, "keyspace") == (500, 0)
    for limit, offset in ((-1, 0), (1, -1), (1.5, 0)):
        with pytest.raises(ValueError):
            paging.page_bounds(limit, offset)


def test_keyset_pages_of_a_composite_key(spark, rows):
    df = spark.createDataFrame([(a, b) for a in range(6) for b in "xyz"], "a int, b string")
    seen, last = [], None
    while page := paging.page_keyset(df, ["a", "b"], last, 4).collect():
        seen += [tuple(r) for r in page]
        last = list(page[-1])
    assert seen == rows(df)


def test_keyset_bound_reaches_the_scan(tables):
    plan = paging.page_keyset(tables.orders, ["o_orderkey"], [700])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,700)" in plan and "TakeOrderedAndProject" in plan


def test_order_of_a_copy():
    assert paging.resolve_order([], ["id"]) == ([Sort("id")], True)
    assert paging.resolve_order([Sort("id", "desc")], ["id"])[1] is False
    assert paging.resolve_order([], ["a", "b"])[1] is False
    assert paging.resolve_order([Sort("x")], ["id"]) == ([Sort("x")], False)
    with pytest.raises(ValueError, match="primary key"):
        paging.resolve_order([], [])


def test_preview_limits(spark, rows):
    df = spark.range(20)
    assert rows(paging.preview_rows(df, [ColumnMapping("id", "n")], 2, ["id"])) == [(0,), (1,)]
    for limit in (0, 11):
        with pytest.raises(ValueError):
            paging.preview_rows(df, limit=limit)


def test_a_given_page_length_holds(spark):
    df = spark.range(7000)
    for limit, more in ((5001, True), (6999, True), (7000, False)):
        page = paging.page_offset(df, [Sort("id")], ["id"], limit)
        assert page.count() == limit and {r.has_more for r in page.collect()} == {more}
    page, _ = paging.browse(df, (), [Sort("id")], ["id"], 6000)
    assert page.count() == 5000 and page.first().has_more


def test_browse_totals(spark):
    df = spark.range(50)
    page, total = paging.browse(df, [Filter("id", "lt", 5)], [Sort("id")], ["id"], 3)
    assert page.count() == 3 and total.first()[:] == (5, False)
    assert paging.browse(df, (), [Sort("id")], ["id"])[1].first()[:] == (50, True)
    assert count_estimated(df, [Filter("id", "lt", 5)]).first()["total"] is None


def test_estimate_reads_no_column(tables):
    plan = count_estimated(tables.lineitem)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_catalog_statistics(spark):
    save_table(spark.range(12), "stats_probe")
    assert analyzed_count(spark.range(0), "stats_probe") is None
    spark.sql("ANALYZE TABLE stats_probe COMPUTE STATISTICS")
    assert analyzed_count(spark.range(0), "stats_probe") == 12
    drop_table(spark, "stats_probe")


def test_key_candidates_of_nothing_and_nulls(spark):
    assert key_candidates(spark.range(0), ["id"]).first()[:] == (0, 0, 0, True)
    df = spark.createDataFrame([(1,), (None,)], "id int")
    assert key_candidates(df, ["id"]).first()[:] == (2, 2, 1, False)


def test_distinct_sketch_is_close(spark):
    found = {r["column_name"]: r for r in table_stats(spark.range(2000).withColumn("n", F.lit(None))).collect()}
    assert abs(found["id"]["approx_distinct"] - 2000) < 200 and found["n"]["null_count"] == 2000


@pytest.mark.parametrize(("low", "high", "parts"), [(0, 99, 4), (5, 5, 3), (-10, 10, 7), (0, 1, 16)])
def test_key_ranges_are_disjoint_and_whole(spark, low, high, parts):
    df = spark.range(low - 3, high + 4).withColumnRenamed("id", "k").unionByName(
        spark.createDataFrame([(None,)], "k bigint")
    )
    total = F.lit(0)
    for predicate in key_ranges("k", low, high, parts):
        total = total + F.when(F.expr(predicate), 1).otherwise(0)
    assert df.where(total != 1).count() == 0


def test_query_cap_is_flagged_or_refused(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert scan_query(spark, "SELECT * FROM ten WHERE id >= :low", {"low": 4}).count() == 6
    assert scan_query(spark, "SELECT * FROM ten", max_rows=10).first()["truncated"] is False
    assert scan_query(spark, "SELECT * FROM ten", max_rows=9).first()["truncated"] is True
    with pytest.raises(ValueError, match="more than 9"):
        scan_query(spark, "SELECT * FROM ten", max_rows=9, refuse_truncated=True)


DOCS = [
    (1, '{"_id": "a", "n": 1, "deep": {"x": 1}, "maybe": null}'),
    (2, '{"_id": "b", "n": 2.5, "list": [1, 2], "flag": true}'),
    (3, '{"_id": "c", "deep": {"y": "z"}, "maybe": "text"}'),
]


def test_documents_become_the_union_of_their_fields(spark, rows):
    df = spark.createDataFrame(DOCS, "at int, doc string")
    table = scan_documents(df, "doc")
    assert sorted(table.columns) == ["_id", "deep", "flag", "list", "maybe", "n"]
    assert rows(table, "_id", "maybe", "deep.y") == [("a", None, None), ("b", None, None), ("c", "text", "z")]
    types = {r["field"]: (r["data_type"], r["documents"]) for r in document_fields(df, "doc", ["at"]).collect()}
    assert types == {
        "_id": ("string", 3), "n": ("number", 2), "deep": ("object", 2),
        "maybe": ("null", 2), "list": ("array", 1), "flag": ("boolean", 1),
    }
    assert find_documents(table, [Filter("n", "isNull")]).count() == 1


def test_keyspace_preview_and_full_read(spark):
    numbers = "[" + ",".join(map(str, range(60))) + "]"
    rows = [("l", "list", -1, numbers), ("z", "zset", -1, numbers), ("s", "set", 5, numbers)]
    store = spark.createDataFrame(rows, "key string, type string, ttl bigint, value string")
    sizes = {r["key"]: len(r["value"].split(",")) for r in scan_keyspace(store).collect()}
    assert sizes == {"l": 25, "z": 50, "s": 60}
    assert all(len(r["value"].split(",")) == 60 for r in scan_keyspace(store, full=True).collect())
    assert [r["key"] for r in scan_keyspace(store, "?").collect()] == ["l", "z", "s"]


def test_zset_pairs_edges(spark):
    def pairs(items):
        df = spark.createDataFrame([(items,)], "v array<string>")
        return [tuple(p) for p in df.select(zset_pairs(F.col("v"))).first()[0]]

    assert pairs([]) == [] and pairs(["a"]) == []
    assert pairs(["a", "1", "b", "2.5", "c"]) == [("a", 1.0), ("b", 2.5)]


def test_mapping_and_ids(spark, rows):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert map_columns(df).columns == ["a", "b"]
    assert rows(map_columns(df, [ColumnMapping("a", "x"), ColumnMapping("gone", "y")])) == [(1, None)]
    ids = spark.createDataFrame([("0123456789abcdefABCDEF01",), ("short",)], "_id string")
    got = {r["_id"]: (r["_id_bytes"], r["_id_text"]) for r in coerce_object_ids(ids).collect()}
    assert len(got["0123456789abcdefABCDEF01"][0]) == 12
    assert got["short"] == (None, "short")


def test_value_types_look_at_every_value(spark):
    df = spark.createDataFrame([("1", "true", None), ("2x", "false", None)], "a string, b string, c string")
    types = {r["column_name"]: r["data_type"] for r in infer_value_types(df).collect()}
    assert types == {"a": "text", "b": "boolean", "c": "text"}


def test_document_types_by_path(spark):
    docs = [
        '{"n": 1, "mix": 1, "o": {"x": {"y": 1}, "OBJECT<q": null}, "a": [1, 2.5], "e": [], "v": null}',
        '{"n": 2.5, "mix": "t", "o": {"x": {"y": "2", "z: VOID": true}}, "a": [null], "ao": [{"k": 1}, {"l": "b"}]}',
        '{"mix": {"p": 1}, "a b": [[1], [2, 3]]}', "[1]", "broken", None,
    ]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    table = scan_documents(df, "doc")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    assert list(kinds) == sorted(kinds) and kinds["mix"] == "variant" and kinds["v"] == "string"
    assert kinds["a b"] == "array<array<bigint>>" and kinds["ao"] == "array<struct<k:bigint,l:string>>" and kinds["e"] == "array<string>"
    assert [f.name for f in table.schema["o"].dataType] == ["OBJECT<q", "x"]
    assert [f.name for f in table.schema["o"].dataType["x"].dataType] == ["y", "z: VOID"]
    found = table.select(F.col("o")["x"]["z: VOID"].alias("z"), "n").collect()
    assert sorted((str(r["z"]), str(r["n"])) for r in found if r["n"] is not None) == [("None", "1.0"), ("True", "2.5")]
    with pytest.raises(ValueError):
        scan_documents(spark.createDataFrame([("[]",)], "doc string"), "doc")


def test_filters_on_text_equal_a_plain_reading(spark):
    import json

    values = [1, 50, 50.5, 2**53 + 1, "50", "Magic", True, None, [1], {"a": 1}, -3]
    docs = [{"id": k, "f.x": v} for k, v in enumerate(values)] + [{"id": 99}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")

    def number(v):
        return isinstance(v, (int, float)) and not isinstance(v, bool)

    cases = [
        (Filter("f.x", "gte", 50), lambda v: number(v) and v >= 50),
        (Filter("f.x", "gt", 2**53), lambda v: number(v) and v > 2**53),
        (Filter("f.x", "lt", 50.2), lambda v: number(v) and v < 50.2),
        (Filter("f.x", "eq", "50"), lambda v: v == "50"),
        (Filter("f.x", "neq", 50), lambda v: not (number(v) and v == 50)),
        (Filter("f.x", "eq", True), lambda v: v is True),
        (Filter("f.x", "contains", "AGI"), lambda v: isinstance(v, str) and "agi" in v.lower()),
        (Filter("f.x", "isNull"), lambda v: v is None),
        (Filter("f.x", "neq", None), lambda v: v is not None),
        (Filter("f.x", "in", [1, "Magic", None]), lambda v: v is None or (number(v) and v == 1) or v == "Magic"),
        (Filter("f.x", "in", []), lambda v: False),
    ]
    for spec, holds in cases:
        found = search_documents(df, "doc", {"id": "bigint"}, [spec], [Sort("id")])
        assert [r["id"] for r in found.collect()] == [d["id"] for d in docs if holds(d.get("f.x"))], spec
    plan = search_documents(df, "doc", {"id": "bigint"}, [cases[0][0]], [Sort("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1


def test_long_lists_are_joined(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "c")], "n long, s string")
    numbers = list(range(2, 100_002))
    found = apply_filters(df, [Filter("n", "in", numbers)])
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(apply_filters(df, [Filter("n", "in", [2])])) == [(2, "b"), (2, None)]
    texts = [f"t{k}" for k in range(2000)] + ["a", None]
    assert rows(apply_filters(df, [Filter("s", "in", texts)])) == [(1, "a")]
    assert rows(apply_filters(df, [Filter("s", "in", texts)], "document")) == [(1, "a"), (2, None)]
    assert apply_filters(df, [Filter("n", "in", [])]).count() == 0
    assert apply_filters(df, [Filter("n", "in", [*numbers, 1.0])]).count() == 3


@pytest.mark.parametrize("expression", ["concat('k', chr(39), id)", "uuid()", "timestamp_seconds(id * id)::timestamp_ntz", "if(id % 3 = 0, null, id div 500)"])
def test_cuts_of_any_key(spark, expression):
    df = freeze(spark.range(5000).select(F.expr(expression).alias("a`k")), "keys")
    cuts = key_cuts(df, "a`k", 8)
    predicates = range_predicates("a`k", cuts, "`")
    held = [df.where(p).count() for p in predicates]
    assert sum(held) == 5000 and cuts == sorted(cuts)
    if "div" not in expression:
        assert len(held) == 8 and max(held) <= 2 * 5000 / 8
    assert key_cuts(df.limit(0), "a`k", 8) == [] and range_predicates("k", []) == ['"k" = "k" OR "k" IS NULL']


def test_a_capped_query_keeps_its_first_rows(spark, rows):
    spark.range(0, 5000, 1, 8).createOrReplaceTempView("many")
    found = scan_query(spark, "SELECT id FROM many ORDER BY id DESC", max_rows=700)
    assert sorted(r["id"] for r in found.collect()) == list(range(4300, 5000)) and found.where("truncated").count() == 700
