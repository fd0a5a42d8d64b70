"""What a target has received of a run, as runs of row numbers.

A span is (run_id, first, last). Spans are few however many rows they stand
for: a finished copy is one span, and each row that was left out adds one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.operators.skew import group_for_join

SPANS = "run_id string, first bigint, last bigint"
# rows of a bucket, and how many buckets of one level make one of the next
WIDTH = 4096
LEVELS = 3


def _merge_within(spans: DataFrame, width: int) -> DataFrame:
    """Spans that touch or overlap become one, as far as they begin in the same bucket."""
    bucket = Window.partitionBy("run_id", "_bucket").orderBy("first", "last")
    before = bucket.rowsBetween(Window.unboundedPreceding, -1)
    so_far = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    marked = spans.withColumn("_bucket", F.floor(F.col("first") / width)).withColumn("_begins", begins.cast("int"))
    island = marked.withColumn("_island", F.sum("_begins").over(so_far))
    return island.groupBy("run_id", "_bucket", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("run_id", "first", "last")


def merge_spans(spans: DataFrame) -> DataFrame:
    """The same rows in as few spans as possible, bucket by bucket and then level by level.

    No window holds more than the spans that begin in one bucket; spans of
    different buckets of the last level stay apart, which changes no row.
    """
    for level in range(1, LEVELS + 1):
        spans = _merge_within(spans, WIDTH**level)
    return spans


def spans_of(rows: DataFrame, run_id: str, index: str = "row_index") -> DataFrame:
    """Spans of numbered rows, not yet merged.

    A bucket without a gap is told by its ends and its count, which are reduced
    on the map side; only the rows of the others are looked at one by one.
    """
    numbers = rows.select(F.col(index).cast("bigint").alias("first"), F.floor(F.col(index) / WIDTH).alias("_bucket"))
    buckets = group_for_join(
        numbers, {"_bucket": F.col("_bucket")}, F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("n")
    )
    whole = buckets.where("n = high - low + 1").select(F.col("low").alias("first"), F.col("high").alias("last"))
    ragged = numbers.join(buckets.where("n <> high - low + 1").select("_bucket"), "_bucket", "left_semi")
    named = whole.unionByName(ragged.select("first", F.col("first").alias("last")))
    return named.select(F.lit(run_id).alias("run_id"), "first", "last")


def outside_spans(rows: DataFrame, spans: DataFrame, index: str = "row_index") -> DataFrame:
    """The rows whose number lies in no span (first, last).

    Spans are laid over buckets: buckets that a span fills are joined by their
    number, the rest by the row number, so both joins are on equal keys with a
    unique side and no span is compared with rows far from it.
    """
    bucket = F.floor(F.col("first") / WIDTH)
    laid = (
        spans.select("first", "last", F.explode(F.sequence(bucket, F.floor(F.col("last") / WIDTH))).alias("_bucket"))
        .withColumn("_low", F.greatest("first", F.col("_bucket") * WIDTH))
        .withColumn("_high", F.least("last", F.col("_bucket") * WIDTH + (WIDTH - 1)))
    )
    full = F.col("_high") - F.col("_low") == WIDTH - 1
    filled = group_for_join(laid.where(full), {"_bucket": F.col("_bucket")})
    partly = laid.where(~full).select(F.explode(F.sequence("_low", "_high")).alias("_number"))
    partly = group_for_join(partly, {"_number": F.col("_number")})
    left = rows.withColumn("_bucket", F.floor(F.col(index) / WIDTH)).join(filled, "_bucket", "left_anti").drop("_bucket")
    return left.join(partly, left[index] == partly["_number"], "left_anti")
