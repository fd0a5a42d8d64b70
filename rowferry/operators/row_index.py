"""A stable 0-based row index over a total order, computed in parallel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.config import Sort
from rowferry.functions.literals import named
from rowferry.session import freeze, scratch_folder, shuffles_dropped

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in 33 bits
_RANGE = "_range"


def order_columns(sort: Sequence[Sort]):
    """Sort columns with the NULL order spelled out: first up, last down."""
    return [
        named(s.column).desc_nulls_last()
        if s.direction == "desc"
        else named(s.column).asc_nulls_first()
        for s in sort
    ]


def total_order(sort: Sequence[Sort], keys: Sequence[str]) -> list[Sort]:
    """The caller's sort made total by the key columns."""
    named = {s.column for s in sort}
    order = [*sort, *(Sort(key) for key in keys if key not in named)]
    if not order:
        raise ValueError("a sort or a primary key is needed to number rows")
    return order


def row_index_sequence(
    df: DataFrame,
    sort: Sequence[Sort] = (),
    keys: Sequence[str] = (),
    batch_size: int = 1,
    index: str = "row_index",
    sequence: str = "sequence",
) -> DataFrame:
    """Number the rows of ``df`` in a total order.

    Range partitioning on the whole order (keys included) keeps partitions even
    when one sort value covers a large part of the rows. The partition layout
    is written once, because range bounds come from a sample and could differ
    between evaluations. Each partition then needs only the row count of the
    partitions before it: one small row per partition.
    """
    order = order_columns(total_order(sort, keys))
    fixed = freeze(_in_slots(df, order), "row-index")
    part, within = _part_and_row()
    counts = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # one row per partition of the shuffle above: its size is bound by that setting
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(index, F.col("_offset") + within)
        .withColumn(sequence, F.expr(f"`{index}` div {int(batch_size)}"))
        .drop("_slot", "_part", "_offset")
    )


def _in_slots(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows dealt out and sorted by the whole order, with partition and row in ``_slot``."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("_slot", F.monotonically_increasing_id())


def _part_and_row() -> tuple[Column, Column]:
    return F.shiftright("_slot", _ROW_BITS).cast("int"), F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


@contextmanager
def numbered_ranges(
    df: DataFrame,
    ranges: Sequence[Column],
    place: Sequence[str],
    unique: bool = True,
    start: int = 0,
    index: str = "row_index",
) -> Iterator[tuple[DataFrame, int]]:
    """Rows numbered from ``start`` in the order of ``place``, and their count, for a block.

    ``ranges`` are conditions in ascending order of place, of which each row
    meets one. One range is dealt out at a time, so only its shuffle files lie
    beside the rows, which are written once and numbered as they are read.
    With ``unique`` one row of each place is kept.
    """
    spark, order = df.sparkSession, order_columns([Sort(c) for c in place])
    with scratch_folder(spark, "numbered") as path:
        for number, wanted in enumerate(ranges):
            rows = df.where(wanted)
            placed = _in_slots(rows.dropDuplicates(list(place)) if unique else rows, order)
            with shuffles_dropped(spark):
                placed.write.option("compression", "zstd").parquet(f"{path}/{_RANGE}={number}")
        fixed = spark.read.schema(T.StructType([*placed.schema, T.StructField(_RANGE, T.IntegerType())])).parquet(path)
        part, within = _part_and_row()
        # one row per partition and range comes to the driver
        counts = sorted(tuple(r) for r in fixed.groupBy(_RANGE, part.alias("_part")).count().collect())
        ends = list(accumulate((n for *_, n in counts), initial=start))
        offsets = spark.createDataFrame([(r, p, at) for (r, p, _), at in zip(counts, ends)], f"{_RANGE} int, _part int, _offset bigint")
        rows = (
            fixed.withColumn("_part", part)
            .join(F.broadcast(offsets), [_RANGE, "_part"])
            .withColumn(index, F.col("_offset") + within)
        )
        yield rows.drop("_slot", "_part", "_offset", _RANGE), ends[-1] - start
