"""The first rows of a total order, without one task that sees all candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Candidates that one task may merge; beyond it they are merged in two levels.
MERGED_ROWS = 2_000_000
GROUPS = 64


def _scan_tasks(df: DataFrame) -> int:
    """Scan tasks as estimated from the size of the optimized plan."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return size // (128 * 1024 * 1024) + 1


def top_rows(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows in order.

    Spark's own top-k lets every scan task send its ``count`` best rows to one
    task. With very many tasks the candidates are first merged in groups of
    tasks; ``WindowGroupLimit`` still cuts each task's part before the shuffle.
    Spark leaves that cut out from a set count on, where the groups would shuffle
    all rows, so larger counts keep to the top-k.
    """
    cut = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if count >= cut or _scan_tasks(df) * count <= MERGED_ROWS:
        return df.orderBy(*order).limit(count)
    group = F.spark_partition_id() % GROUPS
    within = Window.partitionBy("_group").orderBy(*order)
    candidates = (
        df.withColumn("_group", group)
        .withColumn("_rank", F.row_number().over(within))
        .where(F.col("_rank") <= count)
        .drop("_group", "_rank")
    )
    return candidates.orderBy(*order).limit(count)
