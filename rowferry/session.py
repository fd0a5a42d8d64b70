"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ENGINE_SETTINGS = {
    # AQE re-plans joins from measured sizes: a delta becomes a broadcast side
    # only when its shuffled bytes are under the threshold, and a partition that
    # holds a hot key is split across tasks.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # pages of up to 10000 rows are cut on the map side
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
}


def sized_settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about ``shuffle_bytes``.

    Aims at 200 MB per shuffle partition and at least two tasks per core, so
    that a partition sorts in memory; AQE merges what turns out smaller.
    """
    parts = max(-(-shuffle_bytes // (200 * 1024 * 1024)), 2 * cores)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200m",
    }


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every job that the session runs in a block go when the job has ended.

    Otherwise they stay until the driver happens to collect its garbage. Each
    DataFrame in the block is to be run once; a second run would write them again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches that the session sends to Python by bytes from now on.

    By rows alone, 10000 texts go at once: tens of MB, held in the JVM's buffers
    and in every worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(
    app: str = "rowferry", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with the engine settings; ``settings`` override them.

    Without ``master`` the value given to spark-submit applies.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; a cluster has to name a
    folder that every executor reaches.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="rowferry-")
    return _LOCAL_ROOTS[application]


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/rowferry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, location: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(location)  # noqa: SLF001
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has frozen; frozen tables are gone then."""
    _remove(spark, _scratch_root(spark))


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so later stages see one fixed row set even if executors
    are lost, and keeps column pruning for every reader.
    """
    return _freeze_at(df, scratch_path(df.sparkSession, label))


def _freeze_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A fresh path that is removed with all its files after the block."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        _remove(spark, path)


@contextmanager
def frozen(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """:func:`freeze` for the length of a block; the copy is removed afterwards."""
    with scratch_folder(df.sparkSession, label) as path:
        with shuffles_dropped(df.sparkSession):
            copy = _freeze_at(df, path)
        yield copy
