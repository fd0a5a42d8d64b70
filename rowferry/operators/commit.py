"""All-or-nothing publication of a target written by Spark jobs.

A target is a folder of parquet data plus one small marker file per version.
A marker says which data folders hold each key bucket, which log position has
been reached, which batches went in lately and where the spans of rows are that
each run has delivered. It is written in full
under another name and renamed without overwrite, so exactly one writer publishes a version, and readers see either
the old or the new version. Only the newest marker is ever read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.literals import named
from rowferry.operators.changes import Vector, element_wise_max
from rowferry.operators.merge import insert_rows
from rowferry.operators.progress import SPANS, merge_spans
from rowferry.session import shuffles_dropped

# what a write to a target may fail with; one target's failure leaves the others alone
WRITE_ERRORS = (ValueError, KeyError, RuntimeError, PySparkException, Py4JError)
BUCKET = "_bucket"
# Batches remembered for repeats; a stream repeats its latest batch only.
REMEMBERED_BATCHES = 1000


@dataclass(frozen=True)
class Version:
    number: int = 0
    layout: dict[str, list[str]] = field(default_factory=dict)
    position: list | None = None
    batches: list[str] = field(default_factory=list)
    delivered: str | None = None
    vector: Vector = field(default_factory=dict)


class SnapshotTable:
    """A versioned parquet target split into key buckets.

    ``buckets`` should give bucket sizes of a few gigabytes; a large bucket is
    still written by several tasks.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        buckets: int = 64,
    ) -> None:
        if not keys:
            raise ValueError("a target needs key columns")
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = list(keys)
        self.buckets = buckets

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # versions ----------------------------------------------------------------

    def _folder(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())  # noqa: SLF001

    def _names(self, folder: str) -> list[str]:
        path, fs = self._folder(folder)
        if not fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(path))

    def _marker(self, name: str) -> Version:
        path, fs = self._folder(f"_versions/{name}")
        stream = fs.open(path)
        try:
            io = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils  # noqa: SLF001
            return Version(**json.loads(io.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def version(self) -> Version:
        """The newest published version."""
        names = [n for n in self._names("_versions") if n.endswith(".json")]
        return self._marker(names[-1]) if names else Version()

    def _publish(self, version: Version) -> None:
        # complete under another name first: a reader never meets half a marker
        path, _ = self._folder(f"_versions/v{version.number:012d}.json")
        draft, fs = self._folder(f"_versions/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(version.__dict__, default=int).encode()))
        finally:
            stream.close()
        context = self.spark.sparkContext
        kind = context._jvm.org.apache.hadoop.fs.Options.Rename  # noqa: SLF001
        options = context._gateway.new_array(kind, 1)  # noqa: SLF001
        options[0] = kind.NONE
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(  # noqa: SLF001
            fs.getUri(), context._jsc.hadoopConfiguration()  # noqa: SLF001
        )
        try:
            files.rename(draft, path, options)
        except Exception as error:
            fs.delete(draft, False)
            if "exist" in str(error):
                raise RuntimeError(
                    "another writer published this version; run the batch again"
                ) from error
            raise

    # reading -----------------------------------------------------------------

    def read(self, version: Version | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """One version, the newest by default, or some of its buckets."""
        layout = (version or self.version()).layout
        chosen = [
            f"{self.path}/{folder}/{BUCKET}={bucket}"
            for bucket, folders in layout.items()
            if buckets is None or int(bucket) in buckets
            for folder in folders
        ]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def delivered(self, run_id: str | None = None, version: Version | None = None) -> DataFrame:
        """The spans of rows that a run, or each run, has delivered to this target."""
        folder = (version or self.version()).delivered
        if folder is None:
            return self.spark.createDataFrame([], SPANS)
        spans = self.spark.read.schema(SPANS).parquet(f"{self.path}/{folder}")
        return spans if run_id is None else spans.where(F.col("run_id") == run_id)

    # writing -----------------------------------------------------------------

    def reject(self, rows: DataFrame, batch_id: str) -> None:
        """Keep the rows of a batch that this target cannot take; a repeat replaces them."""
        if not rows.isEmpty():
            name = hashlib.sha256(batch_id.encode()).hexdigest()[:32]
            rows.write.mode("overwrite").parquet(f"{self.path}/_rejects/batch={name}")

    def rejects(self) -> DataFrame | None:
        """All rejected rows with the batch they came in, None if there are none."""
        folders = [f"{self.path}/_rejects/{n}" for n in self._names("_rejects")]
        reader = self.spark.read.option("basePath", f"{self.path}/_rejects").option("mergeSchema", True)
        return reader.parquet(*folders) if folders else None

    def apply(
        self,
        delta: DataFrame,
        merge: Callable[[DataFrame, DataFrame], DataFrame] | None,
        batch_id: str,
        position: Sequence[str] = (),
        spans: DataFrame | None = None,
        base: Version | None = None,
        vector: Vector | None = None,
    ) -> bool:
        """Merge a delta and publish; False when the batch went in before.

        Without ``merge`` the rows are added to their buckets, and nothing that
        is there is read or written again. ``spans`` are the rows of a run that
        the delta holds; they become part of the version. With ``base`` the
        delta was made for that version, and any other is refused.

        ``delta`` is evaluated more than once and must be stable (a frozen
        table). Only buckets with a key in it are read and rewritten; keys are
        unique in a target, so hashing them gives even buckets. ``position``
        names the columns of the log position (numbers or text), of which the
        highest is stored; ``vector`` has positions by log partition instead.
        """
        current = base or self.version()
        if batch_id in current.batches:
            return False
        reached = F.max(F.struct(*position)) if position else F.lit(None).cast("int")
        # one row per touched bucket comes to the driver
        touched = {
            row["bucket"]: row["reached"]
            for row in delta.groupBy(self.bucket_of().alias("bucket"))
            .agg(reached.alias("reached"))
            .collect()
        }
        layout = dict(current.layout)
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            merged = merge(self.read(current, list(touched)), delta) if merge else self._as_rows(delta)
            # a value that does not fit fails the batch here, not the readers later
            merged = merged.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
            # rebalancing puts a bucket in few files and splits a large one over tasks
            placed = merged.withColumn(BUCKET, self.bucket_of()).hint("rebalance", BUCKET)
            with shuffles_dropped(placed.sparkSession):
                placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            filled = self._names(folder)
            for bucket in touched:
                kept = [] if merge else layout.get(str(bucket), [])
                layout.pop(str(bucket), None)
                if kept or f"{BUCKET}={bucket}" in filled:
                    layout[str(bucket)] = [*kept, *([folder] if f"{BUCKET}={bucket}" in filled else [])]
        progress = current.delivered
        if spans is not None:
            progress = f"data/{uuid.uuid4().hex}"
            merge_spans(self.delivered(version=current).unionByName(spans)).write.parquet(f"{self.path}/{progress}")
        seen = [list(r) for r in touched.values() if r is not None]
        self._publish(
            Version(
                current.number + 1,
                layout,
                max([*seen, *([current.position] if current.position else [])], default=None),
                [*current.batches, batch_id][-REMEMBERED_BATCHES:],
                progress,
                element_wise_max(current.vector, vector or {}),
            )
        )
        return True

    def _as_rows(self, delta: DataFrame) -> DataFrame:
        """Rows in the columns of the target; those they lack are NULL."""
        return insert_rows(self.spark.createDataFrame([], self.schema), delta)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove data folders that the newest ``keep`` versions do not use.

        To be run while no writer is at work: its folder is in no version yet.
        """
        markers = [n for n in self._names("_versions") if n.endswith(".json")]
        held = [self._marker(name) for name in markers[-max(keep, 1) :]]
        used = {f for v in held for folders in v.layout.values() for f in folders} | {v.delivered for v in held}
        stale = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in used]
        for name in stale:
            path, fs = self._folder(name)
            fs.delete(path, True)
        for name in markers[: -max(keep, 1)]:
            path, fs = self._folder(f"_versions/{name}")
            fs.delete(path, False)
        return stale


def atomic_commit(
    table: SnapshotTable, rows: DataFrame, merge: Callable, batch_id: str
) -> bool:
    """Publish one batch of rows; a repeat of the batch is a no-op."""
    return table.apply(rows, merge, batch_id)
