"""Intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# bits of the bitmap of wanted ids, broadcast
PLACES = 1 << 26


class Workspace:
    """Tables written once to the shared folder and removed when no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write and read back: cuts the lineage and survives lost executors.

        Nothing runs `df` again, so its shuffle files go once it is written.
        """
        path = scratch_path(self.spark, label)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: DataFrame) -> None:
        """Remove all tables but those that `keep` reads."""
        used = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        for path in list(self.paths):
            if not any(u.endswith(path.split("://")[-1].lstrip("/")) for u in used):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)
                self.paths.remove(path)


def maybe_among(data: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the ids (one column of whole numbers), and all others.

    A bitmap of the hashed ids, of 8 MB at most, is broadcast: every row that has
    one of the ids is in the first part, with few others, so that a join of it
    shuffles little else. A semi or anti join would be moved below the bitmap.
    """
    marks, name = "_marks", ids.columns[0]
    while marks in data.columns:
        marks = f"_{marks}"
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(PLACES))
    bits = ids.groupBy(F.bitmap_bucket_number(place(F.col(name))).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col(name)))).alias("bits"))
    bits = bits.select(F.struct("bucket", "bits").alias(marks))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substr(F.col(f"{marks}.bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.getbit(byte, (bit % 8).cast("int")) == 1
    both = lambda how: data.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col(f"{marks}.bucket"), how)
    some, rest = both("inner").filter(held), both("left").filter(F.col(marks).isNull() | ~held)
    return some.select(*data.columns), rest.select(*data.columns)


def components(space: Workspace, links: DataFrame) -> DataFrame:
    """(doc, comp) for every doc in `links` (a, b): the smallest doc it reaches.

    Alternates large-star and small-star rounds: every node hands its least
    neighbour to its other neighbours until only stars are left. Each round
    reduces per node on the map side, and a node with many links is a join key
    that Spark may split. The only thing on the driver is one count per round.
    """
    edges = space.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", F.least("k.u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lower = large.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", "m")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            lower.select("u", F.col("m").alias("v"))
        ).distinct()
        after = space.keep(small, "stars")
        # stars alone: no node is both a leaf and a centre, and no leaf has two centres
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        open_ = leaves.filter("n > 1").limit(1).count() or after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        edges = after
        if not open_:
            break
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("doc"), F.col("v").alias("comp")).distinct()
    )
