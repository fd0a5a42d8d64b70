"""A hash-tree manifest of a table: one tree per group, one more over the groups.

Every row is a leaf. The leaves of a group, in the order of their key, are
joined in runs of three to the digest of the run, and so on until one digest is
left; these digests, in the order of the groups, go up in the same way.

A node's place in its group is a distributed row number. Nodes are cut into
blocks of FAN ** LEVELS places, and a window over a block climbs LEVELS levels:
the digest of a node is held by the row of its first leaf, so on level k a
node's neighbours are FAN ** k rows away, and lag and lead by that offset,
masked by the slot of the node in its run and by the length of the run, give
its siblings. The rows of first children hash the parent. The blocks' digests
are the nodes of the next pass, so a group of any size takes a few passes and
no window ever holds more than a block.

Rows with a null key come first, rows with equal keys are ordered by their
digest. Null is a group of its own, before all others. An empty table has an
empty manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.config import Sort
from rowferry.llm.shared import Workspace
from rowferry.operators.row_index import row_index_sequence
from rowferry.operators.skew import group_for_join

FAN = 3
LEVELS = 6
BLOCK = FAN**LEVELS
# groups whose counts go to every task; with more, rows and counts are joined by a shuffle
BROADCAST_GROUPS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The digest at the top, from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings on a way, level by level, each level from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def climb_block(nodes: DataFrame) -> DataFrame:
    """Adds the path of each node up to the top of its block; `digest` of a block's first row becomes the block's.

    nodes: group, place (0-based, dense), total (nodes of the group), digest.
    """
    # named, or windows would stay where a join by the group alone has put the rows
    rows = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).repartition("group", "block")
    block = Window.partitionBy("group", "block").orderBy("place")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        width = FAN**level
        number, size = F.expr(f"place div {width}"), F.expr(f"(total + {width - 1}) div {width}")
        slot = number % FAN
        run = F.least(F.lit(FAN), size - (number - slot))
        open_ = (F.col("place") % width == 0) & (size > 1)
        left = [F.when(slot >= k, F.lag("digest", k * width).over(block)).otherwise("") for k in range(FAN - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("digest", k * width).over(block)).otherwise("") for k in range(1, FAN)]
        rows = rows.withColumn("_step", F.when(open_, F.struct(F.concat(*left).alias("before"), F.concat(*right).alias("after"))))
        rows = rows.withColumns({
            f"_step{level}": F.last("_step", True).over(so_far),
            "digest": F.when(open_ & (slot == 0), F.sha2(F.concat("digest", "_step.after"), 256)).otherwise(F.col("digest")),
        })
    steps = [F.col(f"_step{level}") for level in range(LEVELS)]
    return rows.withColumn("path", F.filter(F.array(*steps), lambda s: s.isNotNull())).drop("_step", *[f"_step{level}" for level in range(LEVELS)])


def climb(space: Workspace, nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with the path inside their block, the path of each block from there on, the top digest of each group)."""
    first = rows = space.keep(climb_block(nodes), label)
    passes, tops = [], []
    while True:
        heads = rows.filter(f"place % {BLOCK} = 0").select("group", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), "digest")
        tops.append(heads.filter("total = 1").select("group", "digest"))
        heads = heads.filter("total > 1")
        if not heads.limit(1).count():
            break
        rows = space.keep(climb_block(heads), label)
        passes.append(rows)
    above = None
    for rows in reversed(passes):
        path = F.col("path")
        if above is not None:
            rows, path = rows.join(above, ["group", "block"], "left"), F.concat("path", F.coalesce("upper", F.array().cast(PATH)))
        above = rows.select("group", F.col("place").alias("block"), path.alias("upper"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    if above is None:
        above = first.filter("false").select("group", "block", F.col("path").alias("upper"))
    return first, above, top


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, **carried: Column) -> DataFrame:
    """key, leaf, subroot, root and path of every row, and the carried columns.

    `path` has the siblings before and after the row's node on each level, from
    the leaves up. Carried columns are computed with the leaves.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    # null sorts before every name
    leaves = docs.select(
        docs[key].alias("key"),
        F.when(docs[group].isNull(), "").otherwise(F.concat(F.lit("+"), docs[group].cast("string"))).alias("group"),
        digest(*[docs[f] for f in fields]).alias("leaf"),
        *[c.alias(name) for name, c in carried.items()],
    )
    numbered = row_index_sequence(leaves, [Sort("group"), Sort("key"), Sort("leaf")], index="row").drop("sequence")
    counts = space.keep(group_for_join(numbered, {"group": F.col("group")}, F.min("row").alias("first"), F.count("*").alias("total")), "groups")
    if counts.count() <= BROADCAST_GROUPS:
        counts = F.broadcast(counts)
    nodes = numbered.join(counts, "group").withColumn("place", F.col("row") - F.col("first")).withColumn("digest", F.col("leaf")).drop("row", "first")
    rows, above, tops = climb(space, nodes, "merkle")

    tops = space.keep(tops, "subroots")
    ranked = row_index_sequence(tops, [Sort("group")], index="place").drop("sequence")
    upper = ranked.select(F.lit("").alias("group"), "place", F.lit(tops.count()).cast("long").alias("total"), "digest", F.col("digest").alias("subroot"), F.col("group").alias("name"))
    groups, over, last = climb(space, upper, "merkle-top")
    root = last.select("digest").first()
    groups = groups.join(over, ["group", "block"], "left").select(
        F.col("name").alias("group"), "subroot", F.concat("path", F.coalesce("upper", F.array().cast(PATH))).alias("top")
    )
    # what all rows of a block share, so that the rows are joined once
    blocks = rows.filter(f"place % {BLOCK} = 0").select("group", "block").join(above, ["group", "block"], "left").join(groups, "group")
    blocks = blocks.select("group", "block", "subroot", F.concat(F.coalesce("upper", F.array().cast(PATH)), "top").alias("rest"))
    return rows.join(blocks, ["group", "block"]).select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        F.concat("path", "rest").alias("path"), *carried,
    )


def report(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """Manifest digests of every row, and whether the row as it stands after tampering folds to the root.

    Tampering takes the line feeds out of the text of rows whose key has an
    even crc32; a null key or text is left alone.
    """
    altered = [F.replace(docs[f], F.lit("\n"), F.lit("")) if f == text else docs[f] for f in fields]
    hit = F.crc32(docs[key].cast("string").cast("binary")) % 2 == 0
    rows = manifest(docs, key, group, fields, altered=F.when(hit, digest(*altered)))
    found = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return found.select(
        key, "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
