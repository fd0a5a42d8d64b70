"""URL filter: fixed rules by host and path, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs (one 512-bit block per URL, so one
cache line per probe) lets possible hits pass to an exact hash join, which
removes the false ones; the rest never leaves its task. The filter has a fixed
number of blocks: a longer list makes more rows pass to the join, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.operators.skew import keys_for_join

BLOCKS = 1 << 15  # of 512 bits: 2 MB
PROBES = 6


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, from a path prefix on."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def fold_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end; A-Z folded; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return fold_ascii(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host/path without www. or m., closing slashes and page suffix; empty without a host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(bare, place))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the fitting rule with the longest text, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        out = F.when(fits & path.startswith(rule.path), F.lit(rule.name)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


def places(url: Column, blocks: int = BLOCKS) -> tuple[Column, Column]:
    """The block of a URL, and a second hash that gives the bits in it."""
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(blocks)).cast("int"), F.xxhash64(url, F.lit(2))


def bits_of(second: Column) -> list[Column]:
    """PROBES places of 0 to 511, nine bits of the hash each."""
    return [F.shiftrightunsigned(second, 9 * k).bitwiseAND(511).cast("int") for k in range(PROBES)]


def build_filter(listed: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """The bit array (blocks x 8 words of 64 bits) of the `url` column.

    Spark ORs the bits of each word; at most blocks x 8 rows of fixed width
    reach the driver, whatever the length of the list.
    """
    block, second = places(F.col("url"), blocks)
    bit = F.explode(F.array(*bits_of(second)))
    words = listed.select(block.alias("block"), bit.alias("bit")).groupBy(
        (F.col("block") * 8 + F.shiftright("bit", 6)).alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).toPandas()
    table = np.zeros(blocks * 8, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def probe(listed: DataFrame, rows: DataFrame, url: str, blocks: int = BLOCKS) -> Column:
    """A boolean column of `rows`: whether the filter may hold the URL."""
    shared = rows.sparkSession.sparkContext.broadcast(build_filter(listed, blocks))

    @F.pandas_udf("boolean")
    def passes(block: pd.Series, second: pd.Series) -> pd.Series:
        table = shared.value
        first = block.to_numpy().astype(np.int64) * 8
        value = second.to_numpy().astype(np.int64).view(np.uint64)
        hit = np.ones(len(first), bool)
        for k in range(PROBES):
            bit = (value >> np.uint64(9 * k) & np.uint64(511)).astype(np.int64)
            hit &= (table[first + (bit >> 6)] >> (bit & 63) & 1).astype(bool)
        return pd.Series(hit)

    return passes(*places(F.col(url), blocks))


def judge(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url",
    listed_url: str = "url", blocks: int = BLOCKS,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A rule decides where one fits; else a row is blocked if its canonical URL is
    in `listed` (canonical URLs, repeats and nulls allowed). Null URLs and those
    without :// have an empty host and path and are allowed. Rows that are equal
    are judged each. Only key and URL are read from `pages`.
    """
    known = listed.select(listed[listed_url].alias("url")).filter("url IS NOT NULL AND url <> ''").distinct()
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "canon", F.when(F.col("rule").isNull(), canonical(F.col("host"), F.col("path"))).otherwise("")
    )
    rows = rows.withColumn("maybe", (F.col("canon") != "") & probe(known, rows, "canon", blocks))
    # only possible hits are shuffled; a URL that many pages share stays divisible
    passed = rows.filter("maybe").join(keys_for_join(known, ["url"]).select(F.col("url").alias("canon"), F.lit(True).alias("hit")), "canon", "left")
    hits = passed.unionByName(rows.filter("NOT maybe").withColumn("hit", F.lit(False)))
    by_rule = verdict_of(F.col("rule"), rules)
    return hits.select(
        "page_id", "host", "path", "rule",
        F.coalesce(by_rule, F.when(F.col("hit"), F.lit("block")).otherwise("allow")).alias("verdict"),
    )
