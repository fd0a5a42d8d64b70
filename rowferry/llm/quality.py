"""Line-first quality rules, in DataFrame functions alone.

Each line is judged by punctuation rules (marks without letters, too many symbols,
teasers that break off), navigation rules (bars of links, menus of short lines
without closing punctuation) and boilerplate phrases. Failing lines are removed,
and a document that loses too much of its text is rejected. On top stand base
figures of the whole text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.columns import pair

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# fixed values: phrases of site furniture, matched in lower case
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here to subscribe", "cookie policy", "enable javascript",
    "powered by", "privacy policy", "share this article", "share this page", "sign up for our newsletter",
    "skip to content", "skip to main content", "terms of service", "terms of use",
)
# signs between the links of a bar
SEPARATORS = r"[|•·»›]|\x20[/>]\x20"
LETTER = r"[\p{L}\p{N}]"
ENDING = r"[\x20\x09\x0D]*\z"
TEASER = r"(?:\.\.\.|…)[\])]?" + ENDING
# a line of few words; list items start with a sign or number, sentences and verse end with a mark
FEW_WORDS = r"^[\x20\x09]*[^\x20\x09-\x0D0-9*•-][^\x20\x09-\x0D]*(?:[\x20\x09]+[^\x20\x09-\x0D]+){0,2}" + ENDING
CLOSED = r"[.!?:;,…。！？、，：；\"'”’»)\]]" + ENDING
MAX_LINE_SYMBOLS = 0.3
MIN_BARS = 3
MAX_TEASER = 100  # characters
MAX_MENU = 40  # characters
MENU_RUN = 4  # lines
MAX_LOST = 0.6


def bind(value: Column, use) -> Column:
    """use(value), with `value` computed once however often lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more.

    Windows are sorted by their three words' hash and checked against both
    neighbours; the places of equal ones, in order, count up to three words each.
    """

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) >= 4, F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def windows(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def doubled(s: Column) -> Column:
        return F.array_sort(F.transform(
            F.filter(s, lambda x, n: ((n > 0) & (F.get(s, n - 1)["h"] == x["h"])) | F.coalesce(F.get(s, n + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        ))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            places, start,
            lambda seen, i: F.struct((seen["n"] + F.least(F.lit(3), i - seen["last"])).cast("long").alias("n"), i.alias("last")),
            lambda seen: seen["n"],
        )

    # most texts hold no window twice, and a set of hashes tells so
    return bind(bind(words, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
        covered(bind(windows(h), doubled))
    ))


def symbols_of(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))


def boilerplate(text: Column) -> Column:
    """Whether the text has one of the phrases, in either case."""
    return bind(F.lower(text), lambda low: reduce(or_, [low.contains(p) for p in BOILERPLATE]))


def fails(line: Column, text: Column) -> Column:
    """Whether a line is furniture by itself; `text` tells what the whole text holds."""
    return (
        (text["symbols"] & (symbols_of(line) > MAX_LINE_SYMBOLS * F.length(line)))
        | (text["bars"] & (F.regexp_count(line, F.lit(SEPARATORS)) >= MIN_BARS))
        | (text["phrase"] & boilerplate(line))
        | (line.rlike(r"[^\x20\x09-\x0D]") & ~line.rlike(LETTER))
        | ((F.length(line) <= MAX_TEASER) & line.rlike(TEASER))
    )


def menus(lines: Column) -> Column:
    """For each line, whether it lies in `MENU_RUN` or more successive lines that look like a menu's.

    Such a line has one to three words and no closing punctuation, and is no list
    item. Null if there are too few of them.
    """
    short = F.transform(lines, lambda x: (F.length(x) <= MAX_MENU) & x.rlike(FEW_WORDS) & ~x.rlike(CLOSED))

    def runs(flags: Column) -> Column:
        return F.transform(flags, lambda f, i: reduce(and_, [F.coalesce(F.get(flags, i + k), F.lit(False)) for k in range(1, MENU_RUN)], f))

    def spread(starts: Column) -> Column:
        return F.transform(starts, lambda f, i: reduce(or_, [F.coalesce(F.get(starts, i - k), F.lit(False)) for k in range(1, MENU_RUN)], f))

    return bind(short, lambda f: F.when(F.size(F.filter(f, lambda x: x)) >= MENU_RUN, bind(runs(f), spread)))


def clean_lines(text: Column) -> Column:
    """The text without failing lines."""
    lines = F.split(text, "\n")
    whole = F.struct(
        text.rlike(SYMBOLS).alias("symbols"), text.rlike(SEPARATORS).alias("bars"), boilerplate(text).alias("phrase"), lines.alias("lines"), menus(lines).alias("menus")
    )
    return bind(whole, lambda t: F.array_join(F.filter(t["lines"], lambda line, i: ~(F.coalesce(F.get(t["menus"], i), F.lit(False)) | fails(line, t))), "\n"))


def base_figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, cleaned and the base figures of each whole text.

    A null text counts as empty: no words, and its cleaned text is empty.
    """
    data = pair(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    blank = F.regexp_replace("text", SPACE, "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = bind(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return data.select(
        "doc_id", "text", clean_lines(F.col("text")).alias("cleaned"), repeated.alias("w"),
        F.length(blank).cast("long").alias("word_chars"),
        symbols_of(F.col("text")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).withColumns({"n_words": F.col("w.n"), "n_repeat_words": F.col("w.r")}).drop("w")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Base figures, verdict and cleaned text of each document.

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows. kept: base passed, and the failing lines held at most
    `max_lost` of the word characters. Empty and null texts fail; equal rows are
    judged alike; columns other than key and text are not read.
    """
    left = F.length(F.regexp_replace("cleaned", SPACE, ""))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base_figures(docs, key, text).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("word_chars") - left <= max_lost * F.col("word_chars"))).alias("kept"), "cleaned",
    )
