"""A corpus pipeline over the documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it and gives the copy to the next one. All but the last return the
columns of documents. `run` applies all of them, with copies in the shared
folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from rowferry.llm.queries import REPEATED_WORDS, table, tokenizer_path
from rowferry.session import bound_batches, freeze

# the stages learn, hash and tokenise; SQL cannot say the same
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, fitted on all labels, does not reject."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of over 50 words, and of 400 bytes, that occur elsewhere; their number of characters anew.

    Every row stays, with an empty text if all of it was repeated.
    """
    bound_batches(spark)
    left = suffix_dedup.remove(docs, words=REPEATED_WORDS)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of every document that is left."""
    bound_batches(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading the copy that the one before left."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = freeze(docs, f"stage-{number}")
    return docs
