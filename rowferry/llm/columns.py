"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, in this order: other columns cannot clash with results."""
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key is in fold 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(1))
