"""Prefix completion over the vocabulary: a range of a sorted table, no tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_prefix(vocabulary: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` terms that begin with ``prefix``, in code point order.

    The prefix is taken as it is; an empty one matches all; a limit of 0 or less none.
    """
    found = vocabulary.select("term").where(F.col("term").startswith(prefix))
    return found.orderBy("term").limit(limit) if limit > 0 else found.where(F.lit(False))


def contains(vocabulary: DataFrame, word: str) -> bool:
    """Whether the word itself, not only words that it begins, is a term."""
    return not vocabulary.where(F.col("term") == word).isEmpty()


def common_prefix(vocabulary: DataFrame) -> str:
    """The most frequent first two characters among longer terms, the least on ties.

    Without longer terms, the first character of the least term.
    """
    pairs = vocabulary.where(F.length("term") > 2).groupBy(F.substring("term", 1, 2).alias("prefix")).agg(F.count("*").alias("n"))
    row = pairs.orderBy(F.desc("n"), "prefix").first()
    if row:
        return row["prefix"]
    least = vocabulary.agg(F.min("term")).first()[0]
    if least is None:
        raise ValueError("the vocabulary is empty")
    return least[:1]
