"""Words in which an encoding lost a letter, put right from a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holes(word: Column) -> Column:
    """Each way to leave one letter out: what is before it and what is after it."""
    cut = lambda i: F.struct(F.substr(word, F.lit(1), i - 1).alias("head"), F.substr(word, i + 1).alias("tail"))
    return F.when(F.char_length(word) > 0, F.transform(F.sequence(F.lit(1), F.char_length(word)), cut))


def lost_letters(damaged: DataFrame, text: str, dictionary: DataFrame, word: str, mark: str = "?") -> DataFrame:
    """(text, candidates, repaired) of texts with one mark: the dictionary's word where just one fits.

    Words meet their damaged forms by what is left of them, an equi-join, so that no
    pattern is held against the whole dictionary. Texts without a candidate have no row.
    """
    at = F.instr(F.col(text), mark)
    left = damaged.where(at > 0).select(text, F.substr(F.col(text), F.lit(1), at - 1).alias("head"), F.substr(F.col(text), at + 1).alias("tail"))
    right = dictionary.select(word, F.explode(holes(F.col(word))).alias("h")).select(word, "h.head", "h.tail")
    found = left.join(right, ["head", "tail"]).groupBy(text).agg(F.count("*").alias("candidates"), F.min(word).alias("__word"))
    return found.select(text, "candidates", F.when(F.col("candidates") == 1, F.col("__word")).alias("repaired"))
