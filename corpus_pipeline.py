"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage is a function (spark, docs, sf_dir) of what the one before kept, and
all but the last return the columns of documents, whatever their names.

Odd rows have the results that the operators' docstrings state. Null and empty
texts are scored by the classifier as texts without words, count as copies of each
other, have no near copies or personal data, and pack as the end token alone; null
doc_ids are one document, below any other, where one of several rows stays; rows
that repeat the doc_id that stays all stay; very long texts are read whole; an empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import exact, minhash, packing, pii, quality
from rostrum.llm.common import stored, table
from rostrum.llm.queries import vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; those without words as it scores no words."""
    return quality.accepted(docs, *quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents, null as empty: the largest doc_id."""
    return exact.without_copies(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates, the least doc_id: five words, a similarity of 0.8 or more; texts without words stay."""
    return minhash.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; n_chars follows the text, and stays where that is null."""
    return pii.masked(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, one piece of a document each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact", distinct), ("near", different), ("private", private), ("packing", packed)]
#: A trained network and its word vectors are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
