"""The queries of the corpus operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.bpe import encode_decode
from rostrum.llm import embedding_dedup, exact, line_dedup, minhash, pii, quality, ranked_search, repeats, spelling, token_files
from rostrum.llm.common import shared_dir, table
from rostrum.llm.packing import pack
from rostrum.llm.token_counts import count_tokens


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of power-of-two lengths up to 1024."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its common lines."""
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates: three words, a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without byte strings of 400 that occur more than once, and its words in passages of over 50 words that others share."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), words=51)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from `labels`."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.train(docs, table(spark, sf_dir, "labels")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component at a cosine of 0.9."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read from the files that hold them; the files stay in the shared folder."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read_ids(spark, path)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash": op4_minhash,
    "op5_repeats": op5_repeats,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling": op12_spelling,
    "op13_token_files": op13_token_files,
}
#: For the others SQL has no such function, or is too slow on whole tables; tests hold them against brute force.
ORACLES = {"op3_line_dedup": line_dedup.ORACLE, "op6_exact_dedup": exact.ORACLE, "op11_ranked_search": ranked_search.ORACLE}
