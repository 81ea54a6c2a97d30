"""Sources in other forms than tables: lists of structures, HTML, CSV and fact files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import round_of


def struct_list(spark: SparkSession, json: str, fields: str) -> DataFrame:
    """Rows of a JSON list that is given as a parameter; a text that is no such list gives none."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json), f"array<struct<{', '.join(':'.join(f.split()) for f in fields.split(','))}>>")))


def html_items(pages: DataFrame, html: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """pages with a row per match of the pattern in the HTML, its place (pos, from 1) and its groups by name."""
    groups = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    df = pages.select("*", F.posexplode(groups).alias("__pos", "__item"))
    return df.select(*pages.columns, (F.col("__pos") + 1).cast("long").alias("pos"), *[F.col(f"__item.{n}").alias(n) for n in names])


def html_table(pages: DataFrame, html: str) -> DataFrame:
    """pages with a row per row of their tables: its place and the texts of its cells, without markup."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))
    df = pages.select("*", F.posexplode(rows).alias("__pos", "__row"))
    cells = F.transform(F.regexp_extract_all("__row", F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), "\\s+", " ")))
    return df.select(*pages.columns, (F.col("__pos") + 1).cast("long").alias("pos"), cells.alias("cells"))


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """CSV with a header, quotes doubled within quotes, and line ends inside them."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


FACTS = """version int, source string, sourceSha256 string, edition struct<season: string, tournamentKey: string, name: string>,
    competition struct<competitionKey: string, weapon: string, gender: string, category: string>,
    status struct<results: string, pools: string, tableau: string>,
    results array<struct<place: int, name: string, country: string>>, bouts array<struct<round: string, a: string, b: string, scoreA: int, scoreB: int>>"""


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, bouts, refused) of files with one competition's facts as a JSON object each, lists in their order.

    A file of another version, or without a competition's key, is refused whole.
    """
    files = spark.read.schema(FACTS).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    good = F.coalesce((F.col("version") == 1) & F.col("competition.competitionKey").isNotNull(), F.lit(False))
    fine, key = files.where(good), F.col("competition.competitionKey").alias("competition")

    def rows(lists: str) -> DataFrame:
        df = fine.select("source", key, F.col("status").alias("s"), F.posexplode(lists).alias("pos", "x"))
        # A bout is as complete as the part of the competition that it is of.
        status = F.col("s.results") if lists == "results" else F.when(round_of(F.col("x.round")).isNotNull(), F.col("s.tableau")).otherwise(F.col("s.pools"))
        return df.select("source", "competition", status.alias("status"), "pos", "x.*")

    return rows("results"), rows("bouts"), files.where(~good).select("file", "version")
