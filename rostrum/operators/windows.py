"""Window operators: versions, ranks, streaks, deltas and running balances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str | Column]


def numbered(df: DataFrame, keys: Keys, order: Keys, name: str = "rn") -> DataFrame:
    """df with a 1-based number per key as a long."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_per(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """The first row of each key: the latest version, the winning copy, the main source."""
    return numbered(df, keys, order, "__rn").where("__rn = 1").drop("__rn")


def best_of(df: DataFrame, keys: Sequence[str], by: Column, columns: Sequence[str]) -> DataFrame:
    """The same by a single maximum, without sorting: `by` must tell rows apart."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("__best"))
    return picked.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])


def top_k(df: DataFrame, keys: Keys, order: Keys, k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each key with their number."""
    return numbered(df, keys, order, name).where(F.col(name) <= k)


def ranked(df: DataFrame, keys: Keys, by: Column, name: str = "rank") -> DataFrame:
    """df with a competition rank (1, 2, 2, 4) by one expression alone; ties share it."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(by)).cast("long"))


def running_sum(df: DataFrame, keys: Keys, order: Keys, value: Column, name: str) -> DataFrame:
    """df with the sum from the first row to this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def longest_streak(df: DataFrame, keys: Sequence[str], order: Keys, won: Column, name: str = "streak") -> DataFrame:
    """The longest run of rows that satisfy `won`, per key (gaps and islands)."""
    islands = running_sum(df, keys, order, F.when(won, 0).otherwise(1), "__island")
    runs = islands.groupBy(*keys, "__island").agg(F.count_if(won).alias("__run"))
    return runs.groupBy(*keys).agg(F.max("__run").alias(name))


def change(df: DataFrame, keys: Keys, order: Keys, value: str, name: str = "change") -> DataFrame:
    """df with the previous row's value minus this one's: positive when a position improves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lag(value).over(w) - F.col(value))


def sessions(df: DataFrame, keys: Keys, start: str, end: str, gap_days: int, name: str = "session") -> DataFrame:
    """df with a session number per key: a row starts one when it begins more than gap_days after all before it have ended."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.datediff(F.col(start), before) > gap_days), 1).otherwise(0)
    marked = df.withColumn("__fresh", fresh)
    return marked.withColumn(name, F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__fresh")
