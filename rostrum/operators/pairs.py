"""Facts about pairs: orientation, canonical copies, balances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orient(df: DataFrame, a: str, b: str, value_a: str, value_b: str) -> DataFrame:
    """Every pair fact from both sides in one scan: me, rival, favor, contra and the other columns."""
    sides = F.array(
        F.struct(F.col(a).alias("me"), F.col(b).alias("rival"), F.col(value_a).alias("favor"), F.col(value_b).alias("contra"), F.lit("A").alias("side")),
        F.struct(F.col(b).alias("me"), F.col(a).alias("rival"), F.col(value_b).alias("favor"), F.col(value_a).alias("contra"), F.lit("B").alias("side")),
    )
    rest = [c for c in df.columns if c not in (a, b, value_a, value_b)]
    return df.withColumn("__side", F.explode(sides)).select("__side.*", *rest)


def canonical_copy(df: DataFrame, equivalence: Sequence[str], copy: str) -> DataFrame:
    """Facts of the copy with the smallest id alone, where several sources hold one competition."""
    least = F.min(copy).over(Window.partitionBy(*equivalence))
    return df.withColumn("__least", least).where(F.col(copy) == F.col("__least")).drop("__least")


def won() -> Column:
    return F.col("favor") > F.col("contra")


def lost() -> Column:
    return F.col("favor") < F.col("contra")


def balance() -> list[Column]:
    """The aggregates of a balance of oriented bouts."""
    return [
        F.count("*").alias("bouts"), F.count_if(won()).alias("wins"), F.count_if(lost()).alias("losses"), F.count_if(F.col("favor") == F.col("contra")).alias("undecided"),
        F.sum("favor").cast("long").alias("touches_for"), F.sum("contra").cast("long").alias("touches_against"),
    ]


def win_rate(wins: str = "wins", losses: str = "losses") -> Column:
    """Wins among decided bouts; null when there are none."""
    return F.round(F.try_divide(F.col(wins), F.col(wins) + F.col(losses)), 6)
