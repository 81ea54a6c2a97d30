"""Rounds of an elimination bracket in the order in which they are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.storage import work_path

ROUNDS = 9  # from the final to a round of 512


def ordered(bouts: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """bouts (keys, size, a, b, winner, number) with their seat in the round, from 1.

    The final (or the last round that is there) keeps its own order. In each round
    before, the bouts that a and b of the next round's bouts won come first, in that
    order; a bout that leads nowhere goes behind them by its number. Of two bouts of
    a round with one winner the smaller number leads on. A step joins one round with
    the one before and writes it, so that no bracket is gathered and no step runs
    twice; more than `rounds` rounds are an error.
    """
    spark, path = bouts.sparkSession, work_path(bouts.sparkSession, "bracket")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    level = F.dense_rank().over(Window.partitionBy(*keys).orderBy("size"))
    first = F.row_number().over(Window.partitionBy(*keys, "size", "winner").orderBy("number"))
    df = written(bouts.withColumn("__level", level).withColumn("__first", first == 1), "bouts")
    deepest = df.agg(F.max("__level")).first()[0] or 0
    if deepest > rounds:
        raise ValueError(f"{deepest} rounds, {rounds} at most")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__key"), "number")).cast("long")
    out = df.where(F.lit(False)).withColumns({"__key": F.lit(None).cast("long"), "seat": F.lit(None).cast("long")})
    done = out
    for n in range(1, deepest + 1):
        side = lambda c, k: F.struct(F.col(c).alias("winner"), (F.col("seat") * 2 + k).alias("__key"))
        leads = done.select(*keys, F.explode(F.array(side("a", 0), side("b", 1))).alias("x")).select(*keys, "x.*")
        leads = leads.groupBy(*keys, "winner").agg(F.min("__key").alias("__key")).withColumn("__first", F.lit(True))
        own = df.where(F.col("__level") == n).join(leads, [*keys, "winner", "__first"], "left")
        done = written(own.withColumn("seat", place), f"round-{n}")
        out = out.unionByName(done)
    return out.drop("__level", "__first", "__key")
