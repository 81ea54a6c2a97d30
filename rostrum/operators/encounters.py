"""Readings of one competition by several sources as one encounter of two people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.windows import sessions


def grouped(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Encounters per `keys`: since, first_reading, readings, mine, theirs, ahead and bouts.

    readings: the keys (two people and what a competition must have in common), reading
    (a unique long), day, mine and theirs (places, or null) and bouts. Readings of days
    that follow each other without a gap are one encounter when their places do not
    contradict and one of them is equal: one that lacks a place joins the weightiest with
    both that has its other place; one without places joins the weightiest that has any.
    Weight is places, then bouts, then the least reading. Bouts of an encounter are those
    of its weightiest reading that has bouts, never a sum: sources repeat the same ones.
    """
    mine, theirs = F.col("mine"), F.col("theirs")
    both, order = mine.isNotNull() & theirs.isNotNull(), [F.desc("bouts"), "reading"]
    df = sessions(readings, keys, "day", "day", 1)
    place = F.struct(mine.cast("long").alias("mine"), theirs.cast("long").alias("theirs"))
    of = lambda *k: F.first(F.when(both, place)).over(Window.partitionBy(*keys, "session", *k).orderBy(F.desc(both), *order))
    own = F.when(both, place).when(mine.isNotNull(), F.coalesce(of("mine"), place)).when(theirs.isNotNull(), F.coalesce(of("theirs"), place))
    df = df.withColumn("own", own)
    heaviest = F.first("own").over(Window.partitionBy(*keys, "session").orderBy(F.col("own").isNull(), F.desc(both), *order))
    df = df.withColumn("head", F.coalesce("own", heaviest)).withColumn("alone", F.when(F.col("head").isNull(), F.col("reading")))
    found = df.groupBy(*keys, "session", "head", "alone").agg(
        F.min("day").alias("since"), F.min("reading").alias("first_reading"), F.count("*").alias("readings"), F.max("mine").alias("mine"), F.max("theirs").alias("theirs"),
        F.max_by("bouts", F.struct(both & (F.col("bouts") > 0), F.col("bouts"), -F.col("reading"))).alias("bouts"),
    )
    ahead = F.when(mine < theirs, "me").when(mine > theirs, "rival").when(mine == theirs, "tie")
    return found.withColumn("ahead", ahead).drop("session", "head", "alone")
