"""Joins on ranges, validity and unique candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_days(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs with equal keys whose days differ by at most `days`: an equi-join on day buckets, then the exact test.

    Buckets are days + 1 wide, so a right row stands in its own and both neighbours, and meets a left row once.
    """
    width = days + 1
    l = left.withColumn("__b", F.floor(F.unix_date(left_day) / width))
    r = right.withColumn("__b", F.explode(F.array(*[F.floor(F.unix_date(right_day) / width) + d for d in (-1, 0, 1)])))
    return l.join(r, [*keys, "__b"]).where(F.abs(F.datediff(left_day, right_day)) <= days).drop("__b")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], longest: int) -> DataFrame:
    """Pairs with equal keys whose closed intervals meet; right intervals last `longest` days at most, left ones any number."""
    lb = left.withColumn("__b", F.explode(F.sequence(F.floor(F.unix_date(l[0]) / longest) - 1, F.floor(F.unix_date(l[1]) / longest))))
    rb = right.withColumn("__b", F.floor(F.unix_date(r[0]) / longest))
    return lb.join(rb, [*keys, "__b"]).where((F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))).drop("__b")


def contained(small: DataFrame, large: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], longest: int, id: str, of_small: str, of_large: str) -> DataFrame:
    """Pairs with equal keys and meeting intervals where the array of_small holds nothing that of_large has not.

    A small row looks for its partners by that of its elements which the fewest large
    rows of its keys hold, so a common element, or a common key, costs no more than the
    rarest element that comes with it. Rows with empty or null arrays have no partners;
    `id` names a small row; intervals are as in overlapping().
    """
    elements = large.withColumn("__x", F.explode(F.array_distinct(of_large)))
    often = elements.groupBy(*keys, "__x").agg(F.count("*").alias("__often"))
    asked = small.select(id, *keys, F.explode(of_small).alias("__x")).join(often, [*keys, "__x"], "left")
    rarest = asked.groupBy(id).agg(F.min_by("__x", F.struct(F.coalesce("__often", F.lit(0)), "__x")).alias("__x"))
    pairs = overlapping(small.join(rarest, id), elements, [*keys, "__x"], l, r, longest)
    return pairs.where(F.size(F.array_except(of_small, of_large)) == 0).drop("__x")


def only_candidate(pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pairs that are the only one on both sides."""
    both = pairs.withColumns({"__l": F.count("*").over(Window.partitionBy(*left)), "__r": F.count("*").over(Window.partitionBy(*right))})
    return both.where("__l = 1 AND __r = 1").drop("__l", "__r")


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a day lies in a validity whose end may be open."""
    return (start <= day) & (end.isNull() | (day <= end))
