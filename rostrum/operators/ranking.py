"""Season rankings: contributions, best-N selection, totals, cut-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.filters import all_of
from rostrum.operators.windows import numbered, ranked


def field_sizes(results: DataFrame, keys: Sequence[str] = ("competition",)) -> DataFrame:
    """Entrants per competition: the larger of the last place and the number of rows."""
    return results.groupBy(*keys).agg(F.greatest(F.coalesce(F.max("place"), F.lit(0)), F.count("*")).cast("long").alias("participants"))


def with_field_sizes(results: DataFrame, keys: Sequence[str] = ("competition",)) -> DataFrame:
    """results with field_sizes() beside each row; no shuffle where rows already lie by these keys."""
    w = Window.partitionBy(*keys)
    return results.withColumn("participants", F.greatest(F.coalesce(F.max("place").over(w), F.lit(0)), F.count("*").over(w)).cast("long"))


def match_rules(facts: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Each fact with rule, counting and coefficient of its most specific rule, null without one; chosen within the row.

    A rule is (rule, season, weapon, category, counting, coefficient): a null
    dimension is a wildcard, season outweighs weapon and weapon category, and of
    rules as specific the first by name is taken.
    """
    weights = {"season": 4, "weapon": 2, "category": 1}
    fitting = []
    for rule, season, weapon, category, counting, coefficient in rules:
        given = {k: v for k, v in (("season", season), ("weapon", weapon), ("category", category)) if v is not None}
        choice = F.struct(F.lit(-sum(weights[k] for k in given)).alias("order"), F.lit(rule).alias("rule"), F.lit(counting).alias("counting"), F.lit(coefficient).alias("coefficient"))
        fitting.append(F.when(all_of(F.col(k) == v for k, v in given.items()), choice))
    best = F.array_min(F.array_compact(F.array(*fitting)))
    return facts.withColumn("__best", best).select("*", "__best.rule", "__best.counting", "__best.coefficient").drop("__best")


def best_n(contributions: DataFrame, group: Sequence[str], counting: str = "counting") -> DataFrame:
    """contributions with `n` (by points, then date) and `counted`: the first N that are above 0."""
    df = numbered(contributions, group, [F.desc("final"), F.desc("day"), F.asc("fact")], "n")
    return df.withColumn("counted", (F.col("n") <= F.col(counting)) & (F.col("final") > 0))


def totals(chosen: DataFrame, group: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Totals of counted contributions and their rank: only the total decides ties."""
    df = chosen.groupBy(*group).agg(F.round(F.sum(F.when(F.col("counted"), F.col("final")).otherwise(0.0)), 2).alias("total"), F.count_if("counted").alias("events"))
    return ranked(df, list(within), F.desc("total"), "position")


def cutoff(table: DataFrame, within: Sequence[str], places: int) -> DataFrame:
    """Distance to the cut: places and points away from the last one inside, and the state."""
    last = F.min(F.when(F.col("position") <= places, F.col("total"))).over(Window.partitionBy(*within))
    df = table.withColumn("cut_total", last)
    inside = F.col("position") <= places
    return df.withColumns({
        "state": F.when(inside, "inside").when(F.col("cut_total").isNull(), "unknown").otherwise("outside"),
        "places_away": F.greatest(F.col("position") - places, F.lit(0)).cast("long"),
        "points_away": F.round(F.when(inside, 0.0).otherwise(F.col("cut_total") - F.col("total")), 2),
    })
