"""Places of teams at games: best places, zones, heirs of zones without a team, and how near the others are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Teams by place alone, places within which a zone's best team counts, and the share of points that one who is near may lack.
TOP, LAST_OF_ZONES, NEAR = 4, 24, 1 / 3


def _only(condition: Column, value: str, w: WindowSpec) -> Column:
    """The value of the one row of a window that satisfies a condition, null without one."""
    return F.max(F.when(condition, F.col(value))).over(w)


def teams(table: DataFrame, event: str, zones: Sequence[str], excluded: Sequence[int] = ()) -> DataFrame:
    """table (event, country, zone, points; one row per team) with place, via, way, state, margin, missing and ahead.

    Excluded countries are left out and hold no place. The first four qualify (`top`),
    then the best of each zone among places 5 to 24 (`zone`), then as many of the next
    as zones have none (`next`, for the zones in the order given). Others are `near` if
    they are the first reserve of a way and lack at most a third of the points of who
    they have to pass; the way with least to go counts. `margin` is what a qualified
    team has over the first that stays out of its way, `missing` what a near one lacks,
    `ahead` how many teams it has to pass. An event has one team per country, so its
    windows are small; ties go by country.
    """
    everyone = Window.partitionBy(event)
    df = table.where(~F.col("country").isin(list(excluded))) if excluded else table
    df = df.withColumn("place", F.row_number().over(everyone.orderBy(F.desc("points"), "country")).cast("long"))
    eligible = F.col("place").between(TOP + 1, LAST_OF_ZONES) & F.col("zone").isin(list(zones))
    df = df.withColumn("__zoned", eligible).withColumn("__zn", F.row_number().over(Window.partitionBy(event, "zone", "__zoned").orderBy("place")))
    df = df.withColumn("via", F.when(F.col("place") <= TOP, "top").when(F.col("__zoned") & (F.col("__zn") == 1), "zone"))
    won = F.collect_set(F.when(F.col("via") == "zone", F.col("zone"))).over(everyone)
    df = df.withColumn("__open", F.array_except(F.array(*map(F.lit, zones)), won))
    rest = F.sum(F.when(F.col("via").isNull(), 1).otherwise(0)).over(everyone.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__n", F.when(F.col("via").isNull(), rest))
    heir = F.col("__n") <= F.size("__open")
    df = df.withColumn("way", F.when(F.col("via") == "zone", F.col("zone")).when(heir, F.get("__open", (F.col("__n") - 1).cast("int")))).withColumn("via", F.when(heir, "next").otherwise(F.col("via")))
    out = F.col("via").isNull()
    df = df.withColumn("__out", out).withColumns({
        "__m": F.row_number().over(Window.partitionBy(event, "__out").orderBy("place")), "__zm": F.row_number().over(Window.partitionBy(event, "zone", "__out").orderBy("place")),
        "__fourth": _only(F.col("place") == TOP, "points", everyone), "__fifth": _only(F.col("place") == TOP + 1, "points", everyone), "__stretch": _only(F.col("place") == LAST_OF_ZONES, "points", everyone),
        "__heir": F.min(F.when(F.col("via") == "next", F.col("points"))).over(everyone), "__zone": _only(F.col("via") == "zone", "points", Window.partitionBy(event, "zone")),
    })
    df = df.withColumns({"__first": _only(F.col("__out") & (F.col("__m") == 1), "points", everyone), "__own": _only(F.col("__out") & (F.col("__zm") == 1), "points", Window.partitionBy(event, "zone"))})
    short = lambda against: F.round(F.greatest(F.lit(0.0), against - F.col("points")), 2)
    way = lambda name, first, against, ahead: F.when(first & (short(against) <= against * NEAR), F.struct(short(against).alias("missing"), F.lit(name).alias("via"), ahead.cast("long").alias("ahead")))
    one = F.col("__m") == 1
    ways = F.array(way("top", one, F.col("__fourth"), F.col("place") - TOP), way("zone", (F.col("__zm") == 1) & F.col("zone").isin(list(zones)), F.coalesce("__zone", "__stretch"), F.lit(1)), way("next", one, F.col("__heir"), F.lit(1)))
    best = F.reduce(F.filter(ways, lambda w: w.isNotNull()), F.lit(None).cast("struct<missing:double,via:string,ahead:bigint>"), lambda a, w: F.when(a.isNull() | (w["missing"] < a["missing"]), w).otherwise(a))
    df = df.withColumn("__near", F.when(F.col("__out"), best))
    over = F.when(F.col("via") == "top", F.col("__fifth")).when(F.col("via") == "zone", F.col("__own")).when(F.col("via") == "next", F.col("__first"))
    return df.select(
        *table.columns, "place", F.coalesce("via", "__near.via").alias("via"), "way", F.when(~F.col("__out"), "qualified").when(F.col("__near").isNotNull(), "near").otherwise("out").alias("state"),
        F.when(over.isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("points") - over), 2)).alias("margin"), F.col("__near.missing").alias("missing"), F.col("__near.ahead").alias("ahead"),
    )


def with_pending(table: DataFrame, event: str, zones: Sequence[str], pending: Sequence[int]) -> DataFrame:
    """teams() without the pending countries, which come as `pending` with what they would have if they counted (would_be, would_via)."""
    without = teams(table, event, zones, pending).withColumns({"would_be": F.lit(None).cast("string"), "would_via": F.lit(None).cast("string")})
    counted = F.col("state").isin("qualified", "near")
    none = lambda t: F.lit(None).cast(t)
    what_if = teams(table, event, zones).where(F.col("country").isin(list(pending))).select(
        *table.columns, none("long").alias("place"), none("string").alias("via"), none("string").alias("way"), F.lit("pending").alias("state"), none("double").alias("margin"), none("double").alias("missing"), none("long").alias("ahead"),
        F.when(counted, F.col("state")).alias("would_be"), F.when(counted, F.col("via")).alias("would_via"),
    )
    return without.unionByName(what_if)
