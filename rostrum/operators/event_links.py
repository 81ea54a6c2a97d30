"""Links of events of a second source to those of the first, and bouts that several pages publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.joins import contained


def linked_events(main: DataFrame, second: DataFrame, decisions: DataFrame, longest: int) -> DataFrame:
    """(secondary, main, status, rule): link or doubt, for events of id, city, country, start, stop, loose and exact.

    A second event fits a main one of its city, with meeting days and no other country,
    that holds all its competitions: loose, without their format. Of several, the only
    one with all formats (exact) is linked, else the only one of the very same days;
    otherwise each is a doubt and none is linked. decisions (main, secondary, status)
    come first: CONFIRMADO links an event to its main one, if that is there, and to no
    other; RECHAZADO keeps two apart. Events without city or competitions have no links.
    Main events last `longest` days at most.
    """
    has = lambda df: df.where(F.col("city").isNotNull() & (F.col("city") != "") & (F.size("loose") > 0))
    s = has(second).select(F.col("id").alias("secondary"), "city", F.col("country").alias("cs"), F.col("start").alias("s0"), F.col("stop").alias("s1"), F.col("loose").alias("ls"), F.col("exact").alias("es"))
    m = has(main).select(F.col("id").alias("main"), "city", F.col("country").alias("cm"), F.col("start").alias("m0"), F.col("stop").alias("m1"), F.col("loose").alias("lm"), F.col("exact").alias("em"))
    sure = decisions.where("status = 'CONFIRMADO'").groupBy("secondary").agg(F.min("main").alias("main"))
    by_hand = sure.join(s.select("secondary"), "secondary", "left_semi").join(main.select(F.col("id").alias("main")).union(second.select("id")).distinct(), "main", "left_semi")
    free = s.join(sure, "secondary", "left_anti")
    c = contained(free, m, ["city"], ("s0", "s1"), ("m0", "m1"), longest, "secondary", "ls", "lm")
    c = c.where(F.coalesce(F.col("cs") == F.col("cm"), F.lit(True))).join(decisions.where("status = 'RECHAZADO'").select("main", "secondary"), ["main", "secondary"], "left_anti")
    c = c.withColumns({"format": F.size(F.array_except("es", "em")) == 0, "days": (F.col("s0") == F.col("m0")) & (F.col("s1") == F.col("m1"))})
    w = Window.partitionBy("secondary")
    c = c.withColumns({"n": F.count("*").over(w), "formats": F.count_if("format").over(w), "same": F.count_if("days").over(w)})
    rule = F.when(F.col("n") == 1, "contained").when(F.col("formats") == 1, F.when(F.col("format"), "exact_format")).when(F.col("same") == 1, F.when(F.col("days"), "exact_days")).otherwise("several")
    found = c.withColumn("rule", rule).where("rule IS NOT NULL")
    out = found.select("secondary", "main", F.when(F.col("rule") == "several", "doubt").otherwise("link").alias("status"), "rule")
    return out.unionByName(by_hand.select("secondary", "main", F.lit("link").alias("status"), F.lit("by_hand").alias("rule")))


def merged_bouts(seen: DataFrame, key: list[str], one: str, other: str, score: str, against: str, page: str) -> DataFrame:
    """(key, one, other, score, against, copies, pages, state): a row for each bout that pages publish, whatever the side they begin with.

    `imported` where all pages agree; `conflict`, without scores, where two differ, and
    no further page mends that; `same_person` and `no_participant` where the sides cannot
    be a bout. Extremes show a conflict, so no page's rows meet but by key.
    """
    side = lambda who, mine, its: F.struct(F.col(who).alias("who"), F.col(mine).alias("score"), F.col(its).alias("against"))
    a, b = side(one, score, against), side(other, against, score)
    first = F.when(F.col(one) <= F.col(other), a).when(F.col(one) > F.col(other), b).when(F.col(one).isNotNull(), a).otherwise(b)
    second = F.when(F.col(one) <= F.col(other), b).when(F.col(one) > F.col(other), a).when(F.col(one).isNotNull(), b).otherwise(a)
    rows = seen.select(*key, page, first.alias("f"), second["who"].alias("o")).select(*key, page, F.col("f.who").alias(one), F.col("o").alias(other), F.struct("f.score", "f.against").alias("r"))
    out = rows.groupBy(*key, one, other).agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("copies"), F.countDistinct(page).alias("pages"))
    state = F.when(F.col(one).isNull() | F.col(other).isNull(), "no_participant").when(F.col(one) == F.col(other), "same_person").when(F.col("lo").eqNullSafe(F.col("hi")), "imported").otherwise("conflict")
    kept = out.withColumn("state", state)
    agreed = F.col("state") == "imported"
    return kept.select(*key, one, other, F.when(agreed, F.col("lo.score")).alias(score), F.when(agreed, F.col("lo.against")).alias(against), "copies", "pages", "state")
