"""People united in stages, by licences, dates of birth, the only fuller name, and what their results say."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.clusters import components
from rostrum.operators.storage import written

#: Years by which two dates of birth, or a club's seasons, may differ.
NEAR = 1


def profiles(people: DataFrame, facts: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per root of roots (id, root): id, official, licences, words, gender, birth, weapons, clubs, first, last, low, high.

    people: id, official, licence, words, gender, birth; facts: id, weapon, club, year,
    low, high (the years of birth that the category admits). A root has the name with
    the most words among its members, as a sorted set, and the narrowest years.
    Rows without an id, and facts of nobody, are left out.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))))
    own = people.join(roots, "id").withColumn("words", words).groupBy(F.col("root").alias("id")).agg(
        F.min("official").alias("official"), F.collect_set("licence").alias("licences"), F.max(F.struct(F.size("words").alias("n"), "words")).alias("name"),
        F.min("gender").alias("gender"), F.min("birth").alias("birth"),
    )
    seen = facts.join(roots, "id").groupBy(F.col("root").alias("id")).agg(
        F.collect_set("weapon").alias("weapons"), F.collect_set(F.when(F.col("club").isNotNull() & F.col("year").isNotNull(), F.struct("club", "year"))).alias("clubs"),
        F.min("year").alias("first"), F.max("year").alias("last"), F.max("low").alias("low"), F.min("high").alias("high"),
    )
    return own.withColumn("words", F.col("name.words")).drop("name").join(seen, "id", "left")


def fuller(names: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, words, more): the names of equal keys that hold all words of a shorter one, by its rarest word.

    names: distinct (keys, words), words a sorted set. Only different names meet, however
    many people bear them. Rows made by explode are never broadcast: Spark's estimate of
    their size is that of the rows before.
    """
    each = names.select(*keys, "words", F.explode("words").alias("__word"))
    common = each.groupBy(*keys, "__word").agg(F.count("*").alias("__n"))
    rarest = each.join(common.hint("merge"), [*keys, "__word"]).groupBy(*keys, "words").agg(F.min(F.struct("__n", "__word")).alias("__least"))
    asked = rarest.select(*keys, "words", F.col("__least.__word").alias("__word"))
    pairs = asked.join(each.withColumnRenamed("words", "more").hint("merge"), [*keys, "__word"])
    return pairs.where((F.size("words") < F.size("more")) & (F.size(F.array_except("words", "more")) == 0)).drop("__word")


def same_licence(roots: DataFrame, _: DataFrame) -> DataFrame:
    """Edges (a, b) of people with one licence, the same words in their name, and one gender."""
    each = roots.where(F.size("words") > 0).select("id", "words", "gender", F.explode("licences").alias("licence"))
    least = each.groupBy("licence", "words", "gender").agg(F.min("id").alias("a"))
    met = each.alias("e").join(least.alias("l"), (F.col("e.licence") == F.col("l.licence")) & (F.col("e.words") == F.col("l.words")) & F.col("e.gender").eqNullSafe(F.col("l.gender")))
    return met.where("a <> id").select("a", F.col("id").alias("b"))


def same_birth(roots: DataFrame, _: DataFrame) -> DataFrame:
    """Edges of people born on one day, of one gender, whose names are the same or one the only fuller name of the other."""
    keys = ["birth", "gender"]
    known = roots.dropna(subset=keys).where(F.size("words") > 0)
    least = known.groupBy(*keys, "words").agg(F.min("id").alias("a"))
    equal = known.join(least, [*keys, "words"]).where("a <> id").select("a", F.col("id").alias("b"))
    only = fuller(least.drop("a"), keys).groupBy(*keys, "words").agg(F.count("*").alias("n"), F.min("more").alias("more")).where("n = 1")
    longer = only.join(least, [*keys, "words"]).join(least.withColumnsRenamed({"a": "b", "words": "more"}), [*keys, "more"])
    return equal.unionByName(longer.select("a", "b"))


def only_name(roots: DataFrame, _: DataFrame) -> DataFrame:
    """Edges of an official person and a licensed one without official id, where each is the only one whose name is the other's, fuller or cut."""
    keys = ["gender"]
    known = roots.where(F.col("gender").isNotNull() & (F.size("words") > 0))
    world = F.col("official").isNotNull()
    home = ~world & (F.size("licences") > 0)
    count = lambda of, n, least: (F.count_if(of).alias(n), F.min(F.when(of, F.col("id"))).alias(least))
    names = written(known.groupBy(*keys, "words").agg(*count(world, "worlds", "a"), *count(home, "homes", "b")), "names")
    longer = fuller(names.select(*keys, "words"), keys)
    met = names.select(*keys, F.col("words").alias("w"), F.col("words").alias("h")).unionByName(longer.select(*keys, F.col("words").alias("w"), F.col("more").alias("h"))).unionByName(longer.select(*keys, F.col("more").alias("w"), F.col("words").alias("h")))
    sides = met.join(names.select(*keys, F.col("words").alias("w"), "worlds", "a").where("worlds > 0"), [*keys, "w"]).join(names.select(*keys, F.col("words").alias("h"), "homes", "b").where("homes > 0"), [*keys, "h"])
    sides = written(sides, "sides")
    for_home = sides.groupBy(*keys, "h").agg(F.sum("worlds").alias("n")).where("n = 1").select(*keys, "h")
    for_world = sides.groupBy(*keys, "w").agg(F.sum("homes").alias("n")).where("n = 1").select(*keys, "w")
    return sides.join(for_home, [*keys, "h"], "semi").join(for_world, [*keys, "w"], "semi").select("a", "b")


def contradicts(x: Column, y: Column) -> Column:
    """Whether two profiles cannot be one person: gender, official id, date of birth, years that their categories admit."""
    apart = F.abs(F.year(x["birth"]) - F.year(y["birth"])) > NEAR
    years = F.greatest(x["low"], y["low"]) > F.least(x["high"], y["high"])
    return F.coalesce(x["gender"] != y["gender"], F.lit(False)) | F.coalesce(x["official"] != y["official"], F.lit(False)) | F.coalesce(apart, F.lit(False)) | F.coalesce(years, F.lit(False))


def other_club(x: Column, y: Column) -> Column:
    """Whether y has clubs in seasons near those of x, none of them a club of x."""
    near = F.filter(y["clubs"], lambda d: F.exists(x["clubs"], lambda c: F.abs(c["year"] - d["year"]) <= NEAR))
    own = F.transform(x["clubs"], lambda c: c["club"])
    return F.coalesce((F.size(near) > 0) & ~F.exists(near, lambda d: F.array_contains(own, d["club"])), F.lit(False))


def by_results(roots: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges of a person known by name alone and the only fuller name that their results speak for.

    One speaks for the other with a club in near seasons and a weapon in common, the
    shorter name's seasons within its career, no contradiction and no competition that
    both took part in. All other fuller names must be ruled out: by a contradiction, by
    another club in those seasons, or as themselves a cut form of the one. Who is spoken
    for is found by equi-joins on name, club, season and weapon; only people with exactly
    one such candidate then meet their other candidates.
    """
    x, y = F.col("x"), F.col("y")
    longer = written(fuller(roots.where(F.size("words") > 0).select("words").distinct()), "fuller")
    who = roots.select(F.struct("*").alias("y"), F.col("words").alias("more"))
    cut = roots.where(F.col("official").isNull() & (F.size("licences") == 0)).select(F.struct("*").alias("x"), "words").join(longer, "words").drop("words")
    ours = cut.select("x.id", "more", F.explode("x.weapons").alias("weapon"), "x.clubs").select("id", "more", "weapon", F.inline("clubs"))
    shifted = F.explode(F.array(*[F.lit(d) for d in range(-NEAR, NEAR + 1)]))
    theirs = who.select(F.col("y.id").alias("b"), "more", F.explode("y.weapons").alias("weapon"), "y.clubs").select("b", "more", "weapon", F.inline("clubs"))
    theirs = theirs.withColumn("__d", shifted).withColumn("year", F.col("year") + F.col("__d")).drop("__d")
    spoken = ours.join(theirs.hint("merge"), ["more", "weapon", "club", "year"]).select(F.col("id").alias("a"), "b").distinct()
    spoken = spoken.join(roots.select(F.col("id").alias("a"), F.struct("*").alias("x")), "a").join(roots.select(F.col("id").alias("b"), F.struct("*").alias("y")), "b")
    career = (x["first"] >= y["first"] - NEAR) & (x["last"] <= y["last"] + NEAR)
    spoken = written(spoken.where(career & ~contradicts(x, y)).select("a", "b"), "spoken")
    seats = facts.select("id", "competition").distinct()
    together = spoken.join(seats.withColumnRenamed("id", "a"), "a").join(seats.withColumnRenamed("id", "b"), ["b", "competition"]).select("a", "b")
    lone = spoken.join(together, ["a", "b"], "anti").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").drop("n")
    lone = written(lone.join(roots.select(F.col("id").alias("b"), F.col("words").alias("full")), "b"), "lone")
    others = cut.join(lone.select(F.col("a"), "b", "full"), x["id"] == F.col("a")).join(who, "more").where(y["id"] != F.col("b"))
    within = F.size(F.array_except(y["words"], F.col("full"))) == 0
    open_ = others.where(~contradicts(x, y) & ~other_club(x, y) & ~(within & (F.size(y["words"]) < F.size("full")))).select("a").distinct()
    return lone.join(open_, "a", "anti").select("a", "b")


STAGES: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"licence": same_licence, "birth": same_birth, "name": only_name, "results": by_results}


def united(people: DataFrame, facts: DataFrame, stages: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] = STAGES) -> DataFrame:
    """(id, root, stage): people united by the stages in order, each over the roots of the ones before.

    people: id, official, licence, words, gender, birth (one row per id); facts: id,
    competition, weapon, club, year, low, high. The edges that a stage finds make
    components; one that holds two genders, two official ids or dates of birth more than
    a year apart unites nobody, since which of them are wrong is not known. The root is
    the least id; `stage` is the last that changed a row's root, null where none did.
    Rows with a null id are left out. Stages are written, so that none is computed again.
    """
    of = people.where("id IS NOT NULL").select("id", F.col("id").alias("root"), F.lit(None).cast("string").alias("stage"))
    for name, stage in stages.items():
        links = of.select("id", "root")
        now = written(profiles(people, facts, links), "profiles")
        rooted = written(facts.join(links, "id").withColumn("id", F.col("root")).drop("root"), "facts")
        grouped = components(stage(now, rooted).where("a <> b"))
        year = F.year("birth")
        agree = (F.count_distinct("gender") <= 1) & (F.count_distinct("official") <= 1) & F.coalesce(F.max(year) - F.min(year) <= NEAR, F.lit(True))
        fine = grouped.join(now.select("id", "gender", "official", "birth"), "id").groupBy("component").agg(agree.alias("agree")).where("agree").select("component")
        moves = grouped.join(fine, "component").where("id <> component").select(F.col("id").alias("root"), F.col("component").alias("__to"))
        of = of.join(moves, "root", "left").select("id", F.coalesce("__to", "root").alias("root"), F.when(F.col("__to").isNotNull(), name).otherwise(F.col("stage")).alias("stage"))
        of = written(of, "united")
    return of
