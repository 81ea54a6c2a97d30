"""Links of rows to people: by unique keys in order of trust, by stages with conflicts, by continuity of rounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.storage import written


def link_by_levels(rows: DataFrame, people: DataFrame, person: str, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows with `person`, `level` and `reason`: the first level in which people have the row's keys decides.

    A level is a list of columns that both sides have. One person there links the row;
    several are `ambiguous`, and later levels are not asked; none in any level is
    `none`. Rows with a null among a level's keys have nobody there; a number of their
    own, which no key has, spreads them over the tasks. Each level is one aggregate of
    the people and one equi-join of a row per key, so a common key costs no more rows
    than any other.
    """
    out = rows
    for k, keys in enumerate(levels.values()):
        known = people.dropna(subset=[*keys, person]).groupBy(*keys).agg(F.min(person).alias(f"__least{k}"), F.max(person).alias(f"__most{k}"))
        nobody = reduce(Column.__or__, [F.col(c).isNull() for c in keys])
        apart = F.when(nobody, F.xxhash64(*rows.columns)).otherwise(0).alias("__apart")
        out = out.select("*", apart).join(known.withColumn("__apart", F.lit(0).cast("long")), [*keys, "__apart"], "left").drop("__apart")
    least = [F.col(f"__least{k}") for k in range(len(levels))]
    who = F.coalesce(*[F.when(one.isNotNull(), F.struct(one.alias("least"), F.col(f"__most{k}").alias("most"), F.lit(name).alias("level"))) for k, (name, one) in enumerate(zip(levels, least, strict=True))])
    out = out.withColumn("__who", who)
    only = F.col("__who.least") == F.col("__who.most")
    reason = F.when(F.col("__who").isNull(), "none").when(only, "linked").otherwise("ambiguous")
    return out.select(*rows.columns, F.when(only, F.col("__who.least")).alias(person), F.col("__who.level").alias("level"), reason.alias("reason"))


def once_per(links: DataFrame, scope: Sequence[str], who: Sequence[str], person: str) -> DataFrame:
    """links without those of a person whom one scope links to several different `who`: one reading is wrong, and which one is not known."""
    w = Window.partitionBy(*scope, person)
    twice = F.col(person).isNotNull() & (F.min(F.struct(*who)).over(w) != F.max(F.struct(*who)).over(w))
    marked = links.withColumn("__twice", twice)
    return marked.withColumns({person: F.when(~F.col("__twice"), F.col(person)), "reason": F.when(F.col("__twice"), "repeated").otherwise(F.col("reason"))}).drop("__twice")


def unite_in_stages(people: DataFrame, stages: Mapping[str, Sequence[str]], veto: Sequence[str]) -> DataFrame:
    """(id, root, stage): people united by stages of keys, each over the roots of the ones before.

    A stage unites roots that share its keys, all of them not null, under the least
    root, unless they hold two different values of a veto column: then none of that key
    unites, since which of them belong together is not known. A root has the least not
    null value of every key and veto column that its members have. `stage` is the last
    that gave a row its root, null for those that stayed alone. Each stage is written,
    so that none is computed again by the next.
    """
    columns = sorted({c for keys in stages.values() for c in keys} | set(veto))
    of = people.select("id", F.col("id").alias("root"), F.lit(None).cast("string").alias("stage"))
    roots = people.select(F.col("id").alias("root"), *columns)
    for name, keys in stages.items():
        named = F.lit(True)
        for c in keys:
            named = named & F.col(c).isNotNull()
        agree = F.lit(True)
        for c in veto:
            agree = agree & F.min(c).eqNullSafe(F.max(c))
        united = roots.where(named).groupBy(*keys).agg(F.min("root").alias("__to"), agree.alias("__agree"), F.count("*").alias("__n")).where("__agree AND __n > 1").drop("__agree", "__n")
        moves = written(roots.join(united, list(keys), "left").select("root", F.coalesce("__to", "root").alias("__to"), *columns), "moves")
        of = of.join(moves.select("root", "__to").where("root <> __to"), "root", "left").select(
            "id", F.coalesce("__to", "root").alias("root"), F.when(F.col("__to").isNotNull(), name).otherwise(F.col("stage")).alias("stage")
        )
        roots = moves.groupBy(F.col("__to").alias("root")).agg(*[F.min(c).alias(c) for c in columns])
    return of


def continued(rounds: DataFrame, scope: Sequence[str], person: str, size: str, won: Column) -> DataFrame:
    """(scope, size, person, newcomer): the winner of a round who is absent from the next and the one newcomer there, where each is the only one.

    rounds: one row per person and round of `size` people; the next round has half of it.
    Winners and newcomers meet by aggregates of a scope's round, not by pairs.
    """
    here = rounds.groupBy(*scope, size, person).agg(F.bool_or(won).alias("won"))
    after = here.select(*scope, (F.col(size) * 2).alias(size), person, F.lit(True).alias("next"))
    both = here.withColumn("here", F.lit(True)).join(after, [*scope, size, person], "full")
    lost, new = F.col("won") & F.col("next").isNull(), F.col("here").isNull()
    per = both.groupBy(*scope, size).agg(
        F.count_if(lost).alias("lost"), F.count_if(new).alias("new"), F.min(F.when(lost, F.col(person))).alias(person), F.min(F.when(new, F.col(person))).alias("newcomer")
    )
    return per.where("lost = 1 AND new = 1").select(*scope, size, person, "newcomer")


def first_of_chain(links: DataFrame, scope: Sequence[str], before: str, after: str) -> DataFrame:
    """(scope, after, root, steps): where each chain of links that ends in `after` begins, and how many links that is.

    Pointers double: each round a link points as far back again as it did, so a chain of
    n links takes log n rounds, each of one equi-join, written. Of two links to one
    `after` the lesser `before` counts; a circle has no beginning and is left out.
    """
    up = links.where(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(*scope, after).agg(F.min(before).alias("root")).withColumn("steps", F.lit(1).cast("long"))
    up = written(up, "chains")
    most = up.count()
    while True:
        above = up.select(*scope, F.col(after).alias("root"), F.col("root").alias("__top"), F.col("steps").alias("__more"))
        jumped = up.join(above, [*scope, "root"], "left")
        moved = jumped.select(*scope, after, F.coalesce("__top", "root").alias("root"), (F.col("steps") + F.coalesce("__more", F.lit(0))).alias("steps"), F.col("__top").isNotNull().alias("__moved"))
        # No chain has more steps than there are links: what still moves beyond that goes in a circle.
        up = written(moved.where(F.col("steps") <= most), "chains")
        if up.where("__moved").isEmpty():
            return up.drop("__moved")
        up = up.drop("__moved")
