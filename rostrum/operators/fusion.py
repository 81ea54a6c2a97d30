"""One result of the copies that several sources publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.windows import numbered


def fused(rows: DataFrame, keys: Sequence[str], source: str, order: str) -> DataFrame:
    """keys, turn and what the copies of a result say together: fact, place, bouts, participants, sources, withdrawn.

    In their order, a row joins the first result of its keys that has no copy of its
    source yet. So the nth row of a source is a copy of the nth result: the ones before
    hold that source, and no later one was made without it. A result has a copy of each
    source at most, and they are folded in order: the copy with a place is the base, of
    two with or without one that with more bouts; places that contradict each other are
    none, until a later copy brings one; bouts and field are the greatest. Rows with a
    null key are a result each, without a turn.
    """
    known = ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    copy = F.struct(F.col(order).alias("fact"), F.col(source).alias("source"), "place", "bouts", "participants")
    turns = numbered(rows.where(known), [*keys, source], [order], "turn")
    placed = lambda p: F.coalesce(p > 0, F.lit(False))

    def state(fact: Column, place: Column, bouts: Column, participants: Column, sources: Column, withdrawn: Column) -> Column:
        return F.struct(fact.alias("fact"), place.alias("place"), bouts.alias("bouts"), participants.alias("participants"), sources.alias("sources"), withdrawn.alias("withdrawn"))

    def first(c: Column) -> Column:
        return state(c["fact"], c["place"], c["bouts"], c["participants"], F.array(c["source"]), F.lit(False))

    def step(x: Column, y: Column) -> Column:
        one, other = placed(x["place"]), placed(y["place"])
        wins = (other & ~one) | ((one == other) & (F.coalesce(y["bouts"], F.lit(0)) > F.coalesce(x["bouts"], F.lit(0))))
        against = one & other & (x["place"] != y["place"])
        mine, its = F.when(one, x["place"]), F.when(other, y["place"])
        place = F.when(~against, F.when(wins, F.coalesce(its, mine)).otherwise(F.coalesce(mine, its)))
        return state(F.when(wins, y["fact"]).otherwise(x["fact"]), place, F.greatest(x["bouts"], y["bouts"]), F.greatest(x["participants"], y["participants"]), F.concat(x["sources"], F.array(y["source"])), x["withdrawn"] | against)

    copies = turns.groupBy(*keys, "turn").agg(F.sort_array(F.collect_list(copy)).alias("c"))
    together = copies.select(*keys, "turn", F.aggregate(F.slice("c", 2, F.size("c")), first(F.get("c", 0)), step).alias("r"))
    alone = rows.where(~known).select(*keys, F.lit(None).cast("long").alias("turn"), first(copy).alias("r"))
    out = together.unionByName(alone)
    return out.select(*keys, "turn", "r.fact", "r.place", "r.bouts", "r.participants", F.array_join("r.sources", ",").alias("sources"), "r.withdrawn")
