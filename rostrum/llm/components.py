"""Connected components by contraction: every node joins the first of its neighbours in a random order, pointers are followed, edges are relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the least id that can be reached.

    The order is another one each round, so that a chain of rising ids shrinks by
    a share and not by a step, and the number of rounds is logarithmic whatever
    the ids. Each round writes what is left, so lineage stays short. Hubs are met
    by joins on single rows per node and by minimums that are taken before the
    shuffle. Null ends count as no edge; without edges there are no rows.
    """
    with Scratch() as scratch:
        edges = scratch.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        labels, turn = edges.select(F.col("a").alias("id"), F.col("b").alias("component")), 0
        while not edges.isEmpty():
            turn += 1

            def place(c: str, turn: int = turn):
                return F.struct(F.xxhash64(F.lit(turn), c).alias("o"), F.col(c).alias("i"))

            both = edges.union(edges.select("b", "a"))
            first = both.groupBy("a").agg(F.min(place("b")).alias("p"))
            parent = scratch.stored(first.select(F.col("a").alias("id"), F.least(place("a"), "p")["i"].alias("p")), "parents")
            above = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
            jumped = scratch.stored(parent.join(above, "p").select("id", F.col("q").alias("p")), "jumped")
            if turn == 1:
                labels = jumped.select("id", F.col("p").alias("component"))
            else:
                labels = scratch.stored(labels.join(jumped.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
            one, other = jumped.select(F.col("id").alias("a"), F.col("p").alias("pa")), jumped.select(F.col("id").alias("b"), F.col("p").alias("pb"))
            edges = scratch.stored(edges.join(one, "a").join(other, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")
        least = labels.groupBy("component").agg(F.min("id").alias("least"))
        return stored(labels.join(least, "component").select("id", F.col("least").alias("component")), "components")
