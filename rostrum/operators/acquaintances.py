"""Whom people met most: lists of each meeting's people sent to each of them, and counted where all lists of a person are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lists(bouts: DataFrame, people: DataFrame, group: str) -> DataFrame:
    """(me, near, far, fought): for each person of each group, its other people of the same country, its others, and the rival of every bout there.

    bouts: group, a and b; people: id (once each) and country. People who are not among
    `people` are in no list but `fought`. Bouts without a group have rivals alone. A
    group's people meet in one row, so they must be few.
    """
    known = people.select("id", F.struct("id", "country").alias("who"))
    sides = bouts.select(group, "a", "b").join(known.toDF("a", "one"), "a", "left").join(known.toDF("b", "other"), "b", "left")
    # Narrow rows are shuffled, not what a partial aggregate makes of them.
    per = sides.where(F.col(group).isNotNull()).repartition(group).groupBy(group).agg(F.collect_list(F.struct("a", "b")).alias("bouts"), F.array_union(F.collect_set("one"), F.collect_set("other")).alias("all"))
    own = per.select("bouts", "all", F.explode("all").alias("own"))
    others = F.filter("all", lambda p: p["id"] != F.col("own.id"))
    same = lambda p: F.coalesce(p["country"] == F.col("own.country"), F.lit(False))
    ids = lambda of: F.transform(of, lambda p: p["id"])
    mine = F.filter("bouts", lambda x: (x["a"] == F.col("own.id")) | (x["b"] == F.col("own.id")))
    rivals = F.transform(mine, lambda x: F.when(x["a"] == F.col("own.id"), x["b"]).otherwise(x["a"]))
    out = own.select(F.col("own.id").alias("me"), ids(F.filter(others, same)).alias("near"), ids(F.filter(others, lambda p: ~same(p))).alias("far"), rivals.alias("fought"))
    alone = bouts.where(F.col(group).isNull()).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    none = F.array().cast("array<long>")
    return out.union(alone.select("x.a", none, none, F.array("x.b")))


def closest(met: DataFrame, k: int, bout: int, country: int) -> DataFrame:
    """(me, other, score, rn): the k others whom each person of met (as lists() gives it) shares most with, equal ones by id.

    A common group counts one, a bout `bout`, a common country `country`; who has no
    common group is nobody's. A person's lists are added up batch by batch, so a task
    holds one sum per person met.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = None
        ids, total, shared, close = (np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            me = batch.column("me")[:1]
            near, far, fought = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("near", "far", "fought"))
            one = np.ones(len(near) + len(far), np.int64)
            more = np.concatenate([one, np.full(len(fought), bout)])
            common = np.concatenate([one, np.zeros(len(fought), np.int64)])
            alike = np.zeros(len(more), np.int64)
            alike[: len(near)] = 1
            ids, at = np.unique(np.concatenate([ids, near, far, fought]), return_inverse=True)
            sums = []
            for before, now in ((total, more), (shared, common), (close, alike)):
                out = np.zeros(len(ids), np.int64)
                np.add.at(out, at, np.concatenate([before, now]))
                sums.append(out)
            total, shared, close = sums
        score = (total + country * (close > 0))[shared > 0]
        who = ids[shared > 0]
        first = np.lexsort((who, -score))[:k]
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), me[0].as_py())), pa.array(who[first]), pa.array(score[first]), pa.array(np.arange(1, len(first) + 1))], names=["me", "other", "score", "rn"])

    return met.groupBy("me").applyInArrow(best, "me long, other long, score long, rn long")
