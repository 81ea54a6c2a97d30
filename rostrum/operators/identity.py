"""Identity: merge forests of bounded depth, and scoped identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOPS = 3


def closure(people: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, root, hops): the person that merges lead to, following at most `hops` of them; longer chains stay unresolved."""
    out = people.select("id", F.col("id").alias("root"), F.lit(0).alias("hops"))
    up = people.where("merged_into IS NOT NULL").select(F.col("id").alias("root"), "merged_into")
    for _ in range(hops):
        out = out.join(up, "root", "left").select("id", F.coalesce("merged_into", "root").alias("root"), (F.col("hops") + F.when(F.col("merged_into").isNull(), 0).otherwise(1)).alias("hops"))
    return out


def members(people: DataFrame, hops: int = HOPS) -> DataFrame:
    """(root, members): everyone that merges lead to a root, in order."""
    return closure(people, hops).groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("members"))


def resolve(queries: DataFrame, ids: DataFrame, query_key: str = "query") -> DataFrame:
    """(query, state, person): confirmed, review, conflict or none.

    ids: scheme, value, source, season ('' for any), valid_from, valid_to, status,
    person. queries: query, scheme, value, source, season, day. An identifier
    speaks for a query of its scheme, value and source when its season is empty or
    equal and the day lies within its validity.
    """
    q, i = queries.alias("q"), ids.alias("i")
    fits = (
        (F.col("i.scheme") == F.col("q.scheme")) & (F.col("i.value") == F.col("q.value")) & (F.col("i.source") == F.col("q.source"))
        & ((F.col("i.season") == "") | (F.col("i.season") == F.col("q.season")))
        & (F.col("i.valid_from") <= F.col("q.day")) & (F.col("i.valid_to").isNull() | (F.col("q.day") <= F.col("i.valid_to")))
    )
    found = q.join(i, fits, "left").groupBy(F.col(f"q.{query_key}").alias(query_key)).agg(
        F.countDistinct(F.when(F.col("i.status") == "CONFIRMADO", F.col("i.person"))).alias("sure"), F.min(F.when(F.col("i.status") == "CONFIRMADO", F.col("i.person"))).alias("who"),
        F.countDistinct(F.when(F.col("i.status") == "PROPUESTO", F.col("i.person"))).alias("maybe"),
    )
    state = F.when(F.col("sure") > 1, "conflict").when(F.col("sure") == 1, "confirmed").when(F.col("maybe") > 0, "review").otherwise("none")
    return found.select(query_key, state.alias("state"), F.when(F.col("sure") == 1, F.col("who")).alias("person"))
