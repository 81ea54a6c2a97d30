"""Clusters of dated rows: connected components, chains of bounded span, greedy chains over sources, weekend blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.storage import written

#: A link starts at most so many days after all before it have ended, and so many after its chain began.
GAP, SPAN = 4, 16
#: Days of the longest weekend block.
BLOCK_DAYS = 4


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of the edges (a, b): the least id that can be reached.

    Alternates large and small stars: each id hands its greater neighbours to the least
    one, then its lesser ones; edges never grow in number, and rounds are few since each
    at least halves how far the least id is. Every round is written. Null ends are no
    edge; an id with itself is a component of one.
    """
    seen = written(edges.dropna().select("a", "b"), "edges")
    rising = seen.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = rising.union(rising.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        rising = written(small.distinct(), "stars")
        now = tuple(rising.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ids = seen.select(F.col("a").alias("id")).union(seen.select("b")).distinct()
    return ids.join(rising.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def chained(df: DataFrame, keys: Sequence[str], start: str, stop: str, name: str = "chain") -> DataFrame:
    """df with the day on which each row's chain begins, null for rows without a start.

    In order of start, a row goes on with the chain while it starts at most GAP days
    after all of it have ended and SPAN days after it began; else it begins another.
    Rows that start on one day share its chain, so a key has a row a day before any are
    gathered: as many as the calendar has, whatever the number of rows. An end that is
    null or before its start counts as the start.
    """
    days = df.where(F.col(start).isNotNull()).groupBy(*keys, F.unix_date(start).alias("__d")).agg(F.unix_date(F.greatest(F.max(start), F.max(stop))).alias("__e"))
    state = "struct<d: int, e: int, s: int>"
    none = F.expr(f"cast(array() as array<{state}>)")

    def step(chain: Column, day: Column) -> Column:
        last = F.try_element_at(chain, F.lit(-1))
        goes_on = (day["__d"] <= last["e"] + GAP) & (day["__d"] - last["s"] <= SPAN)
        going = F.struct(day["__d"].alias("d"), F.greatest(last["e"], day["__e"]).alias("e"), last["s"].alias("s"))
        fresh = F.struct(day["__d"].alias("d"), day["__e"].alias("e"), day["__d"].alias("s"))
        return F.concat(chain, F.array(F.when(F.coalesce(goes_on, F.lit(False)), going).otherwise(fresh).cast(state)))

    folded = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__d", "__e"))).alias("__days")).withColumn("__chain", F.explode(F.aggregate("__days", none, step)))
    starts = folded.select(*[F.col(k).alias(f"__{k}") for k in keys], F.date_from_unix_date("__chain.d").alias("__d"), F.date_from_unix_date("__chain.s").alias(name))
    same = F.col(start) == F.col("__d")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(starts, same, "left").select(*df.columns, name)


def joined_greedily(groups: DataFrame) -> DataFrame:
    """(root, into): groups of different sources that are one event, from rows season, name, root, start, stop (days), sources, categories.

    In order of (start, root), a group joins the first chain of its season and name that
    it follows by GAP and SPAN, that has none of its sources, and whose categories hold
    its own or the other way round. Which chain is first depends on all before, so a
    season and name is read in order, holding only the chains that are still open.
    """
    schema = pa.schema([("root", pa.string()), ("into", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["season"], r["name"])):
            open_chains: list[dict] = []
            out = []
            for g in group:
                sources, categories = set(g["sources"]), set(g["categories"])
                open_chains = [c for c in open_chains if g["start"] - c["start"] <= SPAN]
                fits = (c for c in open_chains if g["start"] <= c["stop"] + GAP and not sources & c["sources"] and (categories <= c["categories"] or c["categories"] <= categories))
                chain = next(fits, None)
                if chain is None:
                    open_chains.append({"root": g["root"], "start": g["start"], "stop": g["stop"], "sources": sources, "categories": categories})
                    continue
                out.append((g["root"], chain["root"]))
                chain["stop"] = max(chain["stop"], g["stop"])
                chain["sources"] |= sources
                chain["categories"] |= categories
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)

    order = ["season", "name", "start", "root"]
    return groups.repartition("season", "name").sortWithinPartitions(*order).mapInArrow(of, "root string, into string")


def event_groups(editions: DataFrame, family: Column, national: Column) -> DataFrame:
    """(edition, event) for editions of edition, source, season, name, place, start, stop, event, categories: the least edition of the same event.

    Editions belong together that share a calendar event within a family of sources;
    that one source gives one name, season and place in one chain of days; and chains
    of different national sources with one name and season, by joined_greedily. An
    edition without a start goes with others by its calendar event alone.
    """
    keys = ["source", "season", "name", "place"]
    e = written(editions.withColumns({k: F.coalesce(k, F.lit("")) for k in keys}), "editions")
    shared = e.where(F.col("event").isNotNull()).withColumn("k", family)
    first = shared.groupBy("k", "event").agg(F.min("edition").alias("b"))
    by_event = shared.join(first, ["k", "event"]).select(F.col("edition").alias("a"), "b")
    chains = chained(e, keys, "start", "stop").where("chain IS NOT NULL")
    heads = chains.groupBy(*keys, "chain").agg(F.min("edition").alias("b"))
    by_chain = chains.join(heads, [*keys, "chain"]).select(F.col("edition").alias("a"), "b")
    alone = e.select(F.col("edition").alias("a"), F.col("edition").alias("b"))
    edges = written(by_event.union(by_chain).union(alone), "links")
    of = written(components(edges), "events")
    own = e.join(of.withColumnRenamed("id", "edition"), "edition").where(national & F.col("start").isNotNull())
    day, end = F.unix_date("start"), F.unix_date(F.greatest("start", "stop"))
    first_name = F.min_by(F.struct("season", "name"), F.col("edition"))
    groups = own.groupBy(F.col("component").alias("root")).agg(first_name.alias("n"), F.min(day).alias("start"), F.max(end).alias("stop"), F.collect_set("source").alias("sources"), F.array_distinct(F.flatten(F.collect_set("categories"))).alias("categories"))
    groups = groups.where(F.size("categories") > 0).select("n.season", "n.name", "root", "start", "stop", "sources", "categories")
    moves = joined_greedily(groups)
    last = components(written(of.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct().union(moves.select(F.col("root").alias("a"), F.col("into").alias("b"))), "moves"))
    return of.join(last.select(F.col("id").alias("component"), F.col("component").alias("event")), "component").select(F.col("id").alias("edition"), "event")


def weekend_blocks(events: DataFrame, event: str, start: str, stop: str) -> DataFrame:
    """events with block_start, block_stop and block, the key of its first event.

    In order of start, stop and id, an event joins the block before it if it starts
    within it and in the same week, and the block then has BLOCK_DAYS at most; else it
    begins one. Events of more days are a block each, and none follows into it. So of a
    week only different ranges of up to BLOCK_DAYS, and the days on which a longer event
    starts, decide: a few dozen rows, whatever the number of events. A missing or early
    end counts as the start; events without a start have no block.
    """
    day, end = F.unix_date(start), F.unix_date(F.greatest(start, stop))
    e = events.withColumns({"__d": day, "__e": end}).withColumn("__long", F.col("__e") - F.col("__d") >= BLOCK_DAYS)
    week = F.floor((F.col("__d") + 3) / 7)  # 1970-01-01 is a Thursday
    ranges = e.where("__d IS NOT NULL").groupBy(week.alias("w"), F.struct("__d", F.when(F.col("__long"), 2147483647).otherwise(F.col("__e")).alias("__e")).alias("r")).agg(F.lit(1))
    state = "struct<d: int, e: int, s: int, t: int, k: int>"

    def step(blocks: Column, r: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        joins = (r["__d"] <= last["t"]) & (F.greatest(last["t"], r["__e"]) - last["s"] < BLOCK_DAYS)
        grown = F.struct(r["__d"].alias("d"), r["__e"].alias("e"), last["s"].alias("s"), F.greatest(last["t"], r["__e"]).alias("t"), last["k"].alias("k"))
        fresh = F.struct(r["__d"].alias("d"), r["__e"].alias("e"), r["__d"].alias("s"), r["__e"].alias("t"), F.coalesce(last["k"] + 1, F.lit(0)).alias("k"))
        return F.concat(blocks, F.array(F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(fresh).cast(state)))

    # Two blocks of a week may begin on one day, with a longer event between: their number k keeps them apart.
    folded = ranges.groupBy("w").agg(F.aggregate(F.sort_array(F.collect_list("r")), F.expr(f"cast(array() as array<{state}>)"), step).alias("b"))
    rows = folded.select("w", F.explode("b").alias("x")).select("w", "x.d", "x.e", "x.k")
    short = e.where("NOT __long").withColumn("__w", week).join(rows.where("e < 2147483647"), (F.col("__w") == F.col("w")) & (F.col("__d") == F.col("d")) & (F.col("__e") == F.col("e")))
    first = F.min(F.struct(F.col("__d").alias("s"), F.col("__e").alias("e"), F.col(event).alias("id")))
    blocks = short.groupBy("w", "k").agg(first.alias("f"), F.max("__e").alias("t"))
    key = lambda s, i: F.concat_ws("_", F.date_format(F.date_from_unix_date(s), "yyyy-MM-dd"), i)
    joined = short.join(blocks, ["w", "k"]).select(*events.columns, F.date_from_unix_date("f.s").alias("block_start"), F.date_from_unix_date("t").alias("block_stop"), key(F.col("f.s"), F.col("f.id")).alias("block"))
    own = e.where("__long").select(*events.columns, F.date_from_unix_date("__d").alias("block_start"), F.date_from_unix_date("__e").alias("block_stop"), key(F.col("__d"), F.col(event)).alias("block"))
    none = e.where("__d IS NULL").select(*events.columns, F.lit(None).cast("date").alias("block_start"), F.lit(None).cast("date").alias("block_stop"), F.lit(None).cast("string").alias("block"))
    return joined.unionByName(own).unionByName(none)


def free_time(blocks: DataFrame, least: int = 7) -> DataFrame:
    """(month, first, last, days, says) between neighbouring blocks that begin in one month, of at least `least` free days.

    Of the blocks that begin on a day only the last counts, so a month has 31 rows at
    most. Weeks are said where days are a multiple of seven, give or take one.
    """
    days = blocks.where("block_start IS NOT NULL").groupBy("block_start").agg(F.max_by("block_stop", F.struct("first_stop", "block")).alias("stop"))
    month = days.groupBy(F.date_format("block_start", "yyyy-MM").alias("month")).agg(F.sort_array(F.collect_list(F.struct("block_start", "stop"))).alias("b"))
    pairs = month.select("month", F.explode(F.arrays_zip(F.slice("b", F.lit(1), F.size("b") - 1).alias("one"), F.slice("b", 2, F.size("b")).alias("next"))).alias("p"))
    out = pairs.select("month", F.date_add("p.one.stop", 1).alias("first"), F.date_sub("p.next.block_start", 1).alias("last")).withColumn("days", F.datediff("last", "first") + 1).where(F.col("days") >= least)
    weeks = F.floor((F.col("days") + 1) / 7)
    even = F.col("days") - weeks * 7 <= 1
    says = F.when(even & (weeks == 1), "1 semana libre").when(even, F.concat(weeks.cast("string"), F.lit(" semanas libres"))).otherwise(F.concat(F.col("days").cast("string"), F.lit(" días libres")))
    return out.withColumn("says", says)
