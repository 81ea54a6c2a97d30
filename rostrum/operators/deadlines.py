"""Deadlines of entries: by rules in local time, published ones over them, and the reminders that follow."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.dates import anchored_before, iso

#: Statuses of entries that someone has still to do something about.
OPEN = ("draft", "pending_club", "club_approved", "federation_approved")


def instant(day: Column, clock: Column, zone: Column) -> Column:
    """The instant at which a zone's clocks show HH:mm:ss on a day, whatever the session's zone and the daylight saving."""
    part = lambda k: F.split(clock, ":")[k].cast("int")
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), part(0), part(1), part(2).cast("decimal(8,6)"), zone)


def by_rules(events: DataFrame, rules: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(event, type, at, surcharge, blocking): the deadlines that the most specific rule of each type sets.

    events: event, start, zone and the dims. rules: the dims, null where any value fits,
    type, days (before the start), or weeks and weekday (Monday 0) instead, clock,
    surcharge, blocking. Of equally specific rules the one with the most days before
    counts, then the least clock. Each event meets the rules in one equi-join on its
    values and wildcards, 2^dims keys an event. Events without start or zone have none.
    """
    # Each event with every choice of its values and wildcards; of two alike the less specific stays.
    value = lambda d, asked: (F.col(d).cast("string") if asked else F.lit(None).cast("string")).alias(d)
    keys = F.array(*[F.struct(F.lit(sum(chosen)).alias("fit"), *[value(d, asked) for d, asked in zip(dims, chosen, strict=True)]) for chosen in product((False, True), repeat=len(dims))])
    own = events.dropna(subset=["event", "start", "zone"]).withColumn("__k", F.explode(keys)).select("event", "start", "zone", F.col("__k.fit").alias("__fit"), *[F.col(f"__k.{d}").alias(f"__{d}") for d in dims])
    own = own.groupBy("event", "start", "zone", *[f"__{d}" for d in dims]).agg(F.min("__fit").alias("__fit"))
    on = [F.col(f"e.__{d}").eqNullSafe(F.col(f"r.{d}").cast("string")) for d in dims]
    met = own.alias("e").join(rules.alias("r"), on)
    day = F.when(F.col("weeks").isNotNull(), F.date_sub(anchored_before(F.col("start"), 0, 0), (F.col("weeks") * 7 - F.col("weekday")).cast("int"))).otherwise(F.date_sub("start", F.col("days").cast("int")))
    best = Window.partitionBy("event", "type").orderBy(F.desc("__fit"), F.desc_nulls_last("days"), "clock", F.desc_nulls_last("weeks"), "weekday", "surcharge")
    first = met.withColumn("__rn", F.row_number().over(best)).where("__rn = 1")
    return first.select("event", "type", instant(day, F.col("clock"), F.col("zone")).alias("at"), "surcharge", "blocking")


def merged(published: DataFrame, computed: DataFrame) -> DataFrame:
    """(event, type, at, surcharge, blocking, origin): published deadlines over computed ones, by type.

    A surcharge that is not published stays the computed one, and either can block. Of
    several published for one type the earliest counts.
    """
    first = published.dropna(subset=["event", "type", "at"]).groupBy("event", "type").agg(F.min(F.struct("at", "surcharge", "blocking")).alias("p"))
    both = first.join(computed.select("event", "type", F.struct("at", "surcharge", "blocking").alias("c")), ["event", "type"], "full")
    no, p, c = F.lit(False), F.col("p"), F.col("c")
    kept = p["surcharge"].isNull() & c["surcharge"].isNotNull()
    origin = F.when(p.isNull(), "computed").when(kept, "published + computed").otherwise("published")
    return both.select(
        "event", "type", F.coalesce(p["at"], c["at"]).alias("at"), F.coalesce(p["surcharge"], c["surcharge"]).alias("surcharge"),
        (F.coalesce(p["blocking"], no) | F.coalesce(c["blocking"], no)).alias("blocking"), origin.alias("origin"),
    )


def reminders(entries: DataFrame, deadlines: DataFrame, sent: DataFrame, now: Column, ordinary: str = "ordinary", within: int = 3) -> DataFrame:
    """(key, entry, event, mail, type, at, days): mails due for open entries whose next deadline is at most `within` days off.

    entries: entry, event, status, owner, guardian (addresses). The next deadline is the
    earliest after `now` that is the ordinary one or blocks; of two at one instant the
    blocking one. Days are begun ones. Owner and guardian get a mail each, one if they
    are the same address; empty addresses none. The key holds entry, type, day and
    address, so that a deadline that moved is told again and no other is: keys in `sent`
    (key) are left out. Entries meet one row per event.
    """
    ahead = deadlines.where((F.col("at") > now) & ((F.col("type") == ordinary) | F.col("blocking")))
    days = F.ceil((F.unix_micros("at") - F.unix_micros(now)) / F.lit(86_400_000_000))
    next_ = ahead.groupBy("event").agg(F.min(F.struct("at", (~F.col("blocking")).alias("soft"), "type")).alias("n")).select("event", "n.type", "n.at").withColumn("days", days.cast("long")).where(F.col("days") <= within)
    told = F.array_distinct(F.filter(F.array("owner", "guardian"), lambda m: m.isNotNull() & (m != "")))
    due = entries.where(F.col("status").isin(*OPEN)).select("entry", "event", F.explode(told).alias("mail")).join(next_, "event")
    key = F.concat_ws(":", F.lit("deadline"), F.col("entry").cast("string"), "type", iso(F.col("at")), "mail")
    return due.withColumn("key", key).dropDuplicates(["key"]).join(sent.select("key"), "key", "anti").select("key", "entry", "event", "mail", "type", "at", "days")
