"""Whole calendar feeds (RFC 5545) out of tables of events: time zones, timed and whole days, alarms, one ordered text per feed."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.ical import CRLF, escaped, folded

HOURS = 4
#: Revisions of an event are numbers below this, by its content.
REVISIONS = 65_536


def _offset(minutes: float) -> str:
    return f"{'-' if minutes < 0 else '+'}{int(abs(minutes)) // 60:02d}{int(abs(minutes)) % 60:02d}"


def zone_rules(zone: str | None, first: int | None, last: int | None) -> str | None:
    """The zone's part of a feed: an observance for the start of `first` and one per change of the clock until the end of `last`; null for an unknown zone."""
    if zone is None or first is None or last is None:
        return None
    try:
        info = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    minutes = lambda at: at.astimezone(info).utcoffset().total_seconds() // 60

    def observance(local: datetime, before: float, after: float, summer: bool) -> list[str]:
        kind = "DAYLIGHT" if summer else "STANDARD"
        return [f"BEGIN:{kind}", f"DTSTART:{local:%Y%m%dT%H%M%S}", f"TZOFFSETFROM:{_offset(before)}", f"TZOFFSETTO:{_offset(after)}", f"END:{kind}"]

    at, end = datetime(first, 1, 1, tzinfo=UTC), datetime(last + 1, 1, 1, tzinfo=UTC)
    summer = lambda t: bool(t.astimezone(info).dst())
    out = ["BEGIN:VTIMEZONE", f"TZID:{zone}", *observance(datetime(first, 1, 1), minutes(at), minutes(at), summer(at))]
    while at < end:
        week = min(at + timedelta(days=7), end)
        if minutes(week) != minutes(at):
            # The minute of the change, by halves.
            low, high = at, week
            while high - low > timedelta(minutes=1):
                half = low + timedelta(minutes=(high - low) // timedelta(minutes=2))
                low, high = (half, high) if minutes(half) == minutes(at) else (low, half)
            local = (high + timedelta(minutes=minutes(low))).replace(tzinfo=None)
            out += observance(local, minutes(low), minutes(high), summer(high))
        at = week
    return CRLF.join([*out, "END:VTIMEZONE"])


def _line(name: str, value: Column) -> Column:
    """A line of a name and a text value, null where the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(f"{name}:"), escaped(value)))


def event_text(stamp: Column) -> Column:
    """One event of the columns that feeds() names."""
    day, timed = lambda c: F.date_format(c, "yyyyMMdd"), F.col("__timed")
    clock = lambda t: F.concat(F.lit(";TZID="), F.col("zone"), F.lit(":"), F.date_format(t, "yyyyMMdd'T'HHmmss"))
    begin = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format("start", "yyyy-MM-dd"), F.col("__clock")))
    whole = lambda c: F.concat(F.lit(";VALUE=DATE:"), day(c))
    close = F.date_format("closes", "yyyyMMdd'T'HHmmss'Z'")
    content = F.concat_ws("|", F.col("uid"), day(F.col("start")), day(F.col("stop")), F.coalesce("__clock", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("location", F.lit("")), F.coalesce(close, F.lit("")), F.col("cancelled").cast("string"))
    alarm = F.when(F.col("closes").isNotNull() & ~F.col("cancelled"), F.concat_ws(CRLF, F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.concat(F.lit("TRIGGER;VALUE=DATE-TIME:"), F.date_format(F.col("closes") - F.expr("INTERVAL 3 DAYS"), "yyyyMMdd'T'HHmmss'Z'")), F.lit("DESCRIPTION:Entries close"), F.lit("END:VALARM")))
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid")), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")),
        F.concat(F.lit("DTSTART"), F.when(timed, clock(begin)).otherwise(whole(F.col("start")))), F.concat(F.lit("DTEND"), F.when(timed, clock(begin + F.expr(f"INTERVAL {HOURS} HOURS"))).otherwise(whole(F.date_add("stop", 1)))),
        _line("SUMMARY", F.col("summary")), _line("LOCATION", F.col("location")), _line("DESCRIPTION", F.col("description")),
        F.when(F.col("cancelled"), "STATUS:CANCELLED").otherwise("STATUS:CONFIRMED"), F.concat(F.lit("SEQUENCE:"), (F.crc32(content) % REVISIONS).cast("string")),
    ]
    return F.concat_ws(CRLF, *map(folded, lines), alarm, F.lit("END:VEVENT"))


def feeds(events: DataFrame, feed: str, name: Column, stamp: Column) -> DataFrame:
    """(feed, events, ics): one whole feed per value of `feed`, its events by day and uid.

    events: feed, uid, start, stop (days), clock (local time as HH:mm, other text or null
    for whole days), zone, summary, location, description, closes (an instant in UTC),
    cancelled. An event whose zone is null or unknown is one of whole days, since its
    hour could not be placed. A repeated uid of a feed counts once, by the latest start.
    An event's sequence depends on its content alone, so a feed written again changes only
    where its events did. Rows without feed, uid or start are left out; a missing stop is
    the start. Zones' rules cover the years of a feed's events. A feed is one text by
    definition, so its own events bound a task; the zones are computed once per zone and
    years.
    """
    good = F.regexp_extract(F.coalesce("clock", F.lit("")), "^\\s*([01]?[0-9]|2[0-3])[:.h]([0-5][0-9])\\s*$", 0) != ""
    hour = lambda k: F.lpad(F.regexp_extract("clock", "^\\s*([0-9]{1,2})[:.h]([0-9]{2})\\s*$", k), 2, "0")
    own = events.dropna(subset=[feed, "uid", "start"]).withColumns({"stop": F.coalesce("stop", "start"), "cancelled": F.coalesce("cancelled", F.lit(False)), "__clock": F.when(good, F.concat_ws(":", hour(1), hour(2), F.lit("00")))})
    fields = ["uid", "start", "stop", "zone", "summary", "location", "description", "closes", "cancelled", "__clock"]
    own = own.groupBy(feed, "uid").agg(F.max(F.struct("start", *fields[2:])).alias("e")).select(feed, "uid", "e.*")
    years = own.where("__clock IS NOT NULL AND zone IS NOT NULL").groupBy(feed, "zone").agg(F.year(F.min("start")).alias("first"), F.year(F.max("start")).alias("last"))
    rules = F.udf(zone_rules, "string")
    # An unknown zone gives no rules, and its events whole days.
    spans = years.select("zone", "first", "last").distinct().withColumn("rules", rules("zone", "first", "last")).where("rules IS NOT NULL")
    used = years.join(spans, ["zone", "first", "last"]).select(feed, "zone", "rules")
    timed = own.join(used.select(feed, "zone", F.lit(True).alias("__placed")), [feed, "zone"], "left").withColumn("__timed", F.col("__clock").isNotNull() & F.coalesce("__placed", F.lit(False)))
    texts = timed.select(feed, "start", "uid", event_text(stamp).alias("text")).groupBy(feed).agg(F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("start", "uid", "text"))).alias("body"))
    zones = used.groupBy(feed).agg(F.array_sort(F.collect_list(F.struct("zone", "rules"))).alias("zones"))
    head = F.concat_ws(CRLF, *map(folded, (F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//rostrum//EN"), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"), F.concat(F.lit("X-WR-CALNAME:"), escaped(name)))))
    parts = F.concat_ws(CRLF, head, F.transform("zones", lambda z: z["rules"]), F.transform("body", lambda b: b["text"]), F.lit("END:VCALENDAR"))
    return texts.join(zones, feed, "left").select(feed, "events", F.concat(parts, F.lit(CRLF)).alias("ics"))
