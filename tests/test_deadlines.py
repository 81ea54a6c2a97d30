"""Deadlines by rules in local time, merged, and the reminders that follow, on small fixtures."""

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from rostrum.operators import deadlines

RULES = "a string, b string, type string, days int, weeks int, weekday int, clock string, surcharge int, blocking boolean"
EVENTS = "event int, start date, zone string, a string, b string, type string"


def at(text, zone="UTC"):
    return datetime.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).astimezone(datetime.UTC).replace(tzinfo=None)


def test_rules(spark):
    rules = [
        (None, None, "ordinary", 10, None, None, "23:59:59", 5, False), ("x", None, "ordinary", None, 2, 3, "12:00:00", 6, False), ("x", "y", "ordinary", 1, None, None, "00:30:00", 7, True),
        (None, "y", "final", 7, None, None, "20:00:00", None, True), (None, "y", "final", 9, None, None, "20:00:00", None, True),
    ]
    day = datetime.date
    events = [
        (1, day(2024, 4, 5), "Europe/Madrid", None, None, "own"), (2, day(2024, 4, 6), "Europe/Madrid", "x", None, "own"), (3, day(2024, 3, 31), "Europe/Madrid", "x", "y", "own"), (4, day(2024, 4, 5), "America/Bogota", "z", "y", "own"),
        (5, None, "Europe/Madrid", "x", "y", "own"), (6, day(2024, 4, 5), None, "x", "y", "own"),
    ]
    df = deadlines.by_rules(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rules, RULES), ["a", "b"])
    got = {(r.event, r.type): (r.at, r.surcharge, r.blocking) for r in df.collect()}
    assert got == {
        (1, "ordinary"): (at("2024-03-26 23:59:59", "Europe/Madrid"), 5, False),
        (2, "ordinary"): (at("2024-03-21 12:00:00", "Europe/Madrid"), 6, False),  # the Thursday two weeks before the week of a Saturday
        (3, "ordinary"): (at("2024-03-30 00:30:00", "Europe/Madrid"), 7, True), (3, "final"): (at("2024-03-22 20:00:00", "Europe/Madrid"), None, True),
        (4, "ordinary"): (at("2024-03-26 23:59:59", "America/Bogota"), 5, False), (4, "final"): (at("2024-03-27 20:00:00", "America/Bogota"), None, True),
    }
    assert deadlines.by_rules(spark.createDataFrame([], EVENTS), spark.createDataFrame(rules, RULES), ["a", "b"]).count() == 0
    assert deadlines.by_rules(spark.createDataFrame(events, EVENTS), spark.createDataFrame([], RULES), ["a", "b"]).count() == 0


def test_instants(spark):
    days = [(datetime.date(2024, m, d), z) for m, d in ((1, 15), (3, 31), (7, 15), (10, 27)) for z in ("Europe/Madrid", "America/Bogota", "Australia/Sydney")]
    df = spark.createDataFrame(days, "d date, z string").select("d", "z", deadlines.instant(F.col("d"), F.lit("23:59:59"), F.col("z")).alias("t"))
    for r in df.collect():
        assert r.t == at(f"{r.d} 23:59:59", r.z), r


def test_merge(spark):
    schema = "event int, type string, at timestamp, surcharge int, blocking boolean"
    published = [(1, "ordinary", at("2024-01-05"), None, None), (1, "ordinary", at("2024-01-04"), None, False), (1, "late", at("2024-01-09"), 9, True), (2, "ordinary", None, 1, True), (None, "late", at("2024-01-01"), 1, True)]
    computed = [(1, "ordinary", at("2024-01-02"), 5, True), (2, "ordinary", at("2024-01-03"), 6, False)]
    got = sorted(tuple(r) for r in deadlines.merged(spark.createDataFrame(published, schema), spark.createDataFrame(computed, schema)).collect())
    assert got == [
        (1, "late", at("2024-01-09"), 9, True, "published"), (1, "ordinary", at("2024-01-04"), 5, True, "published + computed"), (2, "ordinary", at("2024-01-03"), 6, False, "computed"),
    ]


def test_reminders(spark):
    now = "2024-06-01 12:00:00"
    entries = [
        (1, 1, "draft", "a@x", "b@x"), (2, 1, "pending_club", "a@x", "a@x"), (3, 1, "submitted", "a@x", None), (4, 1, "draft", None, ""), (5, 2, "draft", "c@x", None), (6, 3, "draft", "d@x", None), (7, 4, "draft", "e@x", None),
        (8, 9, "draft", "f@x", None), (1, 1, "draft", "a@x", "b@x"), (None, 1, None, "g@x", None), (9, 5, "club_approved", "h@x", None),
    ]
    ends = [
        (1, "ordinary", at("2024-06-03 22:00:00"), False), (1, "late", at("2024-06-02 10:00:00"), False), (1, "ordinary", at("2024-05-30 10:00:00"), False),
        (2, "ordinary", at("2024-06-04 12:00:01"), False), (3, "ordinary", at("2024-06-04 12:00:00"), False), (4, "final", at("2024-06-01 12:00:01"), True), (4, "ordinary", at("2024-06-02 12:00:00"), False),
        (5, "ordinary", at("2024-06-02 12:00:00"), False), (5, "final", at("2024-06-02 12:00:00"), True),
    ]
    e = spark.createDataFrame(entries, "entry int, event int, status string, owner string, guardian string")
    d = spark.createDataFrame(ends, "event int, type string, at timestamp, blocking boolean")
    sent = spark.createDataFrame([], "key string")
    first = deadlines.reminders(e, d, sent, F.lit(f"{now}+00:00").cast("timestamp"))
    rows = first.collect()
    assert sorted((r.entry, r.mail, r.type, r.days) for r in rows) == [
        (1, "a@x", "ordinary", 3), (1, "b@x", "ordinary", 3), (2, "a@x", "ordinary", 3), (6, "d@x", "ordinary", 3), (7, "e@x", "final", 1), (9, "h@x", "final", 1),
    ]
    assert "deadline:1:ordinary:2024-06-03:a@x" in {r.key for r in rows}
    again = deadlines.reminders(e, d, first.where("entry <> 7"), F.lit(f"{now}+00:00").cast("timestamp"))
    assert [r.entry for r in again.collect()] == [7]
    assert deadlines.reminders(e.limit(0), d, sent, F.current_timestamp()).count() == 0
