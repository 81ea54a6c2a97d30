"""Bracketed records, words with places on a page, phrases and calendar feeds, on small fixtures."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from rostrum.operators import feeds, layout, phrases
from rostrum.plans import catalogue
from rostrum.plans.readings import feed_events
from rostrum.sources.records import parsed, read_records

SF = "/root/testdata/sf0.001"

POOL = """; a comment
{[classe poule] [numero 2] [etat termine]
 [les_tir_feuille (7 8 9)]
 [grille ((() (v 5) (w 4)) ((d 3) () (a ())) ((d 1) (xx ()) ()))]}"""
BRACKET = '{[classe tableau] [nom A4] [les_matches ({[match (7 8 15 9 7 1 2)]} {[match (9 nobody abandon 0 9 3 4)]} {[match (1)]} stray)]}'
PEOPLE = '{[cle 7] [nom "RUIZ SOL"] [prenom Ana]} {[cle 8] [nom "GIL [x]"]}'


def test_parsed():
    assert parsed(PEOPLE) == [{"cle": "7", "nom": "RUIZ SOL", "prenom": "Ana"}, {"cle": "8", "nom": "GIL [x]"}]
    assert parsed('word {[a 1 (2 "3 4" ())] [b]}') == [{"a": ["1", ["2", "3 4", []]], "b": []}]
    assert parsed("") == []
    for bad in ("{[a 1]", "[a 1}", ")", "{[a (1]}"):
        with pytest.raises(ValueError):
            parsed(bad)


def test_records(spark):
    texts = {1: POOL, 2: BRACKET, 3: PEOPLE, 4: "q;1;7;x\nq;2;8;y\n", 5: "{[a 1]", 6: "", 7: None, 8: POOL.replace("(7 8 9)", "(7 8)"), 9: "ciphered \x00 text", 10: POOL.replace("[numero 2]", "")}
    files = spark.createDataFrame([(k, t, "own") for k, t in texts.items()], "file int, text string, kind0 string")
    rows, refused = read_records(files, "text")
    got = {}
    for r in rows.collect():
        got.setdefault(r.file, []).append(tuple(r)[3:])
    assert sorted(got[1]) == sorted([("pool", "2", "7", "8", 5, 3, "7", None), ("pool", "2", "7", "9", 4, 1, "7", None), ("pool", "2", "8", "9", None, None, None, None)])
    assert got[2] == [("bracket", "A4", "7", "8", 15, 9, "7", None), ("bracket", "A4", "9", None, None, 0, "9", None)]
    assert got[3] == [("person", "Ana", "7", "RUIZ SOL", None, None, None, None), ("person", None, "8", "GIL [x]", None, None, None, None)]
    assert [r[-1] for r in got[4]] == [1, 2] and set(got) == {1, 2, 3, 4}
    assert {r.file for r in refused.collect()} == {5, 6, 8, 9, 10}
    assert rows.where("file = 1").columns[:3] == ["file", "text", "kind0"]


WORDS = "page long, x double, y double, width double, text string"


def test_layouts(spark):
    """Two layouts with a title, a foot, a name on two lines, an empty cell and a tie."""
    def list_of(page, scale):
        table = [("1", "RUIZ SOL Ana", "ATM", "90.5"), ("2", "GIL", None, "80"), ("2", "MAR LEO Teo", "CEB", "80")]
        words = [(page, 150.0, 5.0, 40.0, "2024"), (page, 20.0, 500.0, 30.0, "Page"), (page, 55.0, 500.0, 5.0, "1")]
        for k, row in enumerate(table):
            y = 40.0 + 20 * k
            for x, text in zip((20.0, 60.0, 200.0, 260.0), row, strict=True):
                at = x * scale
                for n, w in enumerate((text or "").split()):
                    if n == 2 and page == 2:
                        words.append((page, x * scale, y + 8, 15.0, w))
                    elif w:
                        words.append((page, at, y + (n % 2), len(w) * 5.0, w))
                        at += len(w) * 5.0 + 3
        return words

    words = list_of(1, 1.0) + list_of(2, 1.6) + [(3, 10.0, 10.0, 5.0, "nothing"), (4, None, 1.0, 1.0, "x"), (4, 1.0, 1.0, None, ""), (4, 1.0, 1.0, None, None)]
    got = layout.rows(spark.createDataFrame(words, WORDS), ["page"], ["place", "name", "club", "points"])
    want = [("1", "RUIZ SOL Ana", "ATM", "90.5"), ("2", "GIL", None, "80"), ("2", "MAR LEO Teo", "CEB", "80")]
    found = sorted((r.page, r.row, r.place, r.name, r.club, r.points) for r in got.collect())
    assert [f[2:] for f in found if f[0] == 1] == want and [f[2:] for f in found if f[0] == 2] == want
    assert {f[0] for f in found} == {1, 2}
    assert layout.rows(spark.createDataFrame([], WORDS), ["page"], ["place"]).count() == 0


def test_phrases(spark):
    known = [("grand prix", "gp"), ("grand prix de paris", "parisgp"), ("prix de", "never"), ("la coruna", "coruna"), ("champ", "campeonato"), ("monde", "mundo"), ("grand prix", "zz"), ("", "x"), ("jeux olympiques", "olimpico juegos")]
    texts = {
        1: "grand prix de paris", 2: "grand prix de rome", 3: "la coruna champ du monde", 4: "la la coruna", 5: "", 6: None, 7: "prix prix de prix", 8: "jeux olympiques grand", 9: "grand prix grand prix",
    }
    df = spark.createDataFrame([(k, None if t is None else t.split(" "), "x") for k, t in texts.items()], "doc int, t array<string>, words string")
    dictionary = spark.createDataFrame(known, "phrase string, means string")
    got = {r.doc: (r.words, r.terms) for r in phrases.terms(df, "doc", "t", dictionary, ("de", "du", "la"), {"mundial": ("campeonato", "mundo"), "jjoo": ("juegos", "olimpico")}).collect()}
    best = {}
    for p, m in known:
        if p:
            best[p] = min(m, best.get(p, m))
    for k, text in texts.items():
        t, out, i = (text or "").split(), [], 0
        while i < len(t):
            n = next((n for n in (4, 3, 2, 1) if i + n <= len(t) and " ".join(t[i : i + n]) in best), 0)
            out += best[" ".join(t[i : i + n])].split() if n else [t[i]]
            i += n or 1
        out = [w for w in out if w not in ("de", "du", "la")]
        terms = {w for w in t + out if w not in ("de", "du", "la")}
        terms |= {"mundial"} if {"campeonato", "mundo"} <= terms else set()
        terms |= {"jjoo"} if {"juegos", "olimpico"} <= terms else set()
        assert got[k] == (out, sorted(terms)), k
    assert got[1][0] == ["parisgp"] and got[3][0] == ["coruna", "campeonato", "mundo"] and "mundial" in got[3][1] and "jjoo" in got[8][1]
    nothing = phrases.terms(df, "doc", "t", dictionary.limit(0))
    assert {r.doc: r.words for r in nothing.collect()}[2] == ["grand", "prix", "de", "rome"]


def test_zone_rules():
    madrid = feeds.zone_rules("Europe/Madrid", 2024, 2024).split("\r\n")
    assert madrid[:2] == ["BEGIN:VTIMEZONE", "TZID:Europe/Madrid"] and madrid[-1] == "END:VTIMEZONE"
    assert [x for x in madrid if x.startswith("DTSTART")] == ["DTSTART:20240101T000000", "DTSTART:20240331T020000", "DTSTART:20241027T030000"]
    assert madrid[madrid.index("DTSTART:20240331T020000") - 1] == "BEGIN:DAYLIGHT" and "TZOFFSETTO:+0200" in madrid
    assert feeds.zone_rules("America/Bogota", 2020, 2024).count("BEGIN:STANDARD") == 1 and "-0500" in feeds.zone_rules("America/Bogota", 2020, 2024)
    assert "+0545" in feeds.zone_rules("Asia/Kathmandu", 2024, 2024)
    assert feeds.zone_rules("Mars/Base", 2024, 2024) is None and feeds.zone_rules(None, 2024, 2024) is None and feeds.zone_rules("../etc", 2024, 2024) is None


def unfolded(ics):
    assert ics.endswith("\r\n") and "\n" not in ics.replace("\r\n", "")
    lines = ics[:-2].split("\r\n")
    assert all(0 < len(x.encode()) <= 75 for x in lines)
    return ics[:-2].replace("\r\n ", "").split("\r\n")


def written_plainly(e, placed):
    """An event's lines, from its row."""
    import zlib

    note = lambda s: s.replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\n", "\\n")
    m = re.fullmatch(r"([01]?\d|2[0-3]):([0-5]\d)", e.clock or "")
    clock = f"{int(m[1]):02d}:{m[2]}:00" if m else ""
    stop = e.stop or e.start
    out = ["BEGIN:VEVENT", f"UID:{e.uid}", "DTSTAMP:20260101T000000Z"]
    if clock and placed:
        at = datetime.datetime.combine(e.start, datetime.time(int(m[1]), int(m[2])))
        out += [f"DTSTART;TZID={e.zone}:{at:%Y%m%dT%H%M%S}", f"DTEND;TZID={e.zone}:{at + datetime.timedelta(hours=feeds.HOURS):%Y%m%dT%H%M%S}"]
    else:
        out += [f"DTSTART;VALUE=DATE:{e.start:%Y%m%d}", f"DTEND;VALUE=DATE:{stop + datetime.timedelta(days=1):%Y%m%d}"]
    out += [f"{k}:{note(v)}" for k, v in (("SUMMARY", e.summary), ("LOCATION", e.location), ("DESCRIPTION", e.description)) if v]
    close = f"{e.closes:%Y%m%dT%H%M%SZ}" if e.closes else ""
    content = "|".join([e.uid, f"{e.start:%Y%m%d}", f"{stop:%Y%m%d}", clock, e.summary or "", e.location or "", close, "true" if e.cancelled else "false"])
    out += ["STATUS:CANCELLED" if e.cancelled else "STATUS:CONFIRMED", f"SEQUENCE:{zlib.crc32(content.encode()) % feeds.REVISIONS}"]
    if e.closes and not e.cancelled:
        out += ["BEGIN:VALARM", "ACTION:DISPLAY", f"TRIGGER;VALUE=DATE-TIME:{e.closes - datetime.timedelta(days=3):%Y%m%dT%H%M%SZ}", "DESCRIPTION:Entries close", "END:VALARM"]
    return [*out, "END:VEVENT"]


def test_feeds(spark):
    """Every feed of the tables against one written line by line."""
    own = {}
    for e in feed_events(spark, SF).collect():
        own.setdefault(e.feed, []).append(e)
    got = catalogue.QUERIES["ical_feeds"](spark, SF).collect()
    assert {r.feed for r in got} == set(own)
    for r in got:
        lines = unfolded(r.ics)
        events = sorted(own[r.feed], key=lambda e: (e.start, e.uid))
        want = [x for e in events for x in written_plainly(e, e.zone != "Mars/Base")]
        assert r.events == len(events) and lines[lines.index("BEGIN:VEVENT") : -1] == want
        assert lines[0] == "BEGIN:VCALENDAR" and lines[-1] == "END:VCALENDAR" and f"X-WR-CALNAME:{r.feed}" in lines
        zones = {x.removeprefix("TZID:") for x in lines if x.startswith("TZID:")}
        assert zones == {x.split("TZID=")[1].split(":")[0] for x in lines if x.startswith("DTSTART;TZID=")} and "Mars/Base" not in zones


def test_feeds_of_odd_rows(spark):
    day = datetime.date(2024, 5, 4)
    schema = "feed string, uid string, start date, stop date, clock string, zone string, summary string, location string, description string, closes timestamp, cancelled boolean, extra int"
    rows = [
        ("f", "a", day, None, "9:05", None, "", None, "é" * 90, None, None, 1), ("f", "b", day, day, "25:00", "Europe/Madrid", None, "x" * 300, None, None, True, 1),
        ("f", "c", day, None, None, None, "first", None, None, None, False, 1), ("f", "c", day + datetime.timedelta(days=1), None, None, None, "later", None, None, None, False, 1),
        (None, "d", day, None, None, None, "s", None, None, None, False, 1), ("f", None, day, None, None, None, "s", None, None, None, False, 1), ("g", "e", None, None, None, None, "s", None, None, None, False, 1),
    ]
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    (one,) = feeds.feeds(spark.createDataFrame(rows, schema), "feed", F.lit("a, b"), stamp).collect()
    lines = unfolded(one.ics)
    assert one.events == 3 and [x for x in lines if x.startswith("UID")] == ["UID:a", "UID:b", "UID:c"] and "SUMMARY:later" in lines and "X-WR-CALNAME:a\\, b" in lines
    assert "DESCRIPTION:" + "é" * 90 in lines and "LOCATION:" + "x" * 300 in lines and not any("TZID" in x for x in lines)
    assert feeds.feeds(spark.createDataFrame([], schema), "feed", F.lit("n"), stamp).count() == 0
