"""Calendar events as text (RFC 5545)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRLF = "\r\n"


def escaped(text: Column) -> Column:
    """Backslashes, semicolons, commas and line ends as a calendar's text value has them."""
    for plain, written in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def folded(line: Column) -> Column:
    """A line of at most 75 octets, or its parts on lines of their own that begin with a space; no character is cut apart."""
    plain = F.concat(F.substr(line, F.lit(1), F.lit(75)), F.regexp_replace(F.substr(line, F.lit(76)), "(?s)(.{1,74})", f"{CRLF} $1"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("octets"))

    def add(done: Column, c: Column) -> Column:
        size = F.octet_length(c)
        fits = done["octets"] + size <= 75
        return F.struct(F.concat(done["text"], F.when(fits, "").otherwise(f"{CRLF} "), c).alias("text"), F.when(fits, done["octets"] + size).otherwise(size + 1).alias("octets"))

    size = F.octet_length(line)
    return F.when(size <= 75, line).when(size == F.char_length(line), plain).otherwise(F.aggregate(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), start, add)["text"])


def event(uid: Column, start: Column, stop: Column, summary: Column, description: Column) -> Column:
    """An event of whole days; its end is the day after the last."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start)), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(stop, 1))),
             F.concat(F.lit("SUMMARY:"), escaped(summary)), F.concat(F.lit("DESCRIPTION:"), escaped(description)), F.lit("END:VEVENT")]
    return F.concat_ws(CRLF, *map(folded, lines))
