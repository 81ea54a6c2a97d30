"""Dates and seasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_start(day: Column, first_month: int = 9) -> Column:
    """The year in which the day's season began."""
    return F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)


def season_of(day: Column, first_month: int = 9) -> Column:
    """The season of a day, as 'YYYY-YYYY'."""
    start = season_start(day, first_month)
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def normal_season(season: Column) -> Column:
    """A season of one year, as some sources give it, as the two years that end with it."""
    alone = season.rlike("^[0-9]{4}$")
    end = F.when(alone, season).cast("int")
    return F.when(alone, F.concat_ws("-", (end - 1).cast("string"), season)).otherwise(season)


def season_end(season: Column) -> Column:
    """The last year of a season."""
    return F.regexp_extract(season, "([0-9]{4})$", 1).cast("int")


def next_season(season: Column) -> Column:
    end = season_end(season)
    return F.concat_ws("-", end.cast("string"), (end + 1).cast("string"))


def previous_season(season: Column) -> Column:
    end = season_end(season)
    return F.concat_ws("-", (end - 2).cast("string"), (end - 1).cast("string"))


def iso(day: Column) -> Column:
    """A day as YYYY-MM-DD."""
    return F.date_format(day, "yyyy-MM-dd")


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two closed intervals meet."""
    return (start_a <= end_b) & (start_b <= end_a)


def anchored_before(day: Column, weeks: int, weekday: int) -> Column:
    """The given weekday (Monday 0) of the week so many weeks before the day's week."""
    monday = F.date_sub(day, F.weekday(day).cast("int"))
    return F.date_add(monday, weekday - 7 * weeks)


def local_instant(day: Column, time: str = "23:59:59", zone: str = "Europe/Madrid") -> Column:
    """The instant of a local wall-clock time, whatever the daylight saving."""
    return F.to_utc_timestamp(F.concat_ws(" ", iso(day), F.lit(time)).cast("timestamp"), zone)


def utc_offset_hours(day: Column, zone: str, time: str = "12:00:00") -> Column:
    """Hours that a zone's clocks are ahead of UTC at a local time of a day."""
    local = F.concat_ws(" ", iso(day), F.lit(time)).cast("timestamp")
    return (F.unix_timestamp(local) - F.unix_timestamp(F.to_utc_timestamp(local, zone))) / 3600
