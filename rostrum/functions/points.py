"""Points: the logarithmic formula, step tables, coefficients, rounding. Unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published step values of the points table, and the formula's scale and ceiling.
STEPS = {(1, 1): 1414, (2, 2): 1212, (3, 4): 1010, (5, 8): 808, (9, 16): 606, (17, 32): 404, (33, 64): 202, (65, 128): 101}
SCALE, CEILING = 1000.0, 1.01
EPSILON = 2.220446049250313e-16


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounding of halves upwards, after the smallest of nudges."""
    by = 10**digits
    return F.floor((value + F.lit(EPSILON)) * by + 0.5) / by


def step(place: Column, steps: dict[tuple[int, int], int] = STEPS) -> Column:
    """The largest step whose range holds the place; null outside all."""
    return F.greatest(*[F.when(place.between(lo, hi), v) for (lo, hi), v in steps.items()], F.lit(None).cast("int"))


def formula(place: Column, participants: Column, coefficient: Column) -> Column:
    """coefficient * (step + scale * (ceiling - log place / log participants)), to cents; null where it means nothing."""
    fits = (participants >= 2) & place.between(1, participants) & step(place).isNotNull() & coefficient.isNotNull()
    raw = coefficient * (step(place) + SCALE * (CEILING - F.log10(place.cast("double")) / F.log10(participants.cast("double"))))
    return F.when(fits, half_up(raw))


def most_specific(table: Column, *keys: Column) -> Column:
    """The value of the first key that a map holds."""
    return F.coalesce(*[F.try_element_at(table, k) for k in keys])


def carried(points: Column, share: Column) -> Column:
    """Points of the season before at a share; null when either is unknown."""
    return half_up(points * share)
