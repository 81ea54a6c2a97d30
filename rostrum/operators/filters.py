"""Composable predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    """All conditions; true when there are none."""
    return reduce(and_, conditions, F.lit(True))


def is_in(value: Column, options: Sequence) -> Column:
    """Membership; false for no options."""
    return value.isin(*options) if options else F.lit(False)
