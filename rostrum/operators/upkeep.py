"""Merging into stored tables: upserts, diffs, absent rows, validation, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(stored: DataFrame, new: DataFrame, keys: Sequence[str], sticky: Sequence[str] = (), locked: Column | None = None) -> DataFrame:
    """stored after an upsert of new: new values win, but sticky columns keep what they have, and locked rows stay.

    One full outer join; the result replaces the table (or the partitions that it touches).
    """
    s, n = stored.alias("s"), new.alias("n")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    absent = F.col("n.__new").isNull()
    keep = absent if locked is None else absent | F.coalesce(locked, F.lit(False))
    joined = s.join(n.withColumn("__new", F.lit(True)).alias("n"), on, "full_outer")
    out = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c in keys:
            out.append(F.coalesce(old, fresh).alias(c))
        elif c in sticky:
            out.append(F.when(keep, old).otherwise(F.coalesce(old, fresh)).alias(c))
        else:
            out.append(F.when(keep, old).otherwise(F.coalesce(fresh, old)).alias(c))
    return joined.select(*out)


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new to append: those whose key is not there."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def decisions(stored: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, decision): created, updated or equal, per new row."""
    s = stored.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__is"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    return new.join(s, list(keys), "left").select(*keys, F.when(F.col("__is").isNull(), "created").when(same, "equal").otherwise("updated").alias("decision"))


def missing(stored: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that a full scan no longer has."""
    return stored.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def mark_missing(stored: DataFrame, seen: DataFrame, keys: Sequence[str], at: Column, mark: str) -> DataFrame:
    """stored with `mark` set to `at` where a full scan no longer has the row, and null where it does; an earlier mark stays."""
    there = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return stored.join(there, list(keys), "left").withColumn(mark, F.when(F.col("__seen").isNull(), F.coalesce(F.col(mark), at))).drop("__seen")


def update_from(stored: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """stored with the columns that values (one row per key) give its rows, nulls too, and whether any is another than before."""
    v = values.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__is"))
    joined = stored.join(v, list(keys), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = [F.when(F.col("__is"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return joined.select(*out, (F.col("__is").isNotNull() & ~same).alias("changed"))


def replace_snapshots(stored: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """stored and new, where the days that new has are its own alone."""
    return stored.join(new.select(day).distinct(), day, "left_anti").unionByName(new)


def deliver(stored: DataFrame, new: DataFrame, keys: Sequence[str], content: str, read: str) -> DataFrame:
    """(keys, content, state, read) of an inbox after notices came, one per key: new, updated (both unread), unchanged or kept."""
    s = stored.select(*keys, F.col(content).alias("__old"), F.col(read).alias("__read"), F.lit(True).alias("__stored"))
    n = new.select(*keys, F.col(content).alias("__new"), F.lit(True).alias("__came"))
    df = s.join(n, list(keys), "full_outer")
    state = F.when(F.col("__stored").isNull(), "new").when(F.col("__came").isNull(), "kept").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    kept = state.isin("kept", "unchanged") & F.col("__read")
    return df.select(*keys, F.when(F.col("__came"), F.col("__new")).otherwise(F.col("__old")).alias(content), state.alias("state"), F.coalesce(kept, F.lit(False)).alias(read))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def validated(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the names of failed checks); a check that is null has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("errors", failed)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
