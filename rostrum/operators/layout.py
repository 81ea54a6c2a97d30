"""Tables out of words with places on a page: lines, cells and columns by the gaps between coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: Sequence[str], by: Sequence[str], fresh, name: str) -> DataFrame:
    """df with the running number, from 1, of the stretches that begin where `fresh` holds, in the order of `by`."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__fresh", fresh(w)).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def lines(words: DataFrame, page: Sequence[str], slack: float = 3.0) -> DataFrame:
    """words with `line`, from 1 at the top of a page: a new one begins where y is more than `slack` below the word before.

    words: page columns, x, y (from the top), width, text. Words without text or place are left out.
    """
    known = words.dropna(subset=["x", "y", "text"]).where("text <> ''").withColumn("width", F.coalesce("width", F.lit(0.0)))
    return _numbered(known, page, ["y", "x", "text"], lambda w: (F.coalesce(F.col("y") - F.lag("y").over(w) > slack, F.lit(True))).cast("int"), "line")


def cells(words: DataFrame, page: Sequence[str], gap: float = 8.0) -> DataFrame:
    """(page, line, cell, x, text): the words of a line that stand closer than `gap` to what is left of them, as one text."""
    w = Window.partitionBy(*page, "line").orderBy("x", "text")
    before = words.withColumn("__end", F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parted = _numbered(before, [*page, "line"], ["x", "text"], lambda _: F.coalesce(F.col("x") - F.col("__end") > gap, F.lit(True)).cast("int"), "cell")
    ordered = F.array_sort(F.collect_list(F.struct("x", "text")))
    return parted.groupBy(*page, "line", "cell").agg(F.min("x").alias("x"), F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))


def columns(of: DataFrame, page: Sequence[str], slack: float = 12.0) -> DataFrame:
    """cells with `column`, from 1 at the left of a page: starts that lie within `slack` of the one to their left share it."""
    return _numbered(of, page, ["x"], lambda w: F.coalesce(F.col("x") - F.lag("x").over(w) > slack, F.lit(True)).cast("int"), "column")


def rows(words: DataFrame, page: Sequence[str], fields: Sequence[str], leading: str = "^[0-9]+$", slack: float = 3.0, gap: float = 8.0, column_slack: float = 12.0) -> DataFrame:
    """(page, row, fields): table rows of pages, one string per field, from words with places.

    A row begins at a line whose first cell matches `leading` where the leftmost such cell
    of the page begins; lines below it without a cell there continue its cells, as long
    names do. Lines above the first row (titles)
    and lines with other text in the first column (feet, repeated headings) are left
    out, and so is what continues them. Columns are told by where the cells of rows
    begin, so a page's own layout decides; cells right of the last field are dropped, a
    missing cell is null. A page is one group of every window: its words bound a task,
    not those of a document.
    """
    lined = cells(lines(words, page, slack), page, gap)
    # Only lines of rows say where columns are: a title begins anywhere.
    first = Window.partitionBy(*page, "line")
    leads = (F.col("cell") == 1) & F.col("text").rlike(leading)
    marked = lined.withColumn("__left", F.min(F.when(leads, F.col("x"))).over(Window.partitionBy(*page)))
    marked = marked.withColumn("__begins", F.max(leads & (F.col("x") <= F.col("__left") + column_slack)).over(first))
    other = F.max(F.when((F.col("cell") == 1) & ~F.col("__begins"), F.col("x") <= F.col("__left") + column_slack)).over(first)
    marked = marked.withColumn("__kind", F.when(F.col("__begins"), "row").when(F.coalesce(other, F.lit(True)), "other").otherwise("more"))
    down = Window.partitionBy(*page).orderBy("line", "cell").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("__kind") != "more", F.struct(F.col("line").alias("line"), (F.col("__kind") == "row").alias("row"))), ignorenulls=True).over(down)
    kept = marked.withColumn("__head", head).where("__head.row").withColumn("row", F.col("__head.line"))
    placed = columns(kept.select(*page, "row", "line", "x", "text"), page, column_slack)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "text"))), lambda s: s["text"]), " ")
    whole = placed.groupBy(*page, "row", "column").agg(joined.alias("text"))
    return whole.groupBy(*page, "row").agg(*[F.max(F.when(F.col("column") == k, F.col("text"))).alias(f) for k, f in enumerate(fields, 1)])
