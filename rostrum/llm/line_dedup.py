"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches. The hashes of a batch's lines are anti-joined against
the runs that exist: unseen ones become a new run, bucketed and sorted by hash;
those seen before go to a small log of repeats. When a level has `fanout` runs
they are compacted into one run of the next level, so a hash is rewritten a
logarithmic number of times and a batch meets few runs. Runs are disjoint, and a
repeat meets its run bucket by bucket, so counts never need one shuffle of all
lines. A hash counts documents, not lines, and remembers the largest doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, named, stored
from rostrum.llm.exact import ascii_lower

BLANK = " \t\n\x0b\x0c\r"


class LineRuns:
    """Levelled runs of (hash, number of documents, largest document) as bucketed tables in the warehouse, until scratch ends."""

    def __init__(self, scratch: Scratch, fanout: int = 2):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, run: DataFrame) -> DataFrame:
        return self.scratch.bucketed(run, "line_run", ["h"], sort=True)

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (h, d): new hashes as a run, known ones to the repeats."""
        # Documents of a hash first, then their number: a line of a third of all documents is one row per task in either step.
        own = self.scratch.stored(keys.distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("d").alias("top")), "batch")
        unseen = reduce(lambda left, run: left.join(run.select("h"), "h", "left_anti"), self.tables(), own)
        run = self._write(unseen)
        if self.levels:
            self.repeats.append(self.scratch.stored(own.join(run.select("h"), "h", "left_anti"), "repeats"))
        self._place(run, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            above = self._write(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._place(above, level + 1)

    def common(self, least: int) -> DataFrame:
        """(h, top) of the hashes that at least so many documents hold."""
        runs = reduce(DataFrame.unionByName, self.tables())
        if self.repeats:
            more = reduce(DataFrame.unionByName, self.repeats).groupBy("h").agg(F.sum("n").alias("n2"), F.max("top").alias("top2"))
            runs = runs.join(more, "h", "left").select("h", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
        return runs.where(F.col("n") >= least).select("h", "top")


def drop_common_lines(docs: DataFrame, shortest: int = 20, least: int = 3, batches: int = 4, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (with_text: kept_text) for every row.

    A line's key is the line without blanks at its ends and with A-Z lower-cased;
    keys of `shortest` code points or more found in `least` documents or more lose
    all their lines but those of the largest doc_id. Null and empty texts have one
    empty line. Rows with one doc_id count as one document and each comes back; a
    null doc_id is one document below all others. Keys are compared by 128 bits of
    SHA-256. Texts of any length are split whole. An empty table gives no rows;
    other columns are ignored.
    """
    whole = named(docs)
    lines = whole.select("d", "x", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("d", "x", "pos", F.btrim("line", F.lit(BLANK)).alias("key")).where(F.char_length("key") >= shortest)
    lines = lines.select("d", "x", "pos", F.substring(F.sha2(ascii_lower(F.col("key")), 256), 1, 32).alias("h"), F.pmod(F.xxhash64("d"), F.lit(batches)).cast("int").alias("batch"))
    with Scratch() as scratch:
        lines = scratch.stored(lines, "lines")
        runs = LineRuns(scratch)
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("h", "d"))
        common = scratch.stored(runs.common(least), "common")
        lost = lines.join(common, "h").where(F.col("d") != F.col("top")).groupBy("d", "x").agg(F.collect_set("pos").alias("lost"))
        whole = whole.select("doc_id", "d", "x", F.split("text", "\n", -1).alias("lines")).join(lost, ["d", "x"], "left")
        whole = whole.withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
        stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
        kept = F.when(F.size("lost") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
        out = whole.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept_text"))
        out = out.withColumn("kept_sha256", F.sha2("kept_text", 256))
        return stored(out if with_text else out.drop("kept_text"), "lines-kept")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.top IS NOT NULL AND c.top <> k.doc_id AS lost FROM k LEFT JOIN c ON c.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
