"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition of the table is a leaf: its rows sorted by digest, with one entry
for each digest, are its run. In binomial rounds, nodes send their runs to the node
whose number has their lowest bits cleared, `bits` of them a round, until all runs
have come to node 0; there the incoming runs are merged in one pass over sorted
entries, which holds one entry at a time. An entry has the number of its rows, the
identifier that stays and what verifies the digest: the text's size and a second,
independent hash; entries merge where all three agree.

Runs are cut into slices by digest, so a round is spread over all tasks to the
last, and a digest that a third of all rows share is one entry per leaf before
anything is sent. The answer goes back down by (leaf, digest), so no leaf's rows
meet another's.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import UNNAMED, Scratch, fresh, named, stored

KEY = ["text_sha256", "size", "second"]
RUN = pa.schema([("node", pa.int32()), ("slice", pa.int32()), ("text_sha256", pa.binary()), ("size", pa.int64()), ("second", pa.int64()), ("n", pa.int64()), ("top", pa.int64())])
RUN_DDL = "node int, slice int, text_sha256 binary, size long, second long, n long, top long"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; the fast built-in serves where it does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each key of sorted entries: n added up, the greatest top."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(RUN)
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for name in ("node", "slice", "size", "second"):
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        digest = table.column("text_sha256").combine_chunks()
        new[1:] |= pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        n, top = np.add.reduceat(table.column("n").to_numpy(), first), np.maximum.reduceat(table.column("top").to_numpy(), first)
        out = table.take(pa.array(first)).select(RUN.names[:5]).append_column("n", pa.array(n)).append_column("top", pa.array(top)).cast(RUN)
        held = out.slice(len(first) - 1)
        yield from out.slice(0, len(first) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The largest doc_id of a group stays; of repeated rows with that doc_id all stay.
    A null doc_id is below any other; in a group of null doc_ids keep_id is null and
    all rows stay. An empty table gives no rows; other columns are ignored; text
    length is no matter. 2 ** bits runs at most meet in a merge.
    """
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    normal = ascii_lower(F.col("text"))
    with Scratch() as scratch:
        hashed = named(docs).select("doc_id", "d", F.unhex(F.sha2(normal, 256)).alias("text_sha256"), F.octet_length("text").cast("long").alias("size"), F.xxhash64(normal).alias("second"), F.spark_partition_id().alias("leaf"))
        hashed = scratch.stored(hashed, "digests")
        width = (hashed.agg(F.max("leaf")).first()[0] or 0) + 1

        def run(df: DataFrame) -> DataFrame:
            """Sorted entries of (node, slice), merged within each partition."""
            return df.sortWithinPartitions("node", "slice", *KEY).mapInArrow(merged, RUN_DDL)

        def exchanged(df: DataFrame) -> DataFrame:
            """The runs of a node, slice by slice in one partition each, merged."""
            return run(df.repartition(slices, "node", "slice"))

        part = F.pmod(F.hash("text_sha256"), F.lit(slices)).cast("int")
        entries = hashed.select(F.col("leaf").alias("node"), part.alias("slice"), *KEY, F.lit(1).cast("long").alias("n"), F.col("d").alias("top"))
        leaves = scratch.stored(exchanged(run(entries)), "runs")
        root, done = leaves, 0
        while width > 1 << done:
            done += bits
            root = scratch.stored(exchanged(root.withColumn("node", F.shiftleft(F.shiftright("node", done), done))), "runs")
        groups = root.where("n > 1").select(*KEY, F.col("n").alias("group_size"), F.col("top").alias("keep"))
        down = leaves.select(F.col("node").alias("leaf"), *KEY).join(groups, KEY)
        out = hashed.join(down, ["leaf", *KEY], "left").withColumn("keep", F.coalesce("keep", "d"))
        out = out.select("doc_id", F.when(F.col("keep") != UNNAMED, F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("keep") == F.col("d")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))
        return stored(out, "exact")


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns and any names, without the rows that duplicates() does not keep.

    Null texts are equal to empty ones; repeated rows of the doc_id that stays all
    stay; rows with a null doc_id go where a doc_id has the same text; long texts
    are told apart by digest alone; an empty table gives none.
    """
    mark, digest = fresh(docs, "gone_id", "gone_sha")
    gone = duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias(mark), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(mark)) & (sha == F.col(digest)), "left_anti")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
