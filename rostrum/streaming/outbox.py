"""Micro-batches over files of events: duplicates, windows, sessions, first and last sight, idempotent delivery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rostrum.operators.storage import work_path
from rostrum.sources.adapter import SCHEMAS


def events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a stream of files, at most `files` of them a batch."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The events as a folder: a stream reads folders, the table may be one file."""
    path = work_path(spark, "events")
    spark.read.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet").write.parquet(path)
    return path


def to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there (availableNow) into Parquet and reads it back."""
    spark = df.sparkSession
    out, checkpoint = work_path(spark, "stream"), work_path(spark, "progress")
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def deduplicated(stream: DataFrame, late: str = "35 days") -> DataFrame:
    """The first event of each person, type and key while the watermark remembers it."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return stream.withColumn("k", k).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "k"])


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; a window is given out when the watermark has passed it."""
    df = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return df.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(stream: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a person: events with less than `gap` between them."""
    df = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


SEEN = "user_id long, first timestamp, last timestamp, n long"


def _seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, n = state.get if state.exists else (None, None, 0)
    for pdf in batches:
        lo, hi = pdf.ts.min(), pdf.ts.max()
        first = lo if first is None or lo < first else first
        last = hi if last is None or hi > last else last
        n += len(pdf)
    state.update((first, last, n))
    yield pd.DataFrame({"user_id": [key[0]], "first": [first], "last": [last], "n": [n]})


def first_last_seen(stream: DataFrame) -> DataFrame:
    """First and last sight and count of each person, kept as state and given out after every batch that has them."""
    return stream.groupBy("user_id").applyInPandasWithState(_seen, SEEN, "first timestamp, last timestamp, n long", "update", GroupStateTimeout.NoTimeout)


def deliver(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch in a folder named by its number: running a batch again writes the same folder over."""

    def one(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
