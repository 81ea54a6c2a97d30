"""Work folders and sinks: shared scratch space, partition replacement, safe CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; one of our own only in a local session that has none."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rostrum-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that all executors share: its plan ends there, and lost executors cost no more than a task."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in three parts a core, evenly or by keys: a small file is one task otherwise, however dear its rows are."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def divided(df: DataFrame, rows: int, *keys: str, each: int = 400_000) -> DataFrame:
    """df of about so many rows by keys, in parts of `each` and as many as shuffles have at least: what a task holds does not grow with the input."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), *keys)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df over exactly the partitions that it has rows of; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in which no text cell can be taken for a formula."""
    from rostrum.functions.text import safe_cell

    cells = [safe_cell(df[c]).alias(c) if t == "string" else df[c] for c, t in df.dtypes]
    df.select(*cells).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
