"""Reading tables, shared folders for intermediate tables, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that a null doc_id has inside: below any other.
UNNAMED = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as the empty one; other columns, clashing names included, stay out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id, never null), x (hash of the text) and text: rows that share doc_id and text share (d, x)."""
    return texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(UNNAMED)).alias("d"), F.xxhash64("text").alias("x"), "text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in a local session that has none."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rostrum-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path  # type: ignore[attr-defined]
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that stored() returned."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator: deleted when it ends, however it ends. What it returns is stored() apart."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []
        self.names: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed: object) -> None:
        discard(*self.held)
        for spark, name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """stored(), until the end."""
        self.held.append(stored(df, name))
        return self.held[-1]

    def checkpointed(self, df: DataFrame) -> DataFrame:
        """df written to the shared folder until the end, and read again in the partitions that it has now."""
        context = df.sparkSession.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared_dir(df.sparkSession))
        back = df.checkpoint()
        back.stored_at = back._jdf.queryExecution().logical().rdd().getCheckpointFile().get()  # type: ignore[attr-defined]
        self.held.append(back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of stored() that nothing reads any more."""
        discard(*frames)
        self.held = [df for df in self.held if all(df is not f for f in frames)]

    def bucketed(self, df: DataFrame, name: str, keys: list[str], sort: bool = False) -> DataFrame:
        """df as a table of the warehouse in as many buckets by keys as shuffles have partitions, until the end."""
        spark = df.sparkSession
        n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
        self.names.append((spark, name))
        writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
        (writer.sortBy(*keys) if sort else writer).saveAsTable(name)
        return spark.table(name)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of a batch row by row, without a Python copy of the whole batch."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def lists(column: pa.ListArray) -> tuple[pa.Array, list[int]]:
    """The elements of all lists in one array, and where each list begins and the last one ends."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten(), [0, *lengths.cumsum().tolist()]


def chunks(found: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Tuples gathered into record batches of at most size rows."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
