"""Dense numbers in a global order without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.storage import work_path


def numbered_in_order(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """df with 1-based numbers by `order`, which must tell rows apart.

    Rows go to ranges of about equal size, whatever their values, and are written
    so that a range stays what it is; ranges number themselves and add the sizes of
    those before theirs. Only those sizes, one row per range, meet in one task.
    """
    spark = df.sparkSession
    path = work_path(spark, "ranges")
    df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__own", own).join(sizes, "__range").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")
