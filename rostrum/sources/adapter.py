"""Domain views over the driver's tables: bouts, results, competitions, people, publications, observations.

Each view here has a twin in `rostrum.plans.oracle`, written for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.dates import season_of
from rostrum.operators.windows import numbered

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}
WEAPONS = ("FLORETE", "ESPADA", "SABLE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; fixed columns are selected and cast, so that an odd file fails early."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fields = T.StructType.fromDDL(SCHEMAS[name]).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: two different people, their scores, phase, competition, day and season."""
    people = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    li = table(spark, sf_dir, "lineitem")
    df = li.withColumn("b", F.col("l_partkey") % people.scalar()).where(F.col("l_suppkey") != F.col("b"))
    day = F.to_date("l_shipdate")
    return df.select(
        F.col("l_orderkey").alias("competition"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("a"), "b",
        (F.floor("l_quantity") % 16).cast("int").alias("score_a"), (F.floor("l_extendedprice") % 16).cast("int").alias("score_b"),
        F.when(F.col("l_returnflag") == "R", "TABLEAU").otherwise("POULE").alias("phase"), day.alias("day"), season_of(day).alias("season"),
    )


def competition_columns() -> dict[str, Column]:
    """Competition attributes of an order date and priority."""
    ym = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return {
        "ym": ym,
        "competition": F.concat_ws("-", ym.cast("string"), F.substring("o_orderpriority", 1, 1)),
        "weapon": F.element_at(F.array(*map(F.lit, WEAPONS)), (ym % 3 + 1).cast("int")),
        "source": F.when(ym % 2 == 0, "nac").otherwise("int"),
        "format": F.when(F.col("o_orderstatus") == "P", "EQUIPOS").otherwise("INDIVIDUAL"),
        "category": F.substring("o_orderpriority", 3, 20),
        "day": F.to_date("o_orderdate"),
    }


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a person's place and points in a competition."""
    df = table(spark, sf_dir, "orders").withColumns(competition_columns()).withColumn("season", season_of(F.col("day")))
    df = numbered(df, ["competition"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "place")
    return df.select(F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("person"), F.col("o_totalprice").alias("points"), "place", "competition", "ym", "weapon", "source", "format", "category", "day", "season")


def fencers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of bouts: id, country and the person they were merged into, if any."""
    s = F.col("s_suppkey")
    merged = F.when((s % 10 == 9) | (s % 100 == 98), s - 1)
    return table(spark, sf_dir, "supplier").select(s.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country"), merged.alias("merged_into"))


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of results: id, name, country and zone."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    zones = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("country_name"), F.col("r_name").alias("zone"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("club"), F.col("c_acctbal").alias("balance"))
    return people.join(zones, "country", "left")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly list entries: cumulative points of a person within a season and weapon, at each month in which they score."""
    monthly = results(spark, sf_dir).groupBy("season", "weapon", "person", "ym").agg(F.round(F.sum("points"), 2).alias("month_points"))
    from pyspark.sql import Window

    w = Window.partitionBy("season", "weapon", "person").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("points", F.round(F.sum("month_points").over(w), 2)).drop("month_points")


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar editions: one per day and category, up to four days long, of one of two sources."""
    df = results(spark, sf_dir).groupBy("day", "category").agg(F.count("*").alias("n"), F.min("season").alias("season"))
    return df.select(
        F.concat_ws("-", F.date_format("day", "yyyyMMdd"), F.substring("category", 1, 1)).alias("edition"), F.col("day").alias("start"), F.date_add("day", (F.col("n") % 4).cast("int")).alias("stop"),
        F.col("category").alias("city"), "season", F.when(F.dayofyear("day") % 2 == 0, "nac").otherwise("int").alias("source"), "n",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed registrations: a person, a source, a competition key, and when it was read."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.col("event_type").alias("source"), k.alias("k"), "ts", "value", F.to_date("ts").alias("day"))
