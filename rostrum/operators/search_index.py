"""An inverted index of people's names that is kept on disk, refreshed by changed people alone, and read by the buckets that a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators.storage import replace_partitions, written
from rostrum.operators.windows import top_k

BUCKETS = 64
#: Letters that put a token into its bucket, so that the tokens that begin with a query's word lie in one.
LETTERS = 3
SCHEMAS = {"tokens": "token string, id long, root long, weight double, bucket int", "deletions": "v string, token string, bucket int", "people": "id long, root long, name string, weight double, bucket int"}


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _tokens(people: DataFrame) -> DataFrame:
    """(token, id, root, weight, bucket) of people of id, root, name and weight."""
    out = people.select(F.explode(F.array_distinct(X.words(F.col("name")))).alias("token"), "id", "root", "weight")
    return out.withColumn("bucket", _bucket(F.substring("token", 1, LETTERS)))


def _deletions(tokens: DataFrame) -> DataFrame:
    """(v, token, bucket): every token under itself and without each of its letters."""
    return tokens.select(F.explode(X.deletions(F.col("token"))).alias("v"), "token").withColumn("bucket", _bucket(F.col("v")))


def _named(people: DataFrame) -> DataFrame:
    return people.select(*[F.col(c).cast(t).alias(c) for c, t in (("id", "long"), ("root", "long"), ("name", "string"), ("weight", "double"))]).withColumn("bucket", _bucket(F.col("id")))


def _read(spark: SparkSession, path: str, name: str, buckets: list[int] | None = None) -> DataFrame:
    """A table of the index, or those buckets of it: other folders are not listed as input. A bucket that has lost its rows keeps one of nulls."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    df = df if buckets is None else df.where(F.col("bucket").isin(buckets))
    return df.where(F.col(df.columns[0]).isNotNull())


def _buckets(df: DataFrame) -> list[int]:
    """The different buckets of df: BUCKETS at most."""
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())


def build(people: DataFrame, path: str) -> None:
    """Writes the index of people (id, root, name, weight; one row an id) to a new folder: tokens, deletions and names, a folder a bucket. Common tokens are spread over files."""
    people = written(_named(people), "people")
    tokens = _tokens(people)
    tables = {"tokens": tokens, "deletions": _deletions(tokens.select("token").distinct()), "people": people}
    for name, df in tables.items():
        # A row of nulls in every bucket: each folder is there, also where it has no rows.
        none = people.sparkSession.range(BUCKETS).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in SCHEMAS[name].split(", ")[:-1])], F.col("id").cast("int").alias("bucket"))
        df.select(*none.columns).union(none).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")


def _replace(spark: SparkSession, path: str, name: str, buckets: list[int], kept: DataFrame) -> None:
    """Writes kept, and a row of nulls each, over the buckets alone."""
    if not buckets:
        return
    columns = [f.split(" ") for f in SCHEMAS[name].split(", ")]
    none = spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*[F.lit(None).cast(t).alias(c) if c != "bucket" else F.col("bucket") for c, t in columns])
    replace_partitions(written(kept.select(*none.columns).union(none).hint("rebalance", "bucket"), name), f"{path}/{name}", "bucket")


def refresh(now: DataFrame, changed: DataFrame, path: str) -> None:
    """Brings the people of changed (id) up to date: as in now (id, root, name, weight), or out where they are not there.

    Only buckets that hold a token, or a deletion of a token that comes or goes, of a
    changed person, before or after, are read and written. The names are written last:
    a refresh that stopped half-way is run again with the same people and ends alike.
    """
    spark = now.sparkSession
    changed = written(changed.select(F.col("id").cast("long").alias("id")).distinct(), "changed")
    own = _buckets(changed.withColumn("bucket", _bucket(F.col("id"))))
    if not own:
        return
    new = written(_named(now).join(changed, "id", "left_semi"), "new")
    names = _read(spark, path, "people", own)
    old_tokens, new_tokens = _tokens(names.join(changed, "id", "left_semi")), _tokens(new)
    touched = written(old_tokens.select("token", "bucket").union(new_tokens.select("token", "bucket")).distinct(), "touched")
    in_tokens = _buckets(touched)
    _replace(spark, path, "tokens", in_tokens, _read(spark, path, "tokens", in_tokens).join(changed, "id", "left_anti").unionByName(new_tokens.select("token", "id", "root", "weight", "bucket")))
    # What the deletions know of the touched tokens, against what is there now.
    themselves = touched.select("token", _bucket(F.col("token")).alias("bucket"))
    known = _read(spark, path, "deletions", _buckets(themselves)).where("v = token").select("token").join(touched.select("token"), "token", "left_semi")
    there = _read(spark, path, "tokens", in_tokens).select("token").distinct().join(touched.select("token"), "token", "left_semi")
    known, there = written(known, "known"), written(there, "there")
    born, gone = _deletions(there.join(known, "token", "left_anti")), _deletions(known.join(there, "token", "left_anti"))
    in_deletions = _buckets(born.select("bucket").union(gone.select("bucket")))
    if in_deletions:
        _replace(spark, path, "deletions", in_deletions, _read(spark, path, "deletions", in_deletions).join(gone.select("v", "token"), ["v", "token"], "left_anti").unionByName(born))
    _replace(spark, path, "people", own, names.join(changed, "id", "left_anti").unionByName(new))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, root, id, score, weight, whole, rank): the k best people for each of queries (query, text).

    Every word must fit a token of the name: 3 if it is the token, 2 if the token begins
    with it, from three letters on, 1 if it is one error away, from four. The score adds
    the best of each word; heavier people come first, then lesser roots. A person is one
    of all ids with its root: the best of them, `whole` where each word is a token. The
    queries' buckets are read, of deletions and then of tokens, and nothing else; a word
    that most people have costs a query no more than its rarest one.
    """
    words = queries.select("query", F.posexplode(F.array_distinct(X.words(F.col("text")))).alias("i", "word"))
    words = written(words.withColumn("n", F.count("*").over(Window.partitionBy("query"))), "words")
    typed = written(words.where(F.char_length("word") > LETTERS).select("word", F.explode(X.deletions(F.col("word"))).alias("v")).distinct().withColumn("bucket", _bucket(F.col("v"))), "typed")
    near = typed.join(_read(spark, path, "deletions", _buckets(typed)), ["v", "bucket"]).select("word", "token").distinct().where((F.col("word") != F.col("token")) & (F.levenshtein("word", "token", 1) >= 0))
    place = _bucket(F.substring("token", 1, LETTERS))
    near = written(near.select("word", "token", place.alias("bucket")), "near")
    asked = written(words.select("word", _bucket(F.substring("word", 1, LETTERS)).alias("bucket")).distinct(), "asked")
    rows = _read(spark, path, "tokens", sorted({*_buckets(asked), *_buckets(near)}))
    # Tokens meet words by equality, under themselves and under each of their beginnings: a bucket of many words and tokens makes no pairs.
    lengths = F.sequence(F.lit(LETTERS), F.char_length("token"))
    beginnings = F.when(F.char_length("token") > LETTERS, F.transform(lengths, lambda n: F.substr("token", F.lit(1), n))).otherwise(F.array("token"))
    begun = rows.select("token").distinct().withColumn("word", F.explode(beginnings))
    vocabulary = begun.join(asked.select("word").hint("merge"), "word").select("word", "token", F.when(F.col("token") == F.col("word"), 3).otherwise(2).alias("fit"))
    fits = written(vocabulary.union(near.select("word", "token", F.lit(1))).groupBy("word", "token").agg(F.max("fit").alias("fit")), "fits")
    # The word of a query with the fewest rows names who may be found; of the others, only those people's rows are looked at.
    often = rows.join(fits.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("rows"))
    total = fits.join(often, "token").groupBy("word").agg(F.sum("rows").alias("rows"))
    rarest = words.join(total, "word", "left").groupBy("query").agg(F.min_by("word", F.struct(F.coalesce("rows", F.lit(0)), "i")).alias("word"))
    seeds = written(rarest.join(fits, "word").join(rows.select("token", "id"), "token").select("query", "id").distinct(), "seeds")
    theirs = rows.join(seeds, "id").join(words, "query")
    hits = theirs.join(fits, ["word", "token"]).groupBy("query", "n", "root", "id", "weight", "i").agg(F.max("fit").alias("fit"))
    people = hits.groupBy("query", "n", "root", "id", "weight").agg(F.count("*").alias("found"), F.sum("fit").alias("score")).where("found = n")
    best = people.groupBy("query", "n", "root").agg(F.max(F.struct("score", "weight", (-F.col("id")).alias("id"))).alias("b"))
    out = best.select("query", "root", (-F.col("b.id")).alias("id"), F.col("b.score").alias("score"), F.col("b.weight").alias("weight"), (F.col("b.score") == 3 * F.col("n")).alias("whole"))
    return top_k(out, ["query"], [F.desc("score"), F.desc("weight"), "root"], k, "rank")
