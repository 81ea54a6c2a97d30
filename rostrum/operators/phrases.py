"""Terms of texts: phrases of several words by the longest first, groups of equal words, stop words, concepts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators.storage import written

#: Letters of all phrases and their meanings that are sent to every executor at most.
SMALL = 1_000_000


def terms(texts: DataFrame, id: str, tokens: str, phrases: DataFrame, stop: Sequence[str] = (), concepts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id, words, terms): the words of a text after its phrases were replaced, and the sorted set under which it is found.

    texts: one row per id with an array of folded tokens. phrases: phrase (tokens joined
    by a space), means (the words that stand for it); of several meanings of one phrase
    the least counts. From left to right the longest phrase that begins at a token
    replaces its tokens; a replaced token begins no other phrase. Stop words go after
    that, so phrases may hold them. Terms are the tokens as written, the words and each
    concept whose words are all there. Null or empty tokens have no terms.

    The runs of tokens meet the phrases in one equi-join whose phrase side has a row per
    phrase: it is broadcast up to SMALL letters in all, and both are shuffled beyond. The
    runs are never broadcast, though Spark takes them for as few as the texts. Texts are
    spread before their runs are made. The tokens of one text, by the words of the
    longest phrase, bound a row.
    """
    known = phrases.where("phrase <> ''").groupBy("phrase").agg(F.min("means").alias("means"))
    known = written(known, "phrases")
    longest, letters = known.agg(F.max(F.size(F.split("phrase", " "))), F.sum(F.char_length("phrase") + F.coalesce(F.char_length("means"), F.lit(0)))).first()
    longest = longest or 1
    known = F.broadcast(known) if (letters or 0) <= SMALL else known.hint("merge")
    own = texts.repartition(F.col(id)).select(F.col(id).alias("__id"), F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != "")).alias("__t"))
    size = F.size("__t")
    at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    run = lambda i, n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("__t", i, n), " ").alias("phrase"))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda n: run(i, n))))
    met = own.select("__id", F.inline(runs)).join(known, "phrase").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("less"), "means"))).alias("__m"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i:int,n:int,means:string>>").alias("kept"))

    def step(done, m):
        kept = F.array_append(done["kept"], F.struct(m["i"].alias("i"), (-m["less"]).alias("n"), m["means"].alias("means")))
        return F.when(m["i"] > done["end"], F.struct((m["i"] - m["less"] - 1).alias("end"), kept.alias("kept"))).otherwise(done)

    chosen = met.select("__id", F.aggregate("__m", start, step)["kept"].alias("__kept"))
    df = own.join(chosen, "__id", "left").withColumn("__kept", F.coalesce("__kept", start["kept"]))

    def word(i):
        one = F.filter("__kept", lambda k: (k["i"] <= i) & (i < k["i"] + k["n"]))
        begins = F.exists(one, lambda k: k["i"] == i)
        return F.when(F.size(one) == 0, F.array(F.get("__t", i - 1))).when(begins, F.split(one[0]["means"], " ")).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    gone = F.array(*map(F.lit, stop)) if stop else none
    df = df.withColumn("words", F.filter(F.flatten(F.transform(at, word)), lambda w: (w != "") & ~F.array_contains(gone, w)))
    plain = F.array_union(F.array_except("__t", gone), F.array_distinct("words"))
    found = [F.when(F.size(F.array_except(F.array(*map(F.lit, needs)), plain)) == 0, F.array(F.lit(name))).otherwise(none) for name, needs in (concepts or {}).items()]
    return df.select(F.col("__id").alias(id), "words", F.array_sort(F.array_union(plain, F.flatten(F.array(none, *found)))).alias("terms"))
