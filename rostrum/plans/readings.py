"""Queries that read texts of other forms: bracketed records, words with places on a page, phrases of names, whole calendar feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import words
from rostrum.operators import feeds, layout, phrases
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.plans.texts import form_sql
from rostrum.sources.adapter import bouts, editions, results, table
from rostrum.sources.records import read_records

R = Registry()


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(competition, text): a competition's bouts as records, a pool of two for each of its pools, one bracket for the rest."""
    b = bouts(spark, sf_dir)
    mine, its, a, o = F.col("score_a"), F.col("score_b"), F.col("a"), F.col("b")
    letter = lambda x, y: F.when(x > y, "v").otherwise("d")
    cell = lambda x, y: F.when(x == y, F.lit("(a ())")).otherwise(F.format_string("(%s %d)", letter(x, y), x))
    pool = F.format_string("{[classe poule] [numero %d]\n [les_tir_feuille (%d %d)]\n [grille ((() %s) (%s ()))]}\n", F.col("line"), a, o, cell(mine, its), cell(its, mine))
    winner = F.when(mine > its, a.cast("string")).when(its > mine, o.cast("string")).otherwise("()")
    bout = F.format_string("{[match (%d %d %d %d %s %d %d)]}", a, o, mine, its, winner, F.col("line"), F.col("line") + 1)
    ordered = lambda when, text: F.array_sort(F.collect_list(F.when(when, F.struct("line", text.alias("text")))))
    texts = lambda c, between: F.array_join(F.transform(c, lambda s: s["text"]), between)
    per = b.groupBy("competition").agg(ordered(F.col("phase") == "POULE", pool).alias("pools"), ordered(F.col("phase") == "TABLEAU", bout).alias("bouts"))
    bracket = F.when(F.size("bouts") > 0, F.concat(F.lit("{[classe tableau] [nom a8] [taille 8]\n [les_matches (\n"), texts(F.col("bouts"), "\n"), F.lit(")]}\n"))).otherwise("")
    return per.select("competition", F.concat(F.lit("; a competition's bouts\n"), texts(F.col("pools"), ""), bracket).alias("text"))


FOUGHT = "(phase = 'TABLEAU' OR score_a <> score_b)"


@R.add(using(f"""SELECT competition, CASE WHEN phase = 'POULE' THEN 'pool' ELSE 'bracket' END AS kind, CASE WHEN phase = 'POULE' THEN CAST(line AS VARCHAR) ELSE 'a8' END AS round, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b,
    CASE WHEN {FOUGHT} THEN CAST(score_a AS INTEGER) END AS score_a, CASE WHEN {FOUGHT} THEN CAST(score_b AS INTEGER) END AS score_b,
    CASE WHEN score_a > score_b THEN CAST(a AS VARCHAR) WHEN score_b > score_a THEN CAST(b AS VARCHAR) END AS winner FROM bout""", "bout"))
def native_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of pools and brackets read back from bracketed records."""
    rows, _ = read_records(record_files(spark, sf_dir), "text", ["competition"])
    return rows.select("competition", "kind", "round", "a", "b", "score_a", "score_b", "winner")


ROWS_OF_PAGE = 40


def printed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(competition, page, x, y, width, text): the words of lists printed in two layouts, with a title and feet, long names on two lines."""
    r = results(spark, sf_dir)
    wide = F.when(F.col("ym") % 2 == 0, 1.0).otherwise(1.5)
    y = (F.expr(f"(place - 1) % {ROWS_OF_PAGE}") * 24 + 60).cast("double")
    # Points end at one place, so where they begin depends on how long they are.
    points = F.format_string("%.2f", "points")
    word = lambda x, down, text: F.struct((x * wide).alias("x"), (y + down).alias("y"), (F.char_length(text) * 5.0).alias("width"), text.alias("text"))
    long = F.col("person") % 3 == 0
    fencer, key = F.lit("Fencer"), F.concat(F.lit("N"), F.col("person"))
    line = F.array(
        word(F.lit(20.0), 0.5, F.col("place").cast("string")), word(F.lit(60.0), 0.0, fencer),
        F.when(long, word(F.lit(60.0), 9.0, key)).otherwise(F.struct((F.lit(60.0) * wide + 35.0).alias("x"), (y + 1.0).alias("y"), (F.char_length(key) * 5.0).alias("width"), key.alias("text"))),
        word(F.lit(200.0), 0.0, F.substring("weapon", 1, 3)), word(F.lit(300.0) - F.char_length(points) * 0.5, 0.25, points),
    )
    pages = r.withColumn("page", F.expr(f"(place - 1) div {ROWS_OF_PAGE}"))
    printed = pages.select("competition", "page", F.explode(line).alias("w")).select("competition", "page", "w.*")
    edge = lambda x, y, width, text: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(width).alias("width"), text.alias("text"))
    around = F.array(edge(110.0, 20.0, 60.0, F.lit("RANKING")), edge(20.0, 1040.0, 20.0, F.lit("Page")), edge(45.0, 1040.0, 10.0, F.col("page").cast("string")))
    edges = pages.select("competition", "page").distinct().select("competition", "page", F.inline(around))
    return printed.unionByName(edges)


@R.add(using("SELECT competition, CAST(place AS VARCHAR) AS place, 'Fencer N' || person AS name, substr(weapon, 1, 3) AS weapon, printf('%.2f', points) AS points FROM result", "result"))
def printed_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lists read back from words with places on pages."""
    return layout.rows(printed_words(spark, sf_dir), ["competition", "page"], ["place", "name", "weapon", "points"]).select("competition", "place", "name", "weapon", "points")


# Own groups, stop words and concepts; the phrases are the table's own names, alone or with their type.
GROUPS = {"red": "colour", "blue": "colour", "green": "colour", "small": "size", "large": "size"}
STOP = ("of", "the")
CONCEPTS = {"bargain": ("budget", "ring"), "tinted": ("colour", "widget")}
NAMES_SQL, TYPES_SQL = form_sql("p_name"), form_sql("p_type")
PHRASES_SQL = f"""SELECT phrase, min(means) AS means FROM (SELECT DISTINCT {NAMES_SQL} AS phrase, replace({NAMES_SQL}, ' ', '') AS means FROM part WHERE length(p_name) % 3 = 0
    UNION SELECT DISTINCT {NAMES_SQL} || ' ' || {TYPES_SQL}, 'budget ' || split_part({NAMES_SQL}, ' ', -1) FROM part WHERE p_type = 'ECONOMY' AND length(p_name) % 2 = 0
    UNION SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GROUPS.items())})) GROUP BY phrase"""
RUN = "LEFT JOIN d d{n} ON len(t) >= p + {n} - 1 AND d{n}.phrase = array_to_string(t[p : p + {n} - 1], ' ')"
WALK = f"""SELECT p_partkey, 1 AS p, t, CAST([] AS VARCHAR[]) AS out FROM k UNION ALL
    SELECT p_partkey, p + CASE WHEN d3.phrase IS NOT NULL THEN 3 WHEN d2.phrase IS NOT NULL THEN 2 ELSE 1 END, t, list_concat(out, string_split(coalesce(d3.means, d2.means, d1.means, t[p]), ' '))
    FROM w {RUN.format(n=3)} {RUN.format(n=2)} {RUN.format(n=1)} WHERE p <= len(t)"""
STOP_SQL = str(list(STOP))
ADDED = ", ".join(f"CASE WHEN list_has_all(f, {list(needs)}) THEN '{c}' END" for c, needs in CONCEPTS.items())


@R.add("WITH RECURSIVE" + using(f"""SELECT p_partkey, array_to_string(words, ' ') AS words, array_to_string(list_sort(list_distinct(list_concat(f, list_filter([{ADDED}], lambda c: c IS NOT NULL)))), ' ') AS terms FROM (
    SELECT p_partkey, list_filter(out, lambda x: NOT list_contains({STOP_SQL}, x)) AS words, list_filter(list_concat(t, out), lambda x: NOT list_contains({STOP_SQL}, x)) AS f FROM w WHERE p > len(t))""",
    k=f"SELECT p_partkey, string_split({form_sql("p_name || ' ' || p_type || ' of the ' || p_brand")}, ' ') AS t FROM part", d=PHRASES_SQL, w=WALK).removeprefix("WITH"))
def phrase_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of parts by the longest phrases of their own names, groups of words, stop words and concepts."""
    part = table(spark, sf_dir, "part")
    name, kind = F.array_join(words(F.col("p_name")), " "), F.array_join(words(F.col("p_type")), " ")
    long = F.char_length("p_name")
    known = part.where(long % 3 == 0).select(name.alias("phrase"), F.replace(name, F.lit(" "), F.lit("")).alias("means"))
    typed = part.where((F.col("p_type") == "ECONOMY") & (long % 2 == 0)).select(F.concat_ws(" ", name, kind).alias("phrase"), F.concat(F.lit("budget "), F.element_at(words(F.col("p_name")), -1)).alias("means"))
    groups = spark.createDataFrame(list(GROUPS.items()), "phrase string, means string")
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" of the "), F.col("p_brand"))
    found = phrases.terms(part.select("p_partkey", words(text).alias("tokens")), "p_partkey", "tokens", known.union(typed).union(groups), STOP, CONCEPTS)
    return found.select("p_partkey", F.array_join("words", " ").alias("words"), F.array_join("terms", " ").alias("terms"))


ZONES = ("Europe/Madrid", "America/Bogota", "Australia/Sydney", "Mars/Base")


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions as events of one feed per source and season, in several zones, some timed, some cancelled, some with a day on which entries close."""
    e = editions(spark, sf_dir)
    turn = F.dayofyear("start")
    return e.select(
        F.concat_ws(" ", "source", "season").alias("feed"), F.concat("edition", F.lit("@rostrum")).alias("uid"), "start", "stop",
        F.when(turn % 3 == 0, F.format_string("%d:30", turn % 24)).when(turn % 3 == 1, "to be told").alias("clock"), F.element_at(F.array(*map(F.lit, ZONES)), (turn % 4 + 1).cast("int")).alias("zone"),
        F.concat(F.lit("Trofeo Señorío, "), "city", F.lit("; "), F.col("n").cast("string")).alias("summary"), F.col("city").alias("location"),
        F.concat(F.lit("Inscripción hasta siete días antes, según el reglamento de la organización de "), "city", F.lit("\nñandú")).alias("description"),
        F.when(turn % 5 == 0, F.date_add("start", -7).cast("timestamp")).alias("closes"), (turn % 11 == 0).alias("cancelled"),
    )


@R.add()
def ical_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole calendar feeds, one text per source and season."""
    return feeds.feeds(feed_events(spark, sf_dir), "feed", F.col("feed"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
