"""Queries over names and titles: folding, search, variants, suggestions, parsing, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import names as N
from rostrum.functions import text as X
from rostrum.functions.dates import next_season, normal_season, previous_season, season_end, season_of
from rostrum.operators.storage import spread
from rostrum.operators.windows import top_k
from rostrum.plans.oracle import SEASON
from rostrum.plans.registry import Registry
from rostrum.sources.adapter import table

R = Registry()


def fold_sql(c: str) -> str:
    return f"translate(lower({c}), '{X.ACCENTED}', '{X.PLAIN}')"


def form_sql(c: str) -> str:
    return f"trim(regexp_replace({fold_sql(c)}, '[^a-z0-9]+', ' ', 'g'))"


def phonetic_sql(c: str) -> str:
    out = fold_sql(c)
    back = "\\"  # how RE2 writes a group in a replacement
    for pattern, by in X.SOUNDS:
        if pattern.startswith("(.)"):  # RE2 has no back references in patterns: doubled letters one by one
            for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
                out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', back)}', 'g')"
    return out


@R.add(f"SELECT doc_id, {form_sql('text')} AS folded FROM documents")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.search_form(F.col("text")).alias("folded"))


@R.add(f"SELECT p_partkey, {phonetic_sql('p_name')} AS sound FROM part")
def phonetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.phonetic_key(F.col("p_name")).alias("sound"))


@R.add(f"SELECT p_partkey, array_to_string(list_sort(string_split({form_sql('p_name')}, ' ')), ' ') AS name FROM part")
def order_free_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.order_free(F.col("p_name")).alias("name"))


@R.add(f"SELECT token, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split({form_sql('p_name')}, ' ')) AS token FROM part) WHERE token <> '' GROUP BY token")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.words(F.col("p_name"))).alias("token"))
    return df.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


VARIANTS = f"SELECT DISTINCT token, v FROM (SELECT token, token AS v FROM t UNION ALL SELECT token, substr(token, 1, i - 1) || substr(token, i + 1) FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t))"
TOKENS = f"SELECT DISTINCT token FROM (SELECT unnest(string_split({form_sql('p_type')}, ' ')) AS token FROM part) WHERE token <> ''"


@R.add(f"WITH t AS ({TOKENS}) {VARIANTS}")
def delete1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.explode(X.words(F.col("p_type"))).alias("token")).distinct()
    return t.select("token", F.explode(X.deletions(F.col("token"))).alias("v"))


TYPOS = ("stndard", "polishde", "bras", "copperr", "econmy")


@R.add(f"WITH t AS ({TOKENS}), d AS ({VARIANTS}), q AS (SELECT unnest({list(TYPOS)}) AS query), qd AS (SELECT query, v FROM (SELECT query, query AS v FROM q UNION ALL SELECT query, substr(query, 1, i - 1) || substr(query, i + 1) FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM q)) GROUP BY ALL) SELECT query, token, hits, rn FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, token) AS rn FROM (SELECT query, token, count(*) AS hits FROM qd JOIN d USING (v) GROUP BY 1, 2)) WHERE rn <= 3")
def suggest_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that share a one-letter deletion with what was typed."""
    index = delete1_variants(spark, sf_dir)
    q = spark.createDataFrame([(t,) for t in TYPOS], "query string").select("query", F.explode(X.deletions(F.col("query"))).alias("v"))
    hits = index.join(F.broadcast(q), "v").groupBy("query", "token").agg(F.count("*").alias("hits"))
    return top_k(hits, ["query"], [F.desc("hits"), "token"], 3).select("query", "token", "hits", "rn")


@R.add("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(lower(c_name), '(^|[^a-z0-9])cust') AND regexp_matches(c_name, '(^|[^0-9])0000001')")
def person_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").where(X.prefix_match(F.col("c_name"), F.lit("cust 0000001")))
    return df.select("c_custkey", "c_name")


@R.add(f"SELECT p_partkey, list_contains(string_split({form_sql('p_type')}, ' '), 'brass') AS brass, contains({form_sql('p_name')}, 'a') AS has FROM part")
def folded_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.whole_word(F.col("p_type"), F.lit("brass")).alias("brass"), F.contains(X.search_form(F.col("p_name")), F.lit("a")).alias("has"))


@R.add("SELECT a, b, levenshtein(a, b) AS far FROM (SELECT DISTINCT p_brand AS a FROM part) JOIN (SELECT DISTINCT p_brand AS b FROM part) ON a < b WHERE levenshtein(a, b) <= 1")
def levenshtein_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands within one error: met by shared one-letter deletions, then measured."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    one = brands.select("a", F.explode(X.deletions(F.col("a"))).alias("v"))
    both = one.join(one.withColumnRenamed("a", "b"), "v").where("a < b").select("a", "b").distinct()
    return both.withColumn("far", F.levenshtein("a", "b", 1)).where("far >= 0")


PAIRS = [("maria", "marya"), ("vega", "bega"), ("gonzalez", "gonsales"), ("ana", "ana"), ("mart", "martin"), ("juan", "pedro"), ("quesada", "kesada"), ("m", "maria"), ("m", "ana"), ("gar", "garcia"), ("garc", "garcia"), ("gonz", "gonzalez"), ("kesa", "quesada"), ("chavez", "javez"), ("walls", "bays"), ("perez", "peres"), ("perez", "pares"), ("llavador", "llabadar"), ("fernandez", "fernanber"), ("yesica", "iesika"), ("ona", "ana")]
PAIR_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") AS t(a, b)"


SIMILARITY_SQL = "CAST(CASE WHEN a = b THEN 1.0 WHEN length(a) = 1 THEN CASE WHEN starts_with(b, a) THEN 0.5 ELSE 0 END WHEN x = y THEN 0.95 WHEN length(a) >= 4 AND starts_with(b, a) THEN 0.9 WHEN length(x) >= 4 AND starts_with(y, x) THEN 0.85 WHEN levenshtein(x, y) = 1 AND least(length(x), length(y)) >= 4 THEN 0.8 WHEN levenshtein(x, y) = 2 AND least(length(x), length(y)) >= 7 THEN 0.65 ELSE 0.0 END AS DOUBLE)"  # of a and b, whose phonetic keys are x and y


@R.add(f"WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(string_split({form_sql('p_name')}, ' ')) AS token FROM part) WHERE token <> '') SELECT a, b, {SIMILARITY_SQL} AS score FROM (SELECT x.token AS a, y.token AS b, {phonetic_sql('x.token')} AS x, {phonetic_sql('y.token')} AS y FROM t x JOIN t y ON substr(x.token, 1, 2) = substr(y.token, 1, 2))")
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike words of names are that begin with the same two letters."""
    t = table(spark, sf_dir, "part").select(F.explode(X.words(F.col("p_name"))).alias("token")).distinct().withColumn("p", F.substring("token", 1, 2))
    both = t.select("p", F.col("token").alias("a")).join(t.select("p", F.col("token").alias("b")), "p")
    return both.select("a", "b", X.similarity(F.col("a"), F.col("b")).alias("score"))


@R.add("SELECT p_partkey, r AS relation, CASE WHEN r IN ('same', 'clipped', 'compound') THEN 'free' WHEN r = 'variant' THEN 'hint' WHEN r = 'crossed' THEN 'evidence' ELSE 'never' END AS level FROM (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'same' WHEN 1 THEN 'clipped' WHEN 2 THEN 'compound' WHEN 3 THEN 'variant' WHEN 4 THEN 'crossed' WHEN 5 THEN 'cousins' WHEN 6 THEN 'siblings' ELSE 'different' END AS r FROM part)")
def name_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a part's words against one that is made from them in one of eight ways."""
    w, way = X.words(F.col("p_name")), F.col("p_size") % 8
    one, two = F.concat(F.get(w, F.lit(0)), F.lit("ez")), F.concat(F.get(w, F.lit(1)), F.lit("ano"))
    given = F.array(F.concat(F.lit("fer"), F.lower(F.col("p_type"))))
    first = given[0]
    surnames = F.when(way == 1, F.array(one)).when(way == 4, F.array(two, one)).when(way == 5, F.array(one, F.lit("zubieta"))).when(way == 7, F.array(F.lit("xu"))).otherwise(F.array(one, two))
    other = F.when(way == 2, F.array(first, F.lit("maria"))).when(way == 3, F.array(F.concat(F.lit("fir"), F.substr(first, F.lit(4))))).when(way == 6, F.array(F.lit("xuxa"))).otherwise(given)
    related = N.relation(F.array(one, two), given, surnames, other)
    return table(spark, sf_dir, "part").select("p_partkey", related.alias("relation")).withColumn("level", N.union_level(F.col("relation")))


@R.add()
def written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name as a person's, in capitals and surnames first, against what another source writes for the part after it: in full, marked, turned or cut."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"), F.initcap(F.lower("p_type")).alias("given"))
    surnames, way = F.when(F.col("p_size") % 5 < 3, F.col("p_name")).otherwise(F.col("next_name")), F.col("p_size") % 4
    turned = F.concat_ws(" ", F.reverse(F.split(surnames, " ")))
    other = (
        F.when(way == 0, F.concat_ws(" ", "given", F.initcap(surnames))).when(way == 1, F.concat_ws(" ", F.upper(surnames), "given"))
        .when(way == 2, F.concat_ws(" ", F.upper(turned), "given")).otherwise(F.concat_ws(" ", F.upper(F.substring_index(surnames, " ", 1)), F.substring("given", 1, 3)))
    )
    both = spread(p.join(after, "p_partkey")).select("p_partkey", F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("one"), other.alias("other"))
    related = N.written_relation(F.col("one"), F.col("other"), F.lit(N.ORDERS[0]), F.lit(None).cast("string"))
    return both.withColumn("relation", related).withColumn("level", N.union_level(F.col("relation")))


LABELS = ["A64", "T32", "QF", "SF", "F", "V1P3", "a8", "B12", ""]


@R.add(f"SELECT label, CASE WHEN regexp_matches(label, '^[ATat][0-9]+$') THEN CAST(substr(label, 2) AS INTEGER) WHEN upper(label) = 'QF' THEN 8 WHEN upper(label) = 'SF' THEN 4 WHEN upper(label) = 'F' THEN 2 END AS size, CAST(nullif(regexp_extract(label, 'P([0-9]+)$', 1), '') AS INTEGER) AS pool, count(*) AS n FROM (SELECT {LABELS}[1 + (l_orderkey + l_linenumber) % {len(LABELS)}] AS label FROM lineitem) GROUP BY ALL")
def round_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and pools that the labels of rounds tell, with their rows."""
    label = F.get(F.array(*map(F.lit, LABELS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(LABELS)).cast("int"))
    df = table(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    pool = F.regexp_extract("label", "P([0-9]+)$", 1)
    return df.select("label", X.round_of(F.col("label")).alias("size"), F.when(pool != "", pool.try_cast("int")).alias("pool"), "n")


NAMES = "concat_ws(' ', p_name, CASE p_size % 6 WHEN 0 THEN 'World Cup' WHEN 1 THEN 'Championship 1999' WHEN 2 THEN 'Satellite III' WHEN 3 THEN 'Open U17' WHEN 4 THEN 'Grand Prix' ELSE 'Trophy' END)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a tournament's name."""
    ends = F.element_at(F.array(*map(F.lit, ("World Cup", "Championship 1999", "Satellite III", "Open U17", "Grand Prix", "Trophy"))), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", ends).alias("name"))


TYPE_CASES = " ".join(f"WHEN contains({form_sql(NAMES)}, '{p}') THEN '{k}'" for p, k, _ in X.TYPES)


@R.add(f"SELECT p_partkey, CASE {TYPE_CASES} ELSE 'OTHER' END AS type FROM part")
def type_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("p_partkey", X.competition_type(F.col("name")).alias("type"))


@R.add(f"SELECT p_partkey, trim(regexp_replace(regexp_replace({form_sql(NAMES)}, '\\b((19|20)[0-9]{{2}}|[mu][0-9]{{1,2}}|[ivx]+|[0-9]+)\\b', ' ', 'g'), ' +', ' ', 'g')) AS base FROM part")
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("p_partkey", X.base_name(F.col("name")).alias("base"))


@R.add(f"SELECT season, CASE WHEN regexp_matches(season, '^[0-9]{{4}}$') THEN CAST(CAST(season AS INTEGER) - 1 AS VARCHAR) || '-' || season ELSE season END AS normal, CAST(regexp_extract(season, '([0-9]{{4}})$', 1) AS INTEGER) AS ends, CAST(CAST(regexp_extract(season, '([0-9]{{4}})$', 1) AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(regexp_extract(season, '([0-9]{{4}})$', 1) AS INTEGER) + 1 AS VARCHAR) AS following, CAST(CAST(regexp_extract(season, '([0-9]{{4}})$', 1) AS INTEGER) - 2 AS VARCHAR) || '-' || CAST(CAST(regexp_extract(season, '([0-9]{{4}})$', 1) AS INTEGER) - 1 AS VARCHAR) AS before FROM (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE season END AS season FROM (SELECT o_orderkey, o_orderdate, {SEASON.format(d='o_orderdate')} AS season FROM orders))")
def season_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons as sources write them, one year or two, with their normal form, end and neighbours."""
    s, day = F.col("season"), F.to_date("o_orderdate")
    seasons = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.year(day).cast("string")).otherwise(season_of(day)).alias("season")).distinct()
    return seasons.select("season", normal_season(s).alias("normal"), season_end(s).alias("ends"), next_season(s).alias("following"), previous_season(s).alias("before"))


@R.add("SELECT c_custkey, upper(regexp_replace(substr(c_name, 1, 3) || ' - ' || CAST(c_custkey AS VARCHAR), '[\\s-]+', '', 'g')) AS licence FROM customer")
def licence_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.licence(F.concat_ws(" - ", F.substring("c_name", 1, 3), "c_custkey")).alias("licence"))


@R.add("SELECT p_partkey, CASE WHEN regexp_matches(cell, '^\\s*[=+\\-@]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' ELSE '' END || p_name AS cell FROM part)")
def safe_csv_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("=", " +", "@", ""))), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_cell(F.concat(lead, F.col("p_name"))).alias("cell"))


@R.add("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'FLORETE' WHEN contains(lower(p_type), 'steel') THEN 'ESPADA' WHEN contains(lower(p_type), 'tin') THEN 'SABLE' END AS weapon, CASE WHEN regexp_matches(p_name, '^[a-m]') THEN 'F' ELSE 'M' END AS gender, CASE WHEN p_size <= 10 THEN 'M17' WHEN p_size <= 20 THEN 'M20' WHEN p_size <= 30 THEN 'M23' ELSE 'ABS' END AS category FROM part")
def value_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values to enumerations, unknown ones to null."""
    kind = F.lower("p_type")
    weapon = F.when(F.contains(kind, F.lit("brass")), "FLORETE").when(F.contains(kind, F.lit("steel")), "ESPADA").when(F.contains(kind, F.lit("tin")), "SABLE")
    size = F.col("p_size")
    category = F.when(size <= 10, "M17").when(size <= 20, "M20").when(size <= 30, "M23").otherwise("ABS")
    return table(spark, sf_dir, "part").select("p_partkey", weapon.alias("weapon"), F.when(F.col("p_name").rlike("^[a-m]"), "F").otherwise("M").alias("gender"), category.alias("category"))


@R.add("SELECT n_nationkey, n_name, r_name AS zone FROM nation JOIN region ON r_regionkey = n_regionkey")
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.col("r_name").alias("zone"))


@R.add("SELECT n_nationkey, list_position(['M7', 'M9', 'M11', 'M13', 'M15', 'M17', 'M20', 'M23', 'ABS', 'VET'], category) AS n FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'M17' WHEN 1 THEN 'ABS' WHEN 2 THEN 'M20' ELSE 'VET' END AS category FROM nation)")
def enum_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = F.array(*map(F.lit, ("M7", "M9", "M11", "M13", "M15", "M17", "M20", "M23", "ABS", "VET")))
    own = F.element_at(F.array(*map(F.lit, ("M17", "ABS", "M20", "VET"))), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_position(ladder, own).alias("n")).orderBy("n", "n_nationkey")


@R.add()
def spanish_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in Spanish order, ids breaking ties."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy(F.collate("c_name", "es"), "c_custkey")


@R.add()
def osa_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances that count a swap of neighbours once, between typed words and the words of types."""
    from rostrum.functions.udfs import osa

    tokens = table(spark, sf_dir, "part").select(F.explode(X.words(F.col("p_type"))).alias("token")).distinct()
    q = spark.createDataFrame([(t,) for t in TYPOS], "query string").select("query", F.explode(X.deletions(F.col("query"))).alias("v"))
    index = tokens.select("token", F.explode(X.deletions(F.col("token"))).alias("v"))
    near = index.join(F.broadcast(q), "v").select("query", "token").distinct()
    return near.withColumn("far", osa(F.col("query"), F.col("token"), F.lit(2))).where("far >= 0")


@R.add()
def fuzzy_edition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tournament names scored by the worst of the query's words: 3 equal, 2 begins, 1 within the errors its length allows."""
    from rostrum.functions.udfs import osa

    query = ["wrld", "cup"]
    t = named(spark, sf_dir).select("p_partkey", F.explode(X.words(F.col("name"))).alias("w"))
    vocabulary = t.select("w").distinct()
    scores = []
    for k, q in enumerate(query):
        far = osa(F.lit(q), F.col("w"), X.error_budget(F.lit(q)))
        scores.append(F.when(F.col("w") == q, 3).when(F.startswith("w", F.lit(q)), 2).when(far >= 0, 1).otherwise(0).alias(f"s{k}"))
    scored = vocabulary.select("w", *scores).where(" OR ".join(f"s{k} > 0" for k in range(len(query))))
    per = t.join(scored, "w").groupBy("p_partkey").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(len(query))])
    return per.select("p_partkey", F.least(*[f"s{k}" for k in range(len(query))]).alias("score")).where("score > 0")
