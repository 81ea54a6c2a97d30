"""Queries over who a row is about: links by trusted keys, united people, continued brackets, encounters, search by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.functions.dates import iso
from rostrum.operators import encounters, evidence, linking, search_index
from rostrum.operators.storage import divided, spread, work_path, written
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.plans.texts import SIMILARITY_SQL, form_sql, phonetic_sql
from rostrum.sources.adapter import athletes, bouts, results, table

R = Registry()

# Names that three people share, and given names that tell two of them apart.
NAME, GIVEN = "'fencer ' || {0} // 3", "CASE {0} % 2 WHEN 0 THEN 'ana' ELSE 'eva' END"
NAMED_SQL = f"SELECT r.*, {NAME.format('r.person')} AS surname, {NAME.format('r.person')} || ' ' || {GIVEN.format('r.person')} AS full_name, a.club, a.country FROM result r JOIN athlete a ON a.person = r.person"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the name, club and country of their person."""
    surname = F.concat(F.lit("fencer "), F.expr("person div 3"))
    given = F.when(F.col("person") % 2 == 0, " ana").otherwise(" eva")
    who = athletes(spark, sf_dir).select("person", "club", "country")
    return results(spark, sf_dir).join(who, "person").withColumns({"surname": surname, "full_name": F.concat(surname, given)})


def levels_sql(rows: str, people: str, levels: Mapping[str, Sequence[str]]) -> str:
    """The rows with the only person, level and reason of the first level that knows their keys."""
    joins = " ".join(
        f"LEFT JOIN (SELECT {', '.join(keys)}, count(DISTINCT person) AS n, any_value(person) AS person FROM {people} WHERE person IS NOT NULL GROUP BY {', '.join(keys)}) l{k} ON {' AND '.join(f'l{k}.{c} = r.{c}' for c in keys)}"
        for k, keys in enumerate(levels.values())
    )
    case = lambda of, end: "CASE " + " ".join(f"WHEN l{k}.n IS NOT NULL THEN {of(k, name)}" for k, name in enumerate(levels)) + f" ELSE {end} END"
    return f"SELECT r.*, {case(lambda k, _: f'CASE WHEN l{k}.n = 1 THEN l{k}.person END', 'NULL')} AS person, {case(lambda _, name: repr(name), 'NULL')} AS level, {case(lambda k, _: f'''CASE WHEN l{k}.n = 1 THEN 'linked' ELSE 'ambiguous' END''', repr('none'))} AS reason FROM {rows} r {joins}"


BOUT_LEVELS = {"exact": ["competition", "full_name"], "part": ["competition", "surname"]}


@R.add(using("SELECT fact, person, level, reason FROM x", "result", "athlete", n=NAMED_SQL, p="SELECT competition, full_name, surname, person FROM n WHERE fact % 5 <> 0",
    s="SELECT fact, competition, surname, CASE WHEN fact % 3 <> 0 THEN full_name END AS full_name FROM n", x=levels_sql("s", "p", BOUT_LEVELS)))
def bout_person_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entrant that a bout's written name means: by the full name, else by a cut one, within the competition and only if one person fits."""
    n = named(spark, sf_dir)
    sides = n.select("fact", "competition", "surname", F.when(F.col("fact") % 3 != 0, F.col("full_name")).alias("full_name"))
    entrants = n.where("fact % 5 <> 0").select("competition", "full_name", "surname", "person")
    return linking.link_by_levels(sides, entrants, "person", BOUT_LEVELS).select("fact", "person", "level", "reason")


RELAY_LEVELS = {"component": ["competition", "team", "full_name"], "club": ["competition", "club", "surname"], "country": ["competition", "country", "surname"], "season": ["season", "weapon", "club", "full_name"]}
ONCE_SQL = """SELECT fact, CASE WHEN NOT twice THEN person END AS person, level, CASE WHEN twice THEN 'repeated' ELSE reason END AS reason FROM (
    SELECT *, person IS NOT NULL AND min(club || '|' || full_name) OVER (PARTITION BY competition, person) <> max(club || '|' || full_name) OVER (PARTITION BY competition, person) AS twice FROM x)"""


@R.add(using(ONCE_SQL, "result", "athlete", n=NAMED_SQL, p="SELECT competition, season, weapon, club, country, surname, full_name, person, CASE WHEN fact % 4 = 0 THEN club END AS team FROM n WHERE format = 'INDIVIDUAL'",
    s="SELECT fact, competition, season, weapon, club, country, surname, full_name, club AS team FROM n WHERE format = 'EQUIPOS'", x=levels_sql("s", "p", RELAY_LEVELS)))
def relay_fencer_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relay's fencer by the team's list, then club and country in the competition, then club in the season; nobody for two fencers of one competition."""
    n = named(spark, sf_dir)
    columns = ["competition", "season", "weapon", "club", "country", "surname", "full_name"]
    people = n.where("format = 'INDIVIDUAL'").select(*columns, "person", F.when(F.col("fact") % 4 == 0, F.col("club")).alias("team"))
    relays = n.where("format = 'EQUIPOS'").select("fact", *columns, F.col("club").alias("team"))
    links = linking.link_by_levels(relays, people, "person", RELAY_LEVELS)
    return linking.once_per(links, ["competition"], ["club", "full_name"], "person").select("fact", "person", "level", "reason")


LIST_LEVELS = {"licence": ["licence"], "name": ["season", "weapon", "category", "full_name"]}
LIST_PEOPLE = "SELECT CASE WHEN person % 3 <> 0 THEN 'L' || person // 2 END AS licence, season, weapon, category, full_name, person FROM n WHERE format = 'INDIVIDUAL'"


@R.add(using("SELECT fact, CASE WHEN year % 7 <> 0 OR level <> 'licence' THEN person END AS person, level, CASE WHEN reason = 'linked' AND level = 'licence' AND year % 7 = 0 THEN 'birth' ELSE reason END AS reason FROM x", "result", "athlete",
    n=NAMED_SQL, p=LIST_PEOPLE, s="SELECT fact, CASE WHEN fact % 2 = 0 THEN 'L' || person // 2 END AS licence, season, weapon, category, full_name, 1980 + fact % 20 AS year FROM n", x=levels_sql("s", "p", LIST_LEVELS)))
def historical_list_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's rows by licence, refused where the year of birth contradicts, else by the full name in the season's weapon and category."""
    n = named(spark, sf_dir)
    licence = F.concat(F.lit("L"), F.expr("person div 2"))
    people = n.where("format = 'INDIVIDUAL'").select(F.when(F.col("person") % 3 != 0, licence).alias("licence"), "season", "weapon", "category", "full_name", "person")
    rows = n.select("fact", F.when(F.col("fact") % 2 == 0, licence).alias("licence"), "season", "weapon", "category", "full_name", (F.col("fact") % 20 + 1980).alias("year"))
    links = linking.link_by_levels(rows, people, "person", LIST_LEVELS)
    contradicts = (F.col("level") == "licence") & (F.col("year") % 7 == 0)
    reason = F.when((F.col("reason") == "linked") & contradicts, "birth").otherwise(F.col("reason"))
    return links.select("fact", F.when(contradicts, F.lit(None)).otherwise(F.col("person")).alias("person"), "level", reason.alias("reason"))


STAGES = {"licence": ["licence"], "birth": ["name", "birth"], "name": ["name", "country"]}
CARDS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 THEN 'L' || c_custkey // 8 END AS licence, 'fencer ' || c_custkey // 3 AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN 1980 + c_custkey // 6 % 20 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END END AS birth, c_nationkey % 2 AS country FROM customer"""


def stages_sql() -> dict[str, str]:
    """The roots after each stage, o0 to o3, and where each person is then, m1 to m3."""
    parts = {"o0": "SELECT id AS root, licence, name, birth, country FROM cards", "m0": "SELECT id, id AS root, NULL AS stage FROM cards"}
    for k, (name, keys) in enumerate(STAGES.items()):
        known = " AND ".join(f"{c} IS NOT NULL" for c in keys)
        parts[f"u{k}"] = f"SELECT root, CASE WHEN {known} AND min(birth) OVER w IS NOT DISTINCT FROM max(birth) OVER w THEN min(root) OVER w ELSE root END AS target FROM o{k} WINDOW w AS (PARTITION BY {', '.join(keys)})"
        parts[f"m{k + 1}"] = f"SELECT id, target AS root, CASE WHEN target <> root THEN '{name}' ELSE stage END AS stage FROM m{k} JOIN u{k} USING (root)"
        parts[f"o{k + 1}"] = f"SELECT target AS root, min(licence) AS licence, min(name) AS name, min(birth) AS birth, min(country) AS country FROM o{k} JOIN u{k} USING (root) GROUP BY target"
    return parts


@R.add(using("SELECT id, root, stage FROM m3", cards=CARDS, **stages_sql()))
def person_unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People united by licence, then name and birth, then name and country; two years of birth under one key unite nobody."""
    k = F.col("c_custkey")
    birth = F.expr("1980 + (c_custkey div 6) % 20") + F.when(k % 7 == 0, 1).otherwise(0)
    cards = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 < 2, F.concat(F.lit("L"), F.expr("c_custkey div 8"))).alias("licence"), F.concat(F.lit("fencer "), F.expr("c_custkey div 3")).alias("name"),
        F.when(k % 5 != 0, birth).alias("birth"), (F.col("c_nationkey") % 2).alias("country"),
    )
    return linking.unite_in_stages(cards, STAGES, ["birth"])


def evidence_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(people, facts): customers as six cards a family, some official, some licensed, some a cut name alone, and their results."""
    k = F.col("c_custkey")
    family, card = F.expr("c_custkey div 6"), k % 6
    of = lambda *values: F.element_at(F.array(*values), (card + 1).cast("int"))
    nothing = F.lit(None).cast("string")
    surname = F.concat(F.lit("family"), family)
    words = lambda *more: F.array(surname, *map(F.lit, more))
    birth = F.date_add(F.lit("1980-01-01").cast("date"), (family % 3000).cast("int"))
    people = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(card == 0, F.concat(F.lit("W"), family)).alias("official"), F.when(card.isin(1, 3), F.concat(F.lit("L"), family)).alias("licence"),
        of(words("ana", "maria"), words("ana"), words(), words("ana"), words("eva"), words("eva", "luz")).alias("words"),
        F.when(card < 4, "F").otherwise(F.when(family % 4 == 0, "M").otherwise("F")).alias("gender"), F.when(card.isin(0, 4, 5), birth).alias("birth"),
    )
    return people, evidence_facts(results(spark, sf_dir), F.expr("person div 6"), F.col("person") % 6)


def evidence_facts(rows: DataFrame, family: Column, card: Column) -> DataFrame:
    """Results with a club of the family, another for some of its cards, and the years of birth that the category admits."""
    year = F.substring("season", -4, 4).cast("int")
    club = F.concat(F.lit("C"), (family + F.when(card == 4, 1).when((card == 2) & (family % 5 == 0), 2).otherwise(0)) % 40)
    young = F.col("category") == "HIGH"
    return rows.select(F.col("person").alias("id"), "competition", "weapon", club.alias("club"), year.alias("year"), F.when(young, year - 60).alias("low"), F.when(young, year - 8).alias("high"))


@R.add()
def person_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People united by licence, date of birth, the only fuller name, and the only one whom their results speak for."""
    return evidence.united(*evidence_rows(spark, sf_dir))


ROUNDS = """SELECT competition, size, CASE WHEN fact % 7 = 0 AND size <= 8 THEN -person ELSE person END AS who, place <= size // 2 AS won
    FROM result, (SELECT unnest([2, 4, 8, 16, 32]) AS size) WHERE place <= size AND format = 'INDIVIDUAL'"""
CONTINUED = """SELECT competition, size, min(who) FILTER (WHERE state = 'lost') AS who, min(who) FILTER (WHERE state = 'new') AS newcomer FROM (
    SELECT competition, size, who, 'lost' AS state FROM t l WHERE won AND NOT EXISTS (SELECT 1 FROM t n WHERE n.competition = l.competition AND n.size * 2 = l.size AND n.who = l.who)
    UNION ALL SELECT competition, size * 2, who, 'new' FROM t n WHERE NOT EXISTS (SELECT 1 FROM t l WHERE l.competition = n.competition AND l.size = n.size * 2 AND l.who = n.who))
    GROUP BY competition, size HAVING count(*) FILTER (WHERE state = 'lost') = 1 AND count(*) FILTER (WHERE state = 'new') = 1"""


@R.add(using(CONTINUED, "result", t=f"SELECT competition, size, who, bool_or(won) AS won FROM ({ROUNDS}) GROUP BY competition, size, who"))
def bracket_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a winner under another id is in the next round of a bracket: the one newcomer there."""
    sizes = F.explode(F.array(*map(F.lit, (2, 4, 8, 16, 32))))
    df = results(spark, sf_dir).where("format = 'INDIVIDUAL' AND place <= 32").withColumn("size", sizes).where("place <= size")
    who = F.when((F.col("fact") % 7 == 0) & (F.col("size") <= 8), -F.col("person")).otherwise(F.col("person"))
    return linking.continued(df.withColumn("who", who), ["competition"], "who", "size", F.col("place") <= F.col("size") / 2)


RENAMED = """SELECT competition, size, person + CASE WHEN fact % 7 <> 0 OR size > 16 THEN 0 WHEN size > 8 THEN 10000000 WHEN size > 2 THEN 20000000 ELSE 30000000 END AS who, place <= size // 2 AS won
    FROM result, (SELECT unnest([2, 4, 8, 16, 32]) AS size) WHERE place <= size AND format = 'INDIVIDUAL'"""


@R.add("WITH RECURSIVE" + using("SELECT * FROM c", "result", t=f"SELECT competition, size, who, bool_or(won) AS won FROM ({RENAMED}) GROUP BY competition, size, who", e=CONTINUED,
    c="""SELECT competition, newcomer, who AS root, 1 AS steps FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.competition = e.competition AND x.newcomer = e.who)
        UNION ALL SELECT e.competition, e.newcomer, c.root, c.steps + 1 FROM c JOIN e ON e.competition = c.competition AND e.who = c.newcomer""").removeprefix("WITH"))  # fmt: skip
def bracket_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which id someone began a bracket whose id changes from round to round, and how often it did."""
    sizes = F.explode(F.array(*map(F.lit, (2, 4, 8, 16, 32))))
    df = results(spark, sf_dir).where("format = 'INDIVIDUAL' AND place <= 32").withColumn("size", sizes).where("place <= size")
    size = F.col("size")
    shift = F.when((F.col("fact") % 7 != 0) | (size > 16), 0).when(size > 8, 10_000_000).when(size > 2, 20_000_000).otherwise(30_000_000)
    links = linking.continued(df.withColumn("who", F.col("person") + shift), ["competition"], "who", "size", F.col("place") <= size / 2)
    return linking.first_of_chain(links, ["competition"], "who", "newcomer")


READINGS = """SELECT a AS me, b AS rival, line % 3 AS weapon, competition * 20 + line * 2 + c AS reading, day + CAST(c * (line % 3) AS INTEGER) AS day,
    CASE WHEN (line + c) % 4 <> 0 THEN score_a + CASE WHEN c = 1 AND line % 5 = 0 THEN 1 ELSE 0 END END AS mine, CASE WHEN (competition + c) % 5 <> 0 THEN score_b END AS theirs,
    CASE WHEN line % 2 = c THEN 0 ELSE 1 + line % 2 END AS bouts FROM bout, (SELECT unnest([0, 1]) AS c)"""
DAYS = """SELECT *, sum(fresh) OVER (PARTITION BY me, rival, weapon ORDER BY day ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY me, rival, weapon ORDER BY day), day) <= 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT me, rival, weapon, day FROM k))"""
KEYS = """SELECT r.*, session, CAST(CASE WHEN mine IS NOT NULL AND theirs IS NOT NULL THEN [mine, theirs]
        WHEN mine IS NOT NULL THEN coalesce(first_value(CASE WHEN theirs IS NOT NULL THEN [mine, theirs] END) OVER (PARTITION BY me, rival, weapon, session, mine ORDER BY theirs IS NULL, bouts DESC, reading), [mine, NULL])
        WHEN theirs IS NOT NULL THEN coalesce(first_value(CASE WHEN mine IS NOT NULL THEN [mine, theirs] END) OVER (PARTITION BY me, rival, weapon, session, theirs ORDER BY mine IS NULL, bouts DESC, reading), [NULL, theirs]) END AS BIGINT[]) AS own
    FROM k r JOIN d USING (me, rival, weapon, day)"""
HEADS = """SELECT *, CASE WHEN own IS NULL THEN first_value(own) OVER (PARTITION BY me, rival, weapon, session ORDER BY own IS NULL, mine IS NULL OR theirs IS NULL, bouts DESC, reading) ELSE own END AS head FROM h"""
MET = """SELECT me, rival, weapon, strftime(min(day), '%Y-%m-%d') AS since, min(reading) AS first_reading, count(*) AS readings, max(mine) AS mine, max(theirs) AS theirs,
    CASE WHEN max(mine) < max(theirs) THEN 'me' WHEN max(mine) > max(theirs) THEN 'rival' WHEN max(mine) = max(theirs) THEN 'tie' END AS ahead,
    first(bouts ORDER BY mine IS NULL OR theirs IS NULL OR bouts = 0, bouts DESC, reading) AS bouts FROM g GROUP BY me, rival, weapon, session, coalesce(CAST(head AS VARCHAR), 'r' || reading)"""


@R.add(using(MET, "bout", k=READINGS, d=DAYS, h=KEYS, g=HEADS))
def encounter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions of two people, once each however many sources read them, with who finished ahead."""
    b = bouts(spark, sf_dir).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    line, c = F.col("line"), F.col("c")
    readings = b.select(
        F.col("a").alias("me"), F.col("b").alias("rival"), (line % 3).alias("weapon"), (F.col("competition") * 20 + line * 2 + c).alias("reading"), F.date_add("day", (c * (line % 3)).cast("int")).alias("day"),
        F.when((line + c) % 4 != 0, F.col("score_a") + F.when((c == 1) & (line % 5 == 0), 1).otherwise(0)).alias("mine"), F.when((F.col("competition") + c) % 5 != 0, F.col("score_b")).alias("theirs"),
        F.when(line % 2 == c, 0).otherwise(line % 2 + 1).alias("bouts"),
    )
    keys = ["me", "rival", "weapon"]
    met = encounters.grouped(divided(readings, 2 * table(spark, sf_dir, "lineitem").count(), *keys), keys)
    return met.withColumn("since", iso(F.col("since")))


ASKED = ("smal", "wiget")
SCORED = f"SELECT a, b, {SIMILARITY_SQL} AS score FROM (SELECT a, b, {phonetic_sql('a')} AS x, {phonetic_sql('b')} AS y FROM (SELECT unnest({list(ASKED)}) AS a), (SELECT DISTINCT b FROM w))"


@R.add(using("SELECT p_partkey, round(avg(best), 6) AS score FROM (SELECT p_partkey, a, max(score) AS best FROM w JOIN s USING (b) GROUP BY p_partkey, a) GROUP BY p_partkey HAVING min(best) > 0 AND count(*) = 2",
    w=f"SELECT p_partkey, unnest(string_split({form_sql('p_name')}, ' ')) AS b FROM part", s=SCORED))
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose names have a word like each of those asked for, by mean similarity; words are compared once, not once per name."""
    w = written(spread(table(spark, sf_dir, "part")).select("p_partkey", F.explode(X.words(F.col("p_name"))).alias("b")), "words")
    # Written, so that no filter on a score is moved below the distinct words, or over the join to every name's.
    scored = written(spread(w.select("b").distinct(), "b").select("b", *[X.similarity(F.lit(a), F.col("b")).alias(f"s{k}") for k, a in enumerate(ASKED)]), "scored")
    best = w.join(scored.where(" OR ".join(f"s{k} > 0" for k in range(len(ASKED)))), "b").groupBy("p_partkey").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(len(ASKED))])
    every = best.where(" AND ".join(f"s{k} > 0" for k in range(len(ASKED))))
    return every.select("p_partkey", F.round(sum(F.col(f"s{k}") for k in range(len(ASKED))) / len(ASKED), 6).alias("score"))


TYPED = "SELECT person AS query, CASE WHEN person % 200 = 0 THEN replace(name, 'o', '') ELSE substr(name, 1, 17) END AS text FROM athlete WHERE person % 100 = 0"
SOUGHT = """SELECT query, root, -b[3] AS id, b[1] AS score, b[2] AS weight, b[1] = 3 * n AS whole FROM (SELECT query, n, root, max([score, weight, -id]) AS b FROM (
    SELECT query, n, root, id, weight, count(*) AS found, sum(fit) AS score FROM (SELECT q.query, n, i, root, id, weight, max(CASE WHEN token = word THEN 3 WHEN length(word) >= 3 AND starts_with(token, word) THEN 2 WHEN length(word) > 3 AND levenshtein(word, token) <= 1 THEN 1 ELSE 0 END) AS fit
        FROM w q JOIN k ON true GROUP BY ALL) WHERE fit > 0 GROUP BY ALL HAVING count(*) = n) GROUP BY query, n, root)"""


@R.add(using("SELECT query, root, CAST(id AS BIGINT) AS id, CAST(score AS BIGINT) AS score, weight, whole, row_number() OVER (PARTITION BY query ORDER BY score DESC, weight DESC, root) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, weight DESC, root) <= 8", "athlete", q=TYPED,
    w=f"SELECT query, word, i, count(*) OVER (PARTITION BY query) AS n FROM (SELECT query, unnest(list_distinct(string_split({form_sql('text')}, ' '))) AS word, generate_subscripts(list_distinct(string_split({form_sql('text')}, ' ')), 1) AS i FROM q)",
    k=f"SELECT person AS id, person - CASE WHEN person % 10 = 9 THEN 1 ELSE 0 END AS root, CAST(person % 13 AS DOUBLE) AS weight, unnest(list_distinct(string_split({form_sql("name || ' ' || country_name")}, ' '))) AS token FROM athlete", s=SOUGHT))
def people_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best people for what a hundredth of them typed, with errors and cut short, in an index of all names."""
    a, person = athletes(spark, sf_dir), F.col("person")
    people = a.select(person.alias("id"), (person - F.when(person % 10 == 9, 1).otherwise(0)).alias("root"), F.concat_ws(" ", "name", "country_name").alias("name"), (person % 13).cast("double").alias("weight"))
    path = work_path(spark, "names")
    search_index.build(people, path)
    typed = a.where(person % 100 == 0).select(person.alias("query"), F.when(person % 200 == 0, F.translate("name", "o", "")).otherwise(F.substring("name", 1, 17)).alias("text"))
    return search_index.search(spark, path, typed, 8)
