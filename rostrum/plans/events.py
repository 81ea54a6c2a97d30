"""Queries over events: editions grouped to events, weekend blocks and free time, links by containment, bouts of several pages, fused sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.dates import iso
from rostrum.functions.text import edition_base
from rostrum.operators import clusters, event_links, ranking
from rostrum.operators.fusion import fused
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.sources.adapter import bouts, editions, results

R = Registry()

SOURCES = ["fie", "rfee_pdf", "skermo_rfee", "engarde"]
NATIONAL = ("rfee_pdf", "skermo_rfee", "engarde")
ARMS = ["Espada Masculina", "Sables Femeninos", "Florete por Equipos"]


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


def pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


NAMED = f"""SELECT edition, {SOURCES}[1 + dayofyear(start) % 4] AS source, season, 'Torneo ' || {ARMS}[1 + n % 3] || ' ' || city || ' ' || year(start) AS title, 'torneo ' || lower(city) AS name, city AS place, start, stop,
    CASE WHEN n % 4 = 3 THEN strftime(start, '%Y-%m') || city END AS event, CASE WHEN n % 2 = 0 THEN ['M17'] ELSE ['M17', 'M20'] END AS categories FROM edition"""


def named_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions with a source, a written name, and for some a calendar event."""
    day, n = F.col("start"), F.col("n")
    title = F.concat_ws(" ", F.lit("Torneo"), pick(ARMS, n), "city", F.year(day).cast("string"))
    event = F.when(n % 4 == 3, F.concat(F.date_format(day, "yyyy-MM"), F.col("city")))
    categories = F.when(n % 2 == 0, F.array(F.lit("M17"))).otherwise(F.array(F.lit("M17"), F.lit("M20")))
    return editions(spark, sf_dir).select("edition", pick(SOURCES, F.dayofyear(day)).alias("source"), "season", edition_base(title).alias("name"), F.col("city").alias("place"), "start", "stop", event.alias("event"), categories.alias("categories"))


CHAINS = {
    "m": NAMED,
    "o": "SELECT *, row_number() OVER (PARTITION BY source, season, name, place ORDER BY start, edition) AS k FROM m",
    "c": """SELECT edition, source, season, name, place, k, start AS chain, greatest(start, stop) AS upto FROM o WHERE k = 1
        UNION ALL SELECT o.edition, o.source, o.season, o.name, o.place, o.k,
            CASE WHEN o.start <= c.upto + 4 AND date_diff('day', c.chain, o.start) <= 16 THEN c.chain ELSE o.start END,
            CASE WHEN o.start <= c.upto + 4 AND date_diff('day', c.chain, o.start) <= 16 THEN greatest(c.upto, o.start, o.stop) ELSE greatest(o.start, o.stop) END
        FROM c JOIN o ON o.k = c.k + 1 AND o.source = c.source AND o.season = c.season AND o.name = c.name AND o.place = c.place""",
}


@R.add(recursive(using("SELECT edition, source, name, strftime(chain, '%Y-%m-%d') AS chain FROM c", "edition", **CHAINS)))
def edition_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day on which each edition's chain begins: one source, season, name and place, four days apart at most and sixteen in all."""
    df = clusters.chained(named_editions(spark, sf_dir), ["source", "season", "name", "place"], "start", "stop")
    return df.select("edition", "source", "name", iso(F.col("chain")).alias("chain"))


@R.add()
def edition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions grouped to events: by calendar events within a family, by chains, by chains of several national sources."""
    family = F.when(F.col("source").isin(*NATIONAL), "national").otherwise(F.col("source"))
    return clusters.event_groups(named_editions(spark, sf_dir), family, F.col("source").isin(*NATIONAL))


LONG = "start + CAST((CASE WHEN n > 1 AND dayofyear(start) % 9 = 0 THEN 5 ELSE n % 4 END) AS INTEGER)"
BLOCKS = {
    "e": f"SELECT edition, start, {LONG} AS stop, date_trunc('week', start) AS week FROM edition",
    "o": "SELECT *, row_number() OVER (PARTITION BY week ORDER BY start, stop, edition) AS k FROM e",
    "c": """SELECT edition, week, k, start AS s, stop AS t, strftime(start, '%Y-%m-%d') || '_' || edition AS block, stop AS first_stop FROM o WHERE k = 1
        UNION ALL SELECT o.edition, o.week, o.k, CASE WHEN f THEN c.s ELSE o.start END, CASE WHEN f THEN greatest(c.t, o.stop) ELSE o.stop END,
            CASE WHEN f THEN c.block ELSE strftime(o.start, '%Y-%m-%d') || '_' || o.edition END, CASE WHEN f THEN c.first_stop ELSE o.stop END
        FROM c JOIN o ON o.k = c.k + 1 AND o.week = c.week, LATERAL (SELECT o.start <= c.t AND date_diff('day', c.s, greatest(c.t, o.stop)) < 4 AS f)""",
    "b": "SELECT edition, block, s, max(t) OVER (PARTITION BY block) AS t, first_stop FROM c",
}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions, some of six days, in weekend blocks."""
    days = F.when((F.col("n") > 1) & (F.dayofyear("start") % 9 == 0), 5).otherwise(F.col("n") % 4)
    e = editions(spark, sf_dir).select("edition", "start", F.date_add("start", days.cast("int")).alias("stop"))
    return clusters.weekend_blocks(e, "edition", "start", "stop")


@R.add(recursive(using("SELECT edition, block, strftime(s, '%Y-%m-%d') AS block_start, strftime(t, '%Y-%m-%d') AS block_stop FROM b", "edition", **BLOCKS)))
def calendar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekend block of every edition: meeting editions of one week, four days at most."""
    return blocks(spark, sf_dir).select("edition", "block", iso(F.col("block_start")).alias("block_start"), iso(F.col("block_stop")).alias("block_stop"))


FREE = """SELECT month, strftime(prior + 1, '%Y-%m-%d') AS first, strftime(s - 1, '%Y-%m-%d') AS last, days,
    CASE WHEN days % 7 IN (0, 1, 6) THEN CASE WHEN (days + 1) // 7 = 1 THEN '1 semana libre' ELSE CAST((days + 1) // 7 AS VARCHAR) || ' semanas libres' END ELSE CAST(days AS VARCHAR) || ' días libres' END AS says
    FROM (SELECT *, date_diff('day', prior, s) - 1 AS days FROM (SELECT *, lag(t) OVER (PARTITION BY month ORDER BY s) AS prior
        FROM (SELECT strftime(s, '%Y-%m') AS month, s, arg_max(t, (first_stop, block)) AS t FROM b GROUP BY s))) WHERE days >= 7"""


@R.add(recursive(using(FREE.replace("FROM b", "FROM thin"), "edition", **{**BLOCKS, "e": BLOCKS["e"] + " WHERE dayofyear(start) % 10 = 1", "thin": "SELECT DISTINCT block, s, t, first_stop FROM b"})))
def free_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free time between the blocks of a month, on a calendar of every tenth day."""
    # A calendar without gaps has no free time: the blocks are those of a thinner one.
    days = F.when((F.col("n") > 1) & (F.dayofyear("start") % 9 == 0), 5).otherwise(F.col("n") % 4)
    e = editions(spark, sf_dir).where(F.dayofyear("start") % 10 == 1).select("edition", "start", F.date_add("start", days.cast("int")).alias("stop"))
    b = clusters.weekend_blocks(e, "edition", "start", "stop")
    first = b.groupBy("block", "block_start", "block_stop").agg(F.min(F.struct("start", "stop", "edition"))["stop"].alias("first_stop"))
    out = clusters.free_time(first)
    return out.select("month", iso(F.col("first")).alias("first"), iso(F.col("last")).alias("last"), F.col("days").cast("long").alias("days"), "says")


KEYED = """SELECT e.edition AS id, e.city, CASE WHEN e.n % 3 <> 0 THEN 'C' || CAST(e.n % 2 AS VARCHAR) END AS country, e.start, e.stop, e.source,
    list(DISTINCT r.weapon || '/' || CAST(r.person % 2 AS VARCHAR)) AS loose, list(DISTINCT r.weapon || '/' || CAST(r.person % 2 AS VARCHAR) || '/' || r.format) AS exact
    FROM edition e JOIN result r ON r.day = e.start AND r.category = e.city GROUP BY ALL"""
DECIDED = """SELECT id AS secondary, strftime(start + 1, '%Y%m%d') || '-' || substr(city, 1, 1) AS main, CASE WHEN day(start) = 11 THEN 'CONFIRMADO' ELSE 'RECHAZADO' END AS status FROM k WHERE source = 'int' AND day(start) IN (7, 11)"""
FITS = """SELECT s.id AS secondary, m.id AS main, len(list_filter(s.exact, lambda x: NOT list_contains(m.exact, x))) = 0 AS format, s.start = m.start AND s.stop = m.stop AS days FROM k s JOIN k m ON s.source = 'int' AND m.source = 'nac'
    AND s.city = m.city AND s.start <= m.stop AND m.start <= s.stop AND coalesce(s.country = m.country, true) AND len(list_filter(s.loose, lambda x: NOT list_contains(m.loose, x))) = 0
    WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.secondary = s.id AND (d.status = 'CONFIRMADO' OR d.main = m.id))"""
RULED = """SELECT secondary, main, CASE WHEN n = 1 THEN 'contained' WHEN formats = 1 THEN CASE WHEN format THEN 'exact_format' END WHEN same = 1 THEN CASE WHEN days THEN 'exact_days' END ELSE 'several' END AS rule
    FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE format) OVER w AS formats, count(*) FILTER (WHERE days) OVER w AS same FROM f WINDOW w AS (PARTITION BY secondary))"""


@R.add(using("""SELECT secondary, main, CASE WHEN rule = 'several' THEN 'doubt' ELSE 'link' END AS status, rule FROM r WHERE rule IS NOT NULL
    UNION ALL SELECT secondary, main, 'link', 'by_hand' FROM d WHERE status = 'CONFIRMADO' AND main IN (SELECT id FROM k)""", "edition", k=KEYED, d=DECIDED, f=FITS, r=RULED))  # fmt: skip
def contained_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of one source linked to those of the other that hold all their competitions, with tie-breaks, doubts and decisions by hand."""
    loose = F.concat_ws("/", "weapon", (F.col("person") % 2).cast("string"))
    of = results(spark, sf_dir).groupBy(F.col("day").alias("start"), F.col("category").alias("city")).agg(F.collect_set(loose).alias("loose"), F.collect_set(F.concat_ws("/", loose, "format")).alias("exact"))
    country = F.when(F.col("n") % 3 != 0, F.concat(F.lit("C"), (F.col("n") % 2).cast("string")))
    e = editions(spark, sf_dir).join(of, ["start", "city"]).select(F.col("edition").alias("id"), "city", country.alias("country"), "start", "stop", "source", "loose", "exact")
    second = e.where("source = 'int'")
    day = F.dayofmonth("start")
    main = F.concat_ws("-", F.date_format(F.date_add("start", 1), "yyyyMMdd"), F.substring("city", 1, 1))
    decisions = second.where(day.isin(7, 11)).select(F.col("id").alias("secondary"), main.alias("main"), F.when(day == 11, "CONFIRMADO").otherwise("RECHAZADO").alias("status"))
    return event_links.linked_events(e.where("source = 'nac'"), second, decisions, 4)


PAGES = """SELECT competition, phase, line, a, b, score_a, score_b, 'pools' AS page FROM bout
    UNION ALL SELECT competition, phase, line, b, a, score_b, score_a + CASE WHEN a % 3 = 0 THEN 1 ELSE 0 END, 'results' FROM bout WHERE line % 2 = 0
    UNION ALL SELECT competition, phase, line, a, b, score_a, score_b, 'results' FROM bout WHERE line % 4 = 0"""


@R.add(using("""SELECT competition, phase, line, a, b, CASE WHEN n = 1 THEN score_a END AS score_a, CASE WHEN n = 1 THEN score_b END AS score_b, copies, pages, CASE WHEN n = 1 THEN 'imported' ELSE 'conflict' END AS state
    FROM (SELECT competition, phase, line, least(a, b) AS a, greatest(a, b) AS b, any_value(CASE WHEN a < b THEN score_a ELSE score_b END) AS score_a, any_value(CASE WHEN a < b THEN score_b ELSE score_a END) AS score_b,
        count(*) AS copies, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN a < b THEN (score_a, score_b) ELSE (score_b, score_a) END) AS n FROM p GROUP BY competition, phase, line, least(a, b), greatest(a, b))""", "bout", p=PAGES))  # fmt: skip
def bout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of several pages as one row each: agreed ones once, contradictory ones withdrawn with their reason."""
    b = bouts(spark, sf_dir).select("competition", "phase", "line", "a", "b", F.col("score_a"), F.col("score_b"))
    swapped = b.where("line % 2 = 0").select("competition", "phase", "line", F.col("b").alias("a"), F.col("a").alias("b"), F.col("score_b").alias("score_a"), (F.col("score_a") + F.when(F.col("a") % 3 == 0, 1).otherwise(0)).alias("score_b"))
    pages = b.withColumn("page", F.lit("pools")).unionByName(swapped.withColumn("page", F.lit("results"))).unionByName(b.where("line % 4 = 0").withColumn("page", F.lit("results")))
    return event_links.merged_bouts(pages, ["competition", "phase", "line"], "a", "b", "score_a", "score_b", "page")


COPIED = """SELECT fact, person % 500 AS who, day, weapon, CAST(person % 2 AS VARCHAR) AS gender, category, format AS scope, ['fed', 'int', 'nac'][1 + fact % 3] AS source, CASE WHEN fact % 5 > 0 THEN place END AS place, fact % 7 AS bouts,
    count(*) OVER (PARTITION BY competition) AS participants, row_number() OVER (PARTITION BY person % 500, day, weapon, person % 2, category, format, fact % 3 ORDER BY fact) AS turn FROM result"""
GROUP = "who, day, weapon, gender, category, scope, turn"
STEP = """SELECT {group}, {k} AS k, CASE WHEN wins THEN y.fact ELSE x.fact END AS fact, CASE WHEN x.place > 0 AND y.place > 0 AND x.place <> y.place THEN NULL WHEN wins THEN coalesce(y.place, x.place) ELSE coalesce(x.place, y.place) END AS place,
    greatest(x.bouts, y.bouts) AS bouts, greatest(x.participants, y.participants) AS participants, x.sources || ',' || y.source AS sources, x.withdrawn OR coalesce(x.place > 0 AND y.place > 0 AND x.place <> y.place, false) AS withdrawn
    FROM {before} x JOIN t y USING ({group}), LATERAL (SELECT (y.place IS NOT NULL AND x.place IS NULL) OR ((y.place IS NULL) = (x.place IS NULL) AND y.bouts > x.bouts) AS wins) WHERE y.k = {k}"""


@R.add(using(f"SELECT {GROUP.replace('day', 'strftime(day, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') AS on_day')}, fact, place, bouts, participants, sources, withdrawn FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) QUALIFY k = max(k) OVER (PARTITION BY {GROUP})", "result",
    t=f"SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY fact) AS k FROM ({COPIED})", s1=f"SELECT {GROUP}, 1 AS k, fact, place, bouts, participants, source AS sources, false AS withdrawn FROM t WHERE k = 1", s2=STEP.format(group=GROUP, k=2, before="s1"), s3=STEP.format(group=GROUP, k=3, before="s2")))
def fused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A competition that several sources publish as one result of a person: contradictory places are none, each figure from the copy that has most."""
    r = ranking.with_field_sizes(results(spark, sf_dir)).select(
        "fact", (F.col("person") % 500).alias("who"), "day", "weapon", (F.col("person") % 2).cast("string").alias("gender"), "category", F.col("format").alias("scope"), pick(["fed", "int", "nac"], F.col("fact")).alias("source"),
        F.when(F.col("fact") % 5 > 0, F.col("place")).alias("place"), (F.col("fact") % 7).alias("bouts"), F.col("participants"),
    )
    return fused(r, ["who", "day", "weapon", "gender", "category", "scope"], "source", "fact").withColumn("day", iso(F.col("day"))).withColumnRenamed("day", "on_day")
