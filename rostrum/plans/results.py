"""Queries over results: performance, statistics, rankings, publications, qualification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions import points as P
from rostrum.functions.dates import iso, season_end
from rostrum.operators import qualification, ranking
from rostrum.operators.windows import change, first_per, numbered, ranked, top_k
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.sources.adapter import athletes, publications, results, table

R = Registry()

FIELD = "SELECT competition, greatest(coalesce(max(place), 0), count(*)) AS participants FROM result GROUP BY competition"


@R.add(using("SELECT * FROM field", "result", field=FIELD))
def field_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.field_sizes(results(spark, sf_dir))


FACTS = """SELECT person, competition, min(season) AS season, min(weapon) AS weapon, min(source) AS source, min(category) AS category, min(format) AS format, min(day) AS day,
    CASE WHEN min(place) = max(place) AND min(place) > 0 AND min(place) < 998 THEN min(place) END AS place, min(place) <> max(place) AS conflict FROM result GROUP BY person, competition"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person and competition; contradictory places become null."""
    lo, hi = F.min("place"), F.max("place")
    return results(spark, sf_dir).groupBy("person", "competition").agg(
        *[F.min(c).alias(c) for c in ("season", "weapon", "source", "category", "format", "day")],
        F.when((lo == hi) & (lo > 0) & (lo < 998), lo).alias("place"), (lo != hi).alias("conflict"))


PERCENTILE = "CASE WHEN f.place BETWEEN 1 AND s.participants AND s.participants >= 2 THEN round(f.place / s.participants, 6) END"


@R.add(using(f"SELECT f.person, f.competition, f.season, f.place, f.conflict, s.participants, {PERCENTILE} AS percentile FROM f JOIN field s USING (competition)", "result", field=FIELD, f=FACTS))
def performance_by_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).join(ranking.field_sizes(results(spark, sf_dir)), "competition")
    p, n = F.col("place"), F.col("participants")
    return df.select("person", "competition", "season", "place", "conflict", "participants", F.when(p.between(1, n) & (n >= 2), F.round(p / n, 6)).alias("percentile"))


MEDALS = """count(*) AS competitions, count(place) AS ranked, min(place) AS best, count(*) FILTER (WHERE place <= 3) AS podiums, count(*) FILTER (WHERE place = 1) AS golds, count(*) FILTER (WHERE place = 2) AS silvers,
    count(*) FILTER (WHERE place = 3) AS bronzes, count(*) FILTER (WHERE place <= 8) AS top8, count(*) FILTER (WHERE place IS NULL) AS unranked, count(*) FILTER (WHERE conflict) AS conflicts, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day"""


def medals() -> list:
    p = F.col("place")
    return [
        F.count("*").alias("competitions"), F.count("place").alias("ranked"), F.min("place").alias("best"), F.count_if(p <= 3).alias("podiums"), F.count_if(p == 1).alias("golds"), F.count_if(p == 2).alias("silvers"),
        F.count_if(p == 3).alias("bronzes"), F.count_if(p <= 8).alias("top8"), F.count_if(p.isNull()).alias("unranked"), F.count_if("conflict").alias("conflicts"), iso(F.min("day")).alias("first_day"), iso(F.max("day")).alias("last_day"),
    ]


@R.add(using(f"SELECT person, CASE grouping(category, weapon, season) WHEN 7 THEN 'total' WHEN 1 THEN 'dims' ELSE 'season' END AS class, category, weapon, season, {MEDALS} FROM f GROUP BY GROUPING SETS ((person), (person, category, weapon), (person, season))", "result", f=FACTS))
def result_statistics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).groupingSets([["person"], ["person", "category", "weapon"], ["person", "season"]], "person", "category", "weapon", "season").agg(*medals(), F.grouping("category").alias("gc"), F.grouping("season").alias("gs"))
    return df.withColumn("class", F.when((F.col("gc") == 1) & (F.col("gs") == 1), "total").when(F.col("gc") == 0, "dims").otherwise("season")).drop("gc", "gs")


@R.add(using(f"SELECT person, season, median(place) AS median_place, {MEDALS} FROM f GROUP BY person, season", "result", f=FACTS))
def performance_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("person", "season").agg(F.median("place").alias("median_place"), *medals())


@R.add(using(f"SELECT scope, zone, category, {MEDALS} FROM e GROUP BY ALL", "result", "athlete", f=FACTS, x="SELECT f.*, a.zone, CASE WHEN source = 'int' THEN 'INTERNACIONAL' ELSE 'NACIONAL' END AS own FROM f JOIN athlete a USING (person)", e="SELECT *, 'todo' AS scope FROM x UNION ALL SELECT *, own FROM x"))
def scope_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("source") == "int", "INTERNACIONAL").otherwise("NACIONAL")
    df = facts(spark, sf_dir).join(athletes(spark, sf_dir).select("person", "zone"), "person").withColumn("scope", F.explode(F.array(F.lit("todo"), own)))
    return df.groupBy("scope", "zone", "category").agg(*medals())


@R.add(using("SELECT b.person, b.y AS season_year, coalesce(n, 0) AS n FROM (SELECT person, unnest(generate_series(min(y), max(y))) AS y FROM g GROUP BY person) b LEFT JOIN g ON g.person = b.person AND g.y = b.y", "result", g="SELECT person, CAST(substr(season, 6) AS INTEGER) AS y, count(*) AS n FROM result GROUP BY 1, 2"))
def season_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = results(spark, sf_dir).groupBy("person", season_end(F.col("season")).alias("season_year")).agg(F.count("*").alias("n"))
    span = g.groupBy("person").agg(F.sequence(F.min("season_year"), F.max("season_year")).alias("y")).select("person", F.explode("y").alias("season_year"))
    return span.join(g, ["person", "season_year"], "left").select("person", "season_year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Rankings. Rules: one for all, one for a weapon, one for a weapon and category.

RULES = [("r0", None, None, None, 5, 1.0), ("r1", None, "SABLE", None, 4, 1.2), ("r2", None, "SABLE", "URGENT", 3, 1.5), ("r3", None, None, "HIGH", 6, 0.8)]
RULE_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES) + ") AS t(rule, season, weapon, category, counting, coefficient)"


MATCHED = """SELECT * EXCLUDE (rn) FROM (SELECT r.*, u.rule, u.counting, u.coefficient, row_number() OVER (PARTITION BY r.fact ORDER BY (CASE WHEN u.weapon IS NULL THEN 0 ELSE 2 END) + (CASE WHEN u.category IS NULL THEN 0 ELSE 1 END) DESC, u.rule) AS rn
    FROM result r JOIN rule u ON (u.weapon IS NULL OR u.weapon = r.weapon) AND (u.category IS NULL OR u.category = r.category)) WHERE rn = 1"""
STEP_SQL = "CASE " + " ".join(f"WHEN place BETWEEN {lo} AND {hi} THEN {v}" for (lo, hi), v in P.STEPS.items()) + " END"
FORMULA_SQL = f"CASE WHEN participants >= 2 AND place BETWEEN 1 AND participants AND {STEP_SQL} IS NOT NULL THEN floor((coefficient * ({STEP_SQL} + {P.SCALE} * ({P.CEILING} - log10(place) / log10(participants))) + 2.220446049250313e-16) * 100 + 0.5) / 100 END"
CONTRIB = f"SELECT m.*, participants, {FORMULA_SQL} AS final FROM m JOIN field USING (competition) WHERE format = 'INDIVIDUAL'"
CHOSEN = "SELECT *, n <= counting AND final > 0 AS counted FROM (SELECT *, row_number() OVER (PARTITION BY season, weapon, person ORDER BY final DESC NULLS LAST, day DESC, fact) AS n FROM c)"
TOTAL = "SELECT *, rank() OVER (PARTITION BY season, weapon ORDER BY total DESC) AS position FROM (SELECT season, weapon, person, round(sum(CASE WHEN counted THEN final ELSE 0 END), 2) AS total, count(*) FILTER (WHERE counted) AS events FROM ch GROUP BY season, weapon, person)"
CHAIN = {"field": FIELD, "rule": RULE_SQL, "m": MATCHED, "c": CONTRIB, "ch": CHOSEN, "t": TOTAL}


def upto(last: str) -> dict[str, str]:
    keys = list(CHAIN)
    return {k: CHAIN[k] for k in keys[: keys.index(last) + 1]}


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every individual result with its rule, field size and points by formula."""
    res = results(spark, sf_dir)
    df = ranking.with_field_sizes(ranking.match_rules(res, RULES)).where("format = 'INDIVIDUAL'")
    return df.withColumn("final", P.formula(F.col("place"), F.col("participants"), F.col("coefficient")))


GROUP = ("season", "weapon", "person")


def season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.totals(ranking.best_n(contributions(spark, sf_dir), GROUP), GROUP, ("season", "weapon"))


@R.add(using("SELECT fact, rule, counting, coefficient FROM m", "result", **upto("m")))
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.match_rules(results(spark, sf_dir), RULES).select("fact", "rule", "counting", "coefficient")


@R.add(using("SELECT fact, place, participants, final FROM c", "result", **upto("c")))
def points_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).select("fact", "place", "participants", "final")


@R.add(using("SELECT fact, season, weapon, person, final, n, counted FROM ch", "result", **upto("ch")))
def best_n_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_n(contributions(spark, sf_dir), GROUP).select("fact", *GROUP, "final", "n", "counted")


@R.add(using("SELECT * FROM t", "result", **upto("t")))
def season_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season_table(spark, sf_dir)


@R.add(using("SELECT season, weapon, person, position, total, CASE WHEN position <= 20 THEN 'inside' WHEN cut IS NULL THEN 'unknown' ELSE 'outside' END AS state, greatest(position - 20, 0) AS places_away, round(CASE WHEN position <= 20 THEN 0 ELSE cut - total END, 2) AS points_away FROM (SELECT *, min(total) FILTER (WHERE position <= 20) OVER (PARTITION BY season, weapon) AS cut FROM t)", "result", **upto("t")))
def cutoff_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cutoff(season_table(spark, sf_dir), ("season", "weapon"), 20).select("season", "weapon", "person", "position", "total", "state", "places_away", "points_away")


@R.add(using("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN format = 'EQUIPOS' THEN 'team' WHEN participants < 2 THEN 'small field' WHEN place > 128 THEN 'no step' ELSE 'used' END AS reason FROM result JOIN field USING (competition)) GROUP BY reason", "result", field=FIELD))
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results(spark, sf_dir).join(ranking.field_sizes(results(spark, sf_dir)), "competition")
    reason = F.when(F.col("format") == "EQUIPOS", "team").when(F.col("participants") < 2, "small field").when(F.col("place") > 128, "no step").otherwise("used")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.add(using("SELECT person, fact, final, counted, n FROM ch", "result", **upto("ch")))
def athlete_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_n(contributions(spark, sf_dir), GROUP).select("person", "fact", "final", "counted", "n")


# Publications.

POSITION = "SELECT *, rank() OVER (PARTITION BY season, weapon, ym ORDER BY points DESC) AS position FROM publication"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(publications(spark, sf_dir), ["season", "weapon", "ym"], F.desc("points"), "position")


@R.add(using("SELECT season, weapon, person, ym, position, lag(position) OVER (PARTITION BY season, weapon, person ORDER BY ym) - position AS climbed FROM p", "publication", p=POSITION))
def ranking_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change(positions(spark, sf_dir), ["season", "weapon", "person"], ["ym"], "position", "climbed").drop("points")


@R.add(using("SELECT person, weapon, season, ym, position, points FROM p", "publication", p=POSITION))
def ranking_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("person", "weapon", "season", "ym", "position", "points")


LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY season, weapon, person ORDER BY ym DESC) AS rn FROM p) WHERE rn = 1"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(positions(spark, sf_dir), ["season", "weapon", "person"], [F.desc("ym")])


@R.add(using("SELECT season, weapon, person, ym, points, position FROM l", "publication", p=POSITION, l=LATEST))
def latest_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("season", "weapon", "person", "ym", "points", "position")


@R.add(using("SELECT person, weapon, y, position, CASE WHEN lag(y) OVER w = y - 1 THEN lag(position) OVER w - position END AS climbed FROM (SELECT *, CAST(substr(season, 6) AS INTEGER) AS y FROM l) WINDOW w AS (PARTITION BY person, weapon ORDER BY y)", "publication", p=POSITION, l=LATEST))
def ranking_season_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between seasons, only when they follow each other."""
    df = latest(spark, sf_dir).withColumn("y", season_end(F.col("season")))
    w = Window.partitionBy("person", "weapon").orderBy("y")
    return df.select("person", "weapon", "y", "position", F.when(F.lag("y").over(w) == F.col("y") - 1, F.lag("position").over(w) - F.col("position")).alias("climbed"))


@R.add(using("SELECT person, weapon, min(position) AS best, max(season) FILTER (WHERE position = b) AS best_season, count(*) FILTER (WHERE position <= 10) AS top10 FROM (SELECT *, min(position) OVER (PARTITION BY person, weapon) AS b FROM l) GROUP BY person, weapon", "publication", p=POSITION, l=LATEST))
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best position and, of equals, the newest season."""
    best = F.min(F.struct("position", (-season_end(F.col("season"))).alias("e")))
    df = latest(spark, sf_dir).groupBy("person", "weapon").agg(best.alias("b"), F.count_if(F.col("position") <= 10).alias("top10"))
    end = -F.col("b.e")
    return df.select("person", "weapon", F.col("b.position").alias("best"), F.concat_ws("-", (end - 1).cast("string"), end.cast("string")).alias("best_season"), "top10")


@R.add(using("SELECT season, weapon, CASE WHEN max(ym) FILTER (WHERE source = 'int') >= max(ym) FILTER (WHERE source = 'nac') OR max(ym) FILTER (WHERE source = 'nac') IS NULL THEN 'int' ELSE 'nac' END AS chosen, max(ym) AS ym, count(DISTINCT person) AS people FROM result GROUP BY season, weapon", "result"))
def list_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per list the source that was read last; the international one on ties."""
    by = results(spark, sf_dir).groupBy("season", "weapon").agg(F.max(F.when(F.col("source") == "int", F.col("ym"))).alias("i"), F.max(F.when(F.col("source") == "nac", F.col("ym"))).alias("n"), F.max("ym").alias("ym"), F.countDistinct("person").alias("people"))
    return by.select("season", "weapon", F.when((F.col("i") >= F.col("n")) | F.col("n").isNull(), "int").otherwise("nac").alias("chosen"), "ym", "people")


@R.add(using("SELECT season, weapon, ym, count(*) AS n, count(position) AS placed, min(points) AS least FROM p GROUP BY season, weapon, ym", "publication", p=POSITION))
def list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).groupBy("season", "weapon", "ym").agg(F.count("*").alias("n"), F.count("position").alias("placed"), F.min("points").alias("least"))


@R.add(using("SELECT person, weapon, season, position, n, count(*) OVER (PARTITION BY season, weapon, ym, points) AS tied, min(position) OVER (PARTITION BY season, weapon, ym, points) AS token FROM (SELECT *, row_number() OVER (PARTITION BY season, weapon, ym ORDER BY points DESC, person) AS n FROM p)", "publication", p=POSITION))
def tie_stable_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank token that a new order within a tie does not change."""
    df = numbered(positions(spark, sf_dir), ["season", "weapon", "ym"], [F.desc("points"), "person"], "n")
    w = Window.partitionBy("season", "weapon", "ym", "points")
    return df.select("person", "weapon", "season", "position", "n", F.count("*").over(w).alias("tied"), F.min("position").over(w).alias("token"))


BLOCK = "SELECT person, weapon, 'world' AS block, position, season, ym FROM l UNION ALL SELECT l.person, l.weapon, 'zone', rank() OVER (PARTITION BY l.season, l.weapon, a.zone ORDER BY l.points DESC), l.season, l.ym FROM l JOIN athlete a USING (person) UNION ALL SELECT l.person, l.weapon, 'country', rank() OVER (PARTITION BY l.season, l.weapon, a.country ORDER BY l.points DESC), l.season, l.ym FROM l JOIN athlete a USING (person)"


@R.add(using("SELECT person, weapon, block, arg_max(position, season) AS current, min(position) AS best, count(*) AS seasons FROM b GROUP BY person, weapon, block", "publication", "athlete", p=POSITION, l=LATEST, b=BLOCK))
def international_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest(spark, sf_dir).join(athletes(spark, sf_dir).select("person", "zone", "country"), "person")
    df = ranked(ranked(df, ["season", "weapon", "zone"], F.desc("points"), "zp"), ["season", "weapon", "country"], F.desc("points"), "cp")
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), F.col(c).alias("position")) for n, c in (("world", "position"), ("zone", "zp"), ("country", "cp"))]))
    df = df.select("person", "weapon", "season", one.alias("x")).select("person", "weapon", "season", "x.*")
    return df.groupBy("person", "weapon", "block").agg(F.max_by("position", "season").alias("current"), F.min("position").alias("best"), F.count("*").alias("seasons"))


# Qualification: the best team points of a country are the sums of its three best people.

TEAMS = """SELECT weapon, country, zone, round(sum(points), 2) AS points FROM (SELECT l.weapon, a.country, a.zone, l.points, row_number() OVER (PARTITION BY l.weapon, a.country ORDER BY l.points DESC, l.person) AS rn FROM lw l JOIN athlete a USING (person)) WHERE rn <= 3 GROUP BY ALL"""
LAST = "SELECT * FROM l WHERE season = (SELECT max(season) FROM l)"
TEAMPOS = "SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY points DESC, country) AS place FROM teams"
QUALIFIED = """SELECT weapon, country, zone, place, 'top' AS via FROM tp WHERE place <= 4
    UNION ALL SELECT weapon, country, zone, place, 'zone' FROM (SELECT *, row_number() OVER (PARTITION BY weapon, zone ORDER BY place) AS zn FROM tp WHERE place BETWEEN 5 AND 24) WHERE zn = 1"""
QCHAIN = {"p": POSITION, "l": LATEST, "lw": LAST, "teams": TEAMS, "tp": TEAMPOS, "q": QUALIFIED}


def last_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest positions of the last season: that season is read from the results alone, and put before the ranks."""
    last = results(spark, sf_dir).agg(F.max("season").alias("s")).scalar()
    return latest(spark, sf_dir).where(F.col("season") == last)


def team_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = last_season(spark, sf_dir).join(athletes(spark, sf_dir).select("person", "country", "zone"), "person")
    best = top_k(df, ["weapon", "country"], [F.desc("points"), "person"], 3).groupBy("weapon", "country", "zone").agg(F.round(F.sum("points"), 2).alias("points"))
    return numbered(best, ["weapon"], [F.desc("points"), "country"], "place")


def qualified(teams: DataFrame) -> DataFrame:
    """The four best teams, and of places 5 to 24 the best of each zone."""
    first = teams.where("place <= 4").withColumn("via", F.lit("top"))
    zones = first_per(teams.where("place BETWEEN 5 AND 24"), ["weapon", "zone"], ["place"]).withColumn("via", F.lit("zone"))
    return first.unionByName(zones).select("weapon", "country", "zone", "place", "via")


@R.add(using("SELECT * FROM q", "publication", "athlete", **QCHAIN))
def qualification_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualified(team_places(spark, sf_dir))


@R.add(using("""SELECT weapon, person, country, zone, 'team' AS via, rn AS n FROM (SELECT i.*, row_number() OVER (PARTITION BY i.weapon, i.country ORDER BY i.points DESC, i.person) AS rn FROM i JOIN q ON q.weapon = i.weapon AND q.country = i.country) WHERE rn <= 3
    UNION ALL SELECT weapon, person, country, zone, 'world', n FROM o WHERE n <= 2
    UNION ALL SELECT weapon, person, country, zone, 'zone', zn FROM (SELECT *, row_number() OVER (PARTITION BY weapon, zone ORDER BY n) AS zn FROM o WHERE n > 2) WHERE zn = 1""",
    "publication", "athlete", **QCHAIN, i="SELECT lw.*, a.country, a.zone FROM lw JOIN athlete a USING (person)", o="SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY points DESC, person) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.weapon = i.weapon AND q.country = i.country)"))
def qualification_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three people of each qualified team; of other countries two by world place, then one per zone."""
    people = last_season(spark, sf_dir).join(athletes(spark, sf_dir).select("person", "country", "zone"), "person")
    teams = qualified(team_places(spark, sf_dir)).select("weapon", "country")
    columns = ["weapon", "person", "country", "zone", "via", "n"]
    team = top_k(people.join(teams, ["weapon", "country"], "left_semi"), ["weapon", "country"], [F.desc("points"), "person"], 3, "n").withColumn("via", F.lit("team"))
    others = numbered(people.join(teams, ["weapon", "country"], "left_anti"), ["weapon"], [F.desc("points"), "person"], "n")
    world = others.where("n <= 2").withColumn("via", F.lit("world"))
    zone = top_k(others.where("n > 2"), ["weapon", "zone"], ["n"], 1, "zn").drop("n").withColumnRenamed("zn", "n").withColumn("via", F.lit("zone"))
    return team.select(columns).unionByName(world.select(columns)).unionByName(zone.select(columns))


@R.add(using("SELECT weapon, country, points, round(prev - points, 2) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY place) AS n FROM (SELECT *, lag(points) OVER (PARTITION BY weapon ORDER BY place) AS prev FROM tp) t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.weapon = t.weapon AND q.country = t.country)) WHERE n = 1", "publication", "athlete", **QCHAIN))
def first_out_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = team_places(spark, sf_dir)
    before = teams.withColumn("prev", F.lag("points").over(Window.partitionBy("weapon").orderBy("place")))
    out = before.join(qualified(teams).select("weapon", "country"), ["weapon", "country"], "left_anti")
    return first_per(out, ["weapon"], ["place"]).select("weapon", "country", "points", F.round(F.col("prev") - F.col("points"), 2).alias("gap"))


# Zones in the order in which the places of those without a team are given on, and countries whose entry is not decided.
ZONES, PENDING = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "OCEANIA"], [3, 7, 12]


def annotated_sql(n: str, where: str) -> dict[str, str]:
    """Expressions that end in `a`: the teams that count with via, way, state, margin, missing and ahead."""
    e, z, o, r, q, x, c = (f"{k}{n}" for k in "ezorqxc")
    at = lambda place: f"(SELECT points FROM {e} k WHERE k.weapon = x.weapon AND k.place = {place})"
    heir, won = f"(SELECT min(points) FROM {q} k WHERE k.weapon = x.weapon AND via = 'next')", f"(SELECT points FROM {q} k WHERE k.weapon = x.weapon AND k.zone = x.zone AND via = 'zone')"
    return {
        e: f"SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY points DESC, country) AS place FROM teams WHERE {where}",
        z: f"SELECT * FROM {e} WHERE place BETWEEN 5 AND 24 QUALIFY row_number() OVER (PARTITION BY weapon, zone ORDER BY place) = 1",
        o: f"SELECT weapon, way, row_number() OVER (PARTITION BY weapon ORDER BY i) AS k FROM (SELECT DISTINCT weapon FROM {e}) d, (SELECT unnest({ZONES}) AS way, unnest(range({len(ZONES)})) AS i) v WHERE NOT EXISTS (SELECT 1 FROM {z} s WHERE s.weapon = d.weapon AND s.zone = v.way)",
        r: f"SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY place) AS k FROM {e} WHERE place > 4 AND (weapon, country) NOT IN (SELECT (weapon, country) FROM {z})",
        q: f"SELECT *, 'top' AS via, NULL AS way FROM {e} WHERE place <= 4 UNION ALL SELECT *, 'zone', zone FROM {z} UNION ALL SELECT r.* EXCLUDE (k), 'next', way FROM {r} r JOIN {o} o USING (weapon, k)",
        x: f"SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY place) AS m, row_number() OVER (PARTITION BY weapon, zone ORDER BY place) AS zm FROM {e} WHERE (weapon, country) NOT IN (SELECT (weapon, country) FROM {q})",
        c: f"""SELECT weapon, country, arg_min(via, (missing, i)) AS via, min(missing) AS missing, arg_min(ahead, (missing, i)) AS ahead FROM (SELECT *, round(greatest(0, against - points), 2) AS missing FROM (
            SELECT x.*, 1 AS i, 'top' AS via, {at(4)} AS against, place - 4 AS ahead FROM {x} x WHERE m = 1 UNION ALL SELECT x.*, 2, 'zone', coalesce({won}, {at(24)}), 1 FROM {x} x WHERE zm = 1 UNION ALL SELECT x.*, 3, 'next', {heir}, 1 FROM {x} x WHERE m = 1))
            WHERE missing <= against * (1.0 / 3) GROUP BY weapon, country""",
        f"a{n}": f"""SELECT weapon, country, zone, points, place, via, way, 'qualified' AS state, round(CASE WHEN points > rival THEN points - rival WHEN rival IS NOT NULL THEN 0 END, 2) AS margin, NULL AS missing, NULL AS ahead FROM (SELECT *, CASE via WHEN 'top' THEN {at(5)}
            WHEN 'zone' THEN (SELECT points FROM {x} k WHERE k.weapon = x.weapon AND k.zone = x.zone AND zm = 1) ELSE (SELECT points FROM {x} k WHERE k.weapon = x.weapon AND m = 1) END AS rival FROM {q} x)
            UNION ALL SELECT x.weapon, x.country, x.zone, x.points, x.place, c.via, NULL, CASE WHEN c.via IS NULL THEN 'out' ELSE 'near' END, NULL, c.missing, c.ahead FROM {x} x LEFT JOIN {c} c USING (weapon, country)""",
    }


@R.add(using("""SELECT *, NULL AS would_be, NULL AS would_via FROM a1 UNION ALL SELECT weapon, country, zone, points, NULL, NULL, NULL, 'pending', NULL, NULL, NULL, CASE WHEN state <> 'out' THEN state END, CASE WHEN state <> 'out' THEN via END FROM a2 WHERE country IN (3, 7, 12)""",
    "publication", "athlete", **{k: QCHAIN[k] for k in ("p", "l", "lw", "teams")}, **annotated_sql("1", "country NOT IN (3, 7, 12)"), **annotated_sql("2", "true")))
def qualification_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every team's state: in, with its margin; near, with what it lacks; out; or pending, with what it would have."""
    return qualification.with_pending(team_places(spark, sf_dir).drop("place"), "weapon", ZONES, PENDING)


# Podiums, classification, medals, recency.

@R.add(using("SELECT competition, person, place, main FROM (SELECT r.competition, r.person, r.place, s.main FROM result r JOIN (SELECT competition, arg_max(format, (n, format)) AS main FROM (SELECT competition, format, count(*) AS n FROM result GROUP BY 1, 2) GROUP BY competition) s ON s.competition = r.competition AND s.main = r.format WHERE r.place <= 3)", "result"))
def podiums_main_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 1 to 3 of the format that has most rows in a competition."""
    df = results(spark, sf_dir)
    main = df.groupBy("competition", "format").agg(F.count("*").alias("n")).groupBy("competition").agg(F.max_by("format", F.struct("n", "format")).alias("main"))
    return df.join(main, "competition").where("format = main AND place <= 3").select("competition", "person", "place", "main")


@R.add(using("SELECT person, place, fact FROM (SELECT person, fact, CASE WHEN place % 7 = 0 THEN NULL ELSE place END AS place FROM result WHERE competition = '199703-1') WHERE place > 5 OR place IS NULL ORDER BY place NULLS LAST, fact LIMIT 21", "result"))
def classification_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a keyset cursor, unplaced people last."""
    df = results(spark, sf_dir).where("competition = '199703-1'").select("person", "fact", F.when(F.col("place") % 7 != 0, F.col("place")).alias("place"))
    return df.where("place > 5 OR place IS NULL").orderBy(F.asc_nulls_last("place"), "fact").limit(21).select("person", "place", "fact")


LEVELS = {"URGENT": 1, "HIGH": 2, "MEDIUM": 3}


@R.add(using("SELECT person, competition, place, level FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY level, place, day DESC, competition) AS rn FROM (SELECT *, CASE category WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 9 END AS level FROM f WHERE place <= 3)) WHERE rn = 1", "result", f=FACTS))
def medal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most valuable medal of each person."""
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("category")), F.lit(9))
    df = facts(spark, sf_dir).where("place <= 3").withColumn("level", order)
    return first_per(df, ["person"], ["level", "place", F.desc("day"), "competition"]).select("person", "competition", "place", "level")


@R.add(using("SELECT person, competition, season, place, rn FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY place, day DESC, competition) AS rn FROM f WHERE place IS NOT NULL) WHERE rn <= 3", "result", f=FACTS))
def best_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(facts(spark, sf_dir).where("place IS NOT NULL"), ["person"], ["place", F.desc("day"), "competition"], 3).select("person", "competition", "season", "place", "rn")


@R.add(using("SELECT person, strftime(day, '%Y-%m-%d') AS day, competition FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY day DESC, competition DESC) AS rn FROM f) WHERE rn = 1", "result", f=FACTS))
def most_recent_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(facts(spark, sf_dir), ["person"], [F.desc("day"), F.desc("competition")]).select("person", iso(F.col("day")).alias("day"), "competition")


AS_OF = "2001-08-01"


@R.add(using(f"SELECT person, CAST(sum(CASE WHEN day >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN 4 WHEN day >= DATE '{AS_OF}' - INTERVAL 24 MONTH THEN 3 WHEN day >= DATE '{AS_OF}' - INTERVAL 36 MONTH THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM f GROUP BY person", "result", f=FACTS))
def recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda months: F.col("day") >= F.add_months(F.lit(AS_OF).cast("date"), -months)
    return facts(spark, sf_dir).groupBy("person").agg(F.sum(F.when(since(12), 4).when(since(24), 3).when(since(36), 2).otherwise(1)).cast("long").alias("weight"))


@R.add(using("SELECT person, arg_max(competition, (day, competition)) AS last FROM f GROUP BY person", "result", f=FACTS))
def argmax_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("person").agg(F.max_by("competition", F.struct("day", "competition")).alias("last"))


@R.add(using("SELECT person, string_agg(DISTINCT weapon, ',' ORDER BY weapon) AS weapons, string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM result GROUP BY person", "result"))
def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return results(spark, sf_dir).groupBy("person").agg(join("weapon").alias("weapons"), join("format").alias("formats"))


@R.add(using("SELECT person, coalesce(string_agg(CAST(fact AS VARCHAR), ',' ORDER BY fact) FILTER (WHERE place <= 3), '') AS facts FROM result GROUP BY person", "result"))
def filtered_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.col("fact"))))
    return results(spark, sf_dir).groupBy("person").agg(F.array_join(kept.cast("array<string>"), ",").alias("facts"))


@R.add(using("SELECT person, count(DISTINCT weapon) AS weapons FROM result WHERE category IN ('URGENT', 'HIGH') GROUP BY person HAVING count(DISTINCT weapon) = 3", "result"))
def having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where(F.col("category").isin("URGENT", "HIGH")).groupBy("person").agg(F.countDistinct("weapon").alias("weapons")).where("weapons = 3")


@R.add(using("SELECT weapon, count(DISTINCT person) AS people FROM result GROUP BY weapon", "result"))
def weapon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("weapon").agg(F.countDistinct("person").alias("people"))


@R.add("SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return df.select("y", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in ("F", "O", "P")])


@R.add(using("SELECT competition, person, place FROM (SELECT *, row_number() OVER (PARTITION BY ym, person ORDER BY competition) AS rn FROM result) WHERE rn = 1", "result"))
def one_row_per_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a person and month: the first competition and, of several rows there, the best place."""
    return first_per(results(spark, sf_dir), ["ym", "person"], ["competition", "place"]).select("competition", "person", "place")


@R.add(using("SELECT person, rn FROM (SELECT person, row_number() OVER (ORDER BY name, person) AS rn FROM athlete)", "athlete"))
def surrogate_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in name order: sorted ranges number themselves, after the sizes of those before them."""
    from rostrum.operators.numbering import numbered_in_order

    return numbered_in_order(athletes(spark, sf_dir).select("person", "name"), ["name", "person"], "rn").select("person", "rn")


@R.add(using("SELECT max(season) AS season FROM (SELECT season FROM result GROUP BY season HAVING count(DISTINCT format) = 2)", "result"))
def season_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("season").agg(F.countDistinct("format").alias("n")).where("n = 2").agg(F.max("season").alias("season"))


@R.add(using("SELECT competition, min(season) AS season, string_agg(DISTINCT format, ',' ORDER BY format) AS formats, count(*) AS rows, count(*) FILTER (WHERE place IS NULL) AS unplaced, CASE WHEN count(*) = max(place) THEN 'complete' ELSE 'partial' END AS state FROM result GROUP BY competition", "result"))
def edition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results(spark, sf_dir).groupBy("competition").agg(F.min("season").alias("season"), F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"), F.count("*").alias("rows"), F.count_if(F.col("place").isNull()).alias("unplaced"), F.max("place").alias("last"))
    return df.withColumn("state", F.when(F.col("rows") == F.col("last"), "complete").otherwise("partial")).drop("last")


@R.add(using("SELECT season, position, person, weapon FROM (SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY position, person) AS rn FROM lw) WHERE rn <= 3", "publication", p=POSITION, l=LATEST, lw=LAST))
def featured_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(last_season(spark, sf_dir), ["weapon"], ["position", "person"], 3).select("season", "position", "person", "weapon")


COPIES = "SELECT *, CASE fact % 3 WHEN 0 THEN 'fed' WHEN 1 THEN 'int' ELSE 'nac' END AS copy, row_number() OVER (PARTITION BY person % 500, day, weapon, category, fact % 3 ORDER BY fact) AS turn, person % 500 AS who FROM result"


@R.add(using("SELECT who, strftime(day, '%Y-%m-%d') AS on_day, weapon, category, turn, count(*) AS copies, string_agg(copy, ',' ORDER BY copy) AS sources, CASE WHEN min(place) = max(place) THEN min(place) END AS place, max(participants) AS participants FROM k JOIN (SELECT competition, greatest(max(place), count(*)) AS participants FROM result GROUP BY competition) USING (competition) GROUP BY who, day, weapon, category, turn", "result", k=COPIES))
def source_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One competition that several sources publish as one row: the nth copy of a source belongs to the nth competition of a day, weapon and category; contradictory places are none, the larger field counts."""
    df = ranking.with_field_sizes(results(spark, sf_dir)).withColumns({"who": F.col("person") % 500, "copy": F.element_at(F.array(*map(F.lit, ("fed", "int", "nac"))), (F.col("fact") % 3 + 1).cast("int"))})
    df = numbered(df, ["who", "day", "weapon", "category", "copy"], ["fact"], "turn")
    fused = df.groupBy("who", "day", "weapon", "category", "turn").agg(F.count("*").alias("copies"), F.array_join(F.sort_array(F.collect_list("copy")), ",").alias("sources"), F.min("place").alias("least"), F.max("place").alias("most"), F.max("participants").alias("participants"))
    return fused.select("who", iso(F.col("day")).alias("on_day"), "weapon", "category", "turn", "copies", "sources", F.when(F.col("least") == F.col("most"), F.col("least")).alias("place"), "participants")


@R.add(using("SELECT person FROM athlete WHERE country = 3 UNION SELECT person FROM result WHERE fact % 25 = 3 UNION SELECT person FROM publication WHERE ym % 100 = 12 AND person % 25 = 3", "athlete", "publication"))
def country_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a country by any proof: their own, that of a result, or that of a list entry."""
    own = athletes(spark, sf_dir).where("country = 3").select("person")
    by_result = results(spark, sf_dir).where("fact % 25 = 3").select("person")
    by_list = publications(spark, sf_dir).where("ym % 100 = 12 AND person % 25 = 3").select("person")
    return own.union(by_result).union(by_list).distinct()
