"""Queries over people, editions, calendars, registrations and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions.dates import anchored_before, iso, overlap
from rostrum.operators import acquaintances, deadlines, identity, joins
from rostrum.operators.numbering import numbered_in_order
from rostrum.operators.storage import spread
from rostrum.operators.windows import first_per, numbered, sessions
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.sources.adapter import athletes, bouts, editions, fencers, observations, results, table

R = Registry()


# Identity.

@R.add(using("SELECT id, root, hops FROM root", "root"))
def identity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.closure(fencers(spark, sf_dir))


@R.add(using("SELECT f.id, coalesce(f2.merged_into, f.merged_into, f.id) AS root FROM fencer f LEFT JOIN fencer f2 ON f2.id = f.merged_into", "fencer"))
def identity_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.closure(fencers(spark, sf_dir), hops=2).select("id", "root")


@R.add(using("SELECT id, coalesce(merged_into, id) AS root FROM fencer", "fencer"))
def identity_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.closure(fencers(spark, sf_dir), hops=1).select("id", "root")


@R.add(using("SELECT root, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM root GROUP BY root", "root"))
def identity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.members(fencers(spark, sf_dir)).select("root", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


IDS = "SELECT 'rfe' AS scheme, CAST(s_suppkey // 2 AS VARCHAR) AS value, 'nac' AS source, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '1997-1998' END AS season, DATE '1996-01-01' + CAST(s_suppkey % 100 * 10 AS INTEGER) AS valid_from, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1999-01-01' END AS valid_to, CASE WHEN s_suppkey % 5 = 0 THEN 'PROPUESTO' ELSE 'CONFIRMADO' END AS status, s_suppkey AS person FROM supplier"
# Sixty identifiers whatever the number of people: many people to each.
SHARED_IDS = IDS.replace("s_suppkey // 2", "s_suppkey % 60")
ASKED = "SELECT c_custkey AS query, 'rfe' AS scheme, CAST(c_custkey // 30 AS VARCHAR) AS value, 'nac' AS source, CASE WHEN c_custkey % 2 = 0 THEN '1997-1998' ELSE '1998-1999' END AS season, DATE '1996-01-01' + CAST(c_custkey AS INTEGER) AS day FROM customer"


def external_ids(spark: SparkSession, sf_dir: str, value: str = "s_suppkey div 2") -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.lit("rfe").alias("scheme"), F.expr(value).cast("string").alias("value"), F.lit("nac").alias("source"), F.when(s % 3 == 0, "").otherwise("1997-1998").alias("season"),
        F.date_add(F.lit("1996-01-01").cast("date"), (s % 100 * 10).cast("int")).alias("valid_from"), F.when(s % 4 == 0, F.lit("1999-01-01").cast("date")).alias("valid_to"),
        F.when(s % 5 == 0, "PROPUESTO").otherwise("CONFIRMADO").alias("status"), s.alias("person"))


@R.add(using("SELECT query, CASE WHEN sure > 1 THEN 'conflict' WHEN sure = 1 THEN 'confirmed' WHEN maybe > 0 THEN 'review' ELSE 'none' END AS state, CASE WHEN sure = 1 THEN who END AS person FROM (SELECT q.query, count(DISTINCT person) FILTER (WHERE status = 'CONFIRMADO') AS sure, min(person) FILTER (WHERE status = 'CONFIRMADO') AS who, count(DISTINCT person) FILTER (WHERE status = 'PROPUESTO') AS maybe FROM q LEFT JOIN i ON i.scheme = q.scheme AND i.value = q.value AND i.source = q.source AND (i.season = '' OR i.season = q.season) AND i.valid_from <= q.day AND (i.valid_to IS NULL OR q.day <= i.valid_to) GROUP BY q.query)", i=IDS, q=ASKED))
def scoped_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("query"), F.lit("rfe").alias("scheme"), F.expr("c_custkey div 30").cast("string").alias("value"), F.lit("nac").alias("source"), F.when(c % 2 == 0, "1997-1998").otherwise("1998-1999").alias("season"), F.date_add(F.lit("1996-01-01").cast("date"), c.cast("int")).alias("day"))
    return identity.resolve(asked, external_ids(spark, sf_dir))


@R.add(using("SELECT x.person AS one, y.person AS other, x.value FROM i x JOIN i y ON x.scheme = y.scheme AND x.value = y.value AND x.source = y.source AND x.person < y.person AND (x.season = '' OR y.season = '' OR x.season = y.season) AND x.valid_from <= coalesce(y.valid_to, DATE '9999-12-31') AND y.valid_from <= coalesce(x.valid_to, DATE '9999-12-31') JOIN root rx ON rx.id = x.person JOIN root ry ON ry.id = y.person WHERE rx.root <> ry.root", "root", i=SHARED_IDS))
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identifier on two people at one time: an equi-join on the identifier, then scope and validity."""
    roots = identity.closure(fencers(spark, sf_dir)).select(F.col("id").alias("person"), "root")
    ids = external_ids(spark, sf_dir, "s_suppkey % 60").join(roots, "person")
    x, y = spread(ids, "person").alias("x"), ids.alias("y")
    end = lambda a: F.coalesce(F.col(f"{a}.valid_to"), F.lit("9999-12-31").cast("date"))
    scope = (F.col("x.season") == "") | (F.col("y.season") == "") | (F.col("x.season") == F.col("y.season"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("scheme", "value", "source")]
    both = x.join(y, [*same, F.col("x.person") < F.col("y.person")]).where(scope & overlap(F.col("x.valid_from"), end("x"), F.col("y.valid_from"), end("y")) & (F.col("x.root") != F.col("y.root")))
    return both.select(F.col("x.person").alias("one"), F.col("y.person").alias("other"), F.col("x.value").alias("value"))


# Editions.

@R.add(using("SELECT a.edition AS one, b.edition AS other FROM edition a JOIN edition b ON a.city = b.city AND a.source = 'nac' AND b.source = 'int' AND abs(date_diff('day', a.start, b.start)) <= 1", "edition"))
def date_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir)
    one = e.where("source = 'nac'").select(F.col("edition").alias("one"), "city", F.col("start").alias("day_one"))
    other = e.where("source = 'int'").select(F.col("edition").alias("other"), "city", F.col("start").alias("day_other"))
    return joins.within_days(one, other, ["city"], "day_one", "day_other", 1).select("one", "other")


LINK = "SELECT b.edition AS secondary, a.edition AS main, abs(date_diff('day', a.start, b.start)) AS far, count(*) OVER (PARTITION BY b.edition) AS candidates, row_number() OVER (PARTITION BY b.edition ORDER BY abs(date_diff('day', a.start, b.start)), a.n DESC, a.edition) AS rn, count(*) OVER (PARTITION BY b.edition, abs(date_diff('day', a.start, b.start))) AS ties FROM edition a JOIN edition b ON a.city = b.city AND a.source = 'nac' AND b.source = 'int' AND a.start <= b.stop AND b.start <= a.stop"
LINKED = "SELECT secondary, main, CASE WHEN candidates = 1 OR ties = 1 THEN 'AUTOMATICO' ELSE 'DUDOSO' END AS status FROM k WHERE rn = 1"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir)
    main = e.where("source = 'nac'").select(F.col("edition").alias("main"), "city", F.col("start").alias("a0"), F.col("stop").alias("a1"), "n")
    second = e.where("source = 'int'").select(F.col("edition").alias("secondary"), "city", F.col("start").alias("b0"), F.col("stop").alias("b1"))
    far = F.abs(F.datediff("a0", "b0"))
    c = joins.overlapping(second, main, ["city"], ("b0", "b1"), ("a0", "a1"), 4).withColumn("far", far)
    c = c.withColumns({"candidates": F.count("*").over(Window.partitionBy("secondary")), "ties": F.count("*").over(Window.partitionBy("secondary", "far"))})
    c = numbered(c, ["secondary"], ["far", F.desc("n"), "main"]).where("rn = 1")
    return c.select("secondary", "main", F.when((F.col("candidates") == 1) | (F.col("ties") == 1), "AUTOMATICO").otherwise("DUDOSO").alias("status"))


@R.add(using("SELECT * FROM l", "edition", k=LINK, l=LINKED))
def event_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of a second source to those of the first: same city, meeting dates; the nearest start decides, ties are doubtful."""
    return links(spark, sf_dir)


@R.add(using("SELECT coalesce(o.secondary, l.secondary) AS secondary, CASE WHEN o.secondary IS NULL THEN 'write' WHEN l.secondary IS NULL THEN 'delete' WHEN o.main <> l.main OR o.status <> l.status THEN 'update' ELSE 'same' END AS action FROM o FULL JOIN l ON l.secondary = o.secondary", "edition", k=LINK, l=LINKED, o="SELECT secondary, CASE WHEN substr(secondary, 8, 1) = '5' THEN 'x' ELSE main END AS main, status FROM l WHERE substr(secondary, 8, 1) <> '3' UNION ALL SELECT 'gone-' || secondary, main, status FROM l WHERE substr(secondary, 8, 1) = '3'"))
def link_plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to write, update and delete, against stored links: a full outer join."""
    new = links(spark, sf_dir)
    digit = F.substring("secondary", 8, 1)
    kept = new.where(digit != "3").withColumn("main", F.when(digit == "5", "x").otherwise(F.col("main")))
    old = kept.unionByName(new.where(digit == "3").withColumn("secondary", F.concat(F.lit("gone-"), F.col("secondary"))))
    o, l = old.alias("o"), new.alias("l")
    action = F.when(F.col("o.secondary").isNull(), "write").when(F.col("l.secondary").isNull(), "delete").when((F.col("o.main") != F.col("l.main")) | (F.col("o.status") != F.col("l.status")), "update").otherwise("same")
    return o.join(l, F.col("o.secondary") == F.col("l.secondary"), "full_outer").select(F.coalesce("o.secondary", "l.secondary").alias("secondary"), action.alias("action"))


@R.add(using("SELECT edition, city, sum(fresh) OVER (PARTITION BY city ORDER BY start, stop, edition ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN date_diff('day', max(stop) OVER (PARTITION BY city ORDER BY start, stop, edition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) > 2 OR row_number() OVER (PARTITION BY city ORDER BY start, stop, edition) = 1 THEN 1 ELSE 0 END AS fresh FROM edition)", "edition"))
def edition_event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of a place chained into events while less than three days pass between them."""
    return sessions(editions(spark, sf_dir), ["city"], "start", "stop", 2, "cluster").select("edition", "city", "cluster")


@R.add(using("SELECT strftime(date_trunc('week', start), '%Y-%m-%d') AS week, city, count(*) AS editions, strftime(min(start), '%Y-%m-%d') AS first, strftime(max(stop), '%Y-%m-%d') AS last FROM edition GROUP BY date_trunc('week', start), city", "edition"))
def weekly_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions(spark, sf_dir).groupBy(F.date_trunc("week", "start").alias("w"), "city").agg(F.count("*").alias("editions"), iso(F.min("start")).alias("first"), iso(F.max("stop")).alias("last")).select(iso(F.col("w")).alias("week"), "city", "editions", "first", "last")


@R.add(using("SELECT city, strftime(week, '%Y-%m-%d') AS week, block, count(*) AS editions FROM (SELECT *, sum(fresh) OVER (PARTITION BY city, week ORDER BY start, stop, edition ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN coalesce(max(stop) OVER (PARTITION BY city, week ORDER BY start, stop, edition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '1900-01-01') < start THEN 1 ELSE 0 END AS fresh FROM (SELECT *, date_trunc('week', start) AS week FROM edition))) GROUP BY ALL", "edition"))
def weekend_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting editions of one week as blocks."""
    df = sessions(editions(spark, sf_dir).withColumn("w", F.date_trunc("week", "start")), ["city", "w"], "start", "stop", 0, "block")
    return df.groupBy("city", iso(F.col("w")).alias("week"), "block").agg(F.count("*").alias("editions"))


@R.add(using("SELECT city, strftime(w, '%Y-%m-%d') AS week FROM (SELECT city, unnest(generate_series(min(date_trunc('week', start)), max(date_trunc('week', start)), INTERVAL 7 DAY)) AS w FROM edition GROUP BY city) g WHERE NOT EXISTS (SELECT 1 FROM edition e WHERE e.city = g.city AND date_trunc('week', e.start) = g.w)", "edition"))
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of a city without an edition."""
    e = editions(spark, sf_dir).select("city", F.to_date(F.date_trunc("week", "start")).alias("w")).distinct()
    span = e.groupBy("city").agg(F.sequence(F.min("w"), F.max("w"), F.expr("interval 7 days")).alias("s")).select("city", F.explode("s").alias("w"))
    return span.join(e, ["city", "w"], "left_anti").select("city", iso(F.col("w")).alias("week"))


@R.add(using("SELECT e.edition, e.city, e.n FROM edition e WHERE e.city LIKE '%H%' AND EXISTS (SELECT 1 FROM result r WHERE r.day = e.start AND r.category = e.city AND r.weapon = 'SABLE') AND (e.start, e.edition) < (DATE '1999-01-01', '') ORDER BY e.start DESC, e.edition DESC LIMIT 31", "edition"))
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir).where(F.contains("city", F.lit("H")) & (F.struct("start", "edition") < F.struct(F.lit("1999-01-01").cast("date"), F.lit(""))))
    r = results(spark, sf_dir).where("weapon = 'SABLE'").select(F.col("day").alias("start"), F.col("category").alias("city")).distinct()
    return e.join(r, ["start", "city"], "left_semi").orderBy(F.desc("start"), F.desc("edition")).limit(31).select("edition", "city", "n")


@R.add(using("SELECT edition FROM edition WHERE source = 'nac' AND start <= DATE '1997-06-30' AND stop >= DATE '1997-01-01' AND city ILIKE '%low%' ORDER BY start, edition LIMIT 400", "edition"))
def calendar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda s: F.lit(s).cast("date")
    e = editions(spark, sf_dir).where((F.col("source") == "nac") & overlap(F.col("start"), F.col("stop"), d("1997-01-01"), d("1997-06-30")) & F.col("city").ilike("%low%"))
    return e.orderBy("start", "edition").limit(400).select("edition")


@R.add(using("SELECT e.edition, strftime(e.start, '%Y-%m-%d') AS start, string_agg(DISTINCT r.weapon || '/' || r.format, ',' ORDER BY r.weapon || '/' || r.format) AS competitions, count(DISTINCT r.person) AS people FROM edition e JOIN result r ON r.day = e.start AND r.category = e.city WHERE e.start BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' GROUP BY ALL", "edition"))
def calendar_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir).where(F.col("start").between(F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date")))
    r = results(spark, sf_dir).select(F.col("day").alias("start"), F.col("category").alias("city"), "person", F.concat_ws("/", "weapon", "format").alias("c"))
    out = e.join(r, ["start", "city"]).groupBy("edition", "start").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("competitions"), F.countDistinct("person").alias("people"))
    return out.withColumn("start", iso(F.col("start")))


PAST = "SELECT edition, season FROM (SELECT edition, season, 1 AS p FROM edition WHERE source = 'nac' UNION ALL SELECT strftime(day, '%Y%m%d') || '-' || substr(category, 1, 1), season, 2 FROM result WHERE source = 'int') GROUP BY ALL"


@R.add(using(PAST, "edition"))
def past_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions that are known by themselves or by a key made of their results."""
    own = editions(spark, sf_dir).where("source = 'nac'").select("edition", "season")
    made = results(spark, sf_dir).where("source = 'int'").select(F.concat_ws("-", F.date_format("day", "yyyyMMdd"), F.substring("category", 1, 1)).alias("edition"), "season")
    return own.unionByName(made).distinct()


@R.add(using("SELECT r.fact, e.edition, e.source AS edition_source, coalesce(CASE WHEN r.source = 'int' THEN 'INTERNACIONAL' END, 'NACIONAL') AS scope FROM result r JOIN edition e ON e.start = r.day AND e.city = r.category", "edition"))
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir).select("edition", F.col("source").alias("edition_source"), F.col("start").alias("day"), F.col("city").alias("category"))
    return results(spark, sf_dir).join(e, ["day", "category"]).select("fact", "edition", "edition_source", F.coalesce(F.when(F.col("source") == "int", "INTERNACIONAL"), F.lit("NACIONAL")).alias("scope"))


@R.add(using("SELECT person, name FROM athlete a WHERE EXISTS (SELECT 1 FROM result r WHERE r.person = a.person AND r.place = 1) OR EXISTS (SELECT 1 FROM observation o WHERE o.person = a.person AND o.value > 90)", "athlete", "result", "observation"))
def disjunctive_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either of two facts: the union of their keys, then one semi-join."""
    keys = results(spark, sf_dir).where("place = 1").select("person").union(observations(spark, sf_dir).where("value > 90").select("person")).distinct()
    return athletes(spark, sf_dir).join(keys, "person", "left_semi").select("person", "name")


@R.add(using("SELECT a.person, coalesce((SELECT arg_max(competition, (day, competition)) FROM result r WHERE r.person = a.person AND r.source = 'int'), (SELECT arg_max(competition, (day, competition)) FROM result r WHERE r.person = a.person)) AS last FROM athlete a", "athlete", "result"))
def ordered_scalar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest international competition, else the latest of all: one aggregate instead of two lookups a row."""
    key = F.struct("day", "competition")
    last = results(spark, sf_dir).groupBy("person").agg(F.max_by(F.when(F.col("source") == "int", F.col("competition")), F.when(F.col("source") == "int", key)).alias("i"), F.max_by("competition", key).alias("c"))
    return athletes(spark, sf_dir).join(last, "person", "left").select("person", F.coalesce("i", "c").alias("last"))


@R.add(using("SELECT fact, competition FROM result WHERE season = '1997-1998' AND weapon IN ('SABLE', 'ESPADA') AND category LIKE '%IGH%' AND place BETWEEN 1 AND 10 AND source <> 'x'", "result"))
def filter_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.operators.filters import all_of, is_in

    c = [F.col("season") == "1997-1998", is_in(F.col("weapon"), ["SABLE", "ESPADA"]), F.col("category").like("%IGH%"), F.col("place").between(1, 10), ~is_in(F.col("source"), [])]
    return results(spark, sf_dir).where(all_of(c)).select("fact", "competition")


@R.add(using("SELECT person, CASE WHEN country % 4 = 0 THEN NULL ELSE 1960 + CAST(person % 50 AS INTEGER) END AS birth_year FROM athlete", "athlete"))
def masked_birth_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return athletes(spark, sf_dir).select("person", F.when(F.col("country") % 4 != 0, 1960 + (F.col("person") % 50).cast("int")).alias("birth_year"))


# Registrations.

@R.add(using("SELECT person, k, arg_min(source, (CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END, source)) AS main, count(*) AS n, count(DISTINCT source) AS sources, bool_and(value < 10) AS withdrawn FROM observation GROUP BY person, k", "observation"))
def registration_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one person and competition as one registration: the best source names it, all must have withdrawn."""
    order = F.coalesce(F.try_element_at(F.create_map(F.lit("purchase"), F.lit(1), F.lit("click"), F.lit(2), F.lit("view"), F.lit(3)), F.col("source")), F.lit(9))
    return observations(spark, sf_dir).groupBy("person", "k").agg(F.min_by("source", F.struct(order.alias("o"), "source")).alias("main"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.bool_and(F.col("value") < 10).alias("withdrawn"))


@R.add(using("SELECT person, k, strftime(min(day), '%Y-%m-%d') AS first_seen, strftime(max(day), '%Y-%m-%d') AS last_seen, count(DISTINCT day) AS days, max(day) < DATE '2024-01-20' AS withdrawn FROM observation GROUP BY person, k", "observation"))
def registration_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("person", "k").agg(iso(F.min("day")).alias("first_seen"), iso(F.max("day")).alias("last_seen"), F.countDistinct("day").alias("days"), (F.max("day") < F.lit("2024-01-20").cast("date")).alias("withdrawn"))


@R.add(using("SELECT o.person, count(DISTINCT o.k) AS registrations, min(l.position) AS rank, CASE WHEN count(DISTINCT a.zone) = 1 THEN min(a.zone) END AS zone FROM observation o LEFT JOIN l ON l.person = o.person LEFT JOIN athlete a ON a.person = o.person GROUP BY o.person", "observation", "publication", "athlete", p="SELECT *, rank() OVER (PARTITION BY season, weapon, ym ORDER BY points DESC) AS position FROM publication", l="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, weapon, person ORDER BY ym DESC) AS rn FROM p) WHERE rn = 1"))
def registration_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.plans.results import latest

    ranks = latest(spark, sf_dir).groupBy("person").agg(F.min("position").alias("rank"))
    seen = observations(spark, sf_dir).groupBy("person").agg(F.countDistinct("k").alias("registrations"))
    return seen.join(ranks, "person", "left").join(athletes(spark, sf_dir).select("person", "zone"), "person", "left").select("person", "registrations", "rank", "zone")


@R.add(using("SELECT k, count(DISTINCT person) FILTER (WHERE source = 'purchase') AS accepted, count(DISTINCT person) FILTER (WHERE source = 'view') AS pending, count(DISTINCT person) AS total FROM observation GROUP BY k", "observation"))
def callup_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("person")))
    return observations(spark, sf_dir).groupBy("k").agg(who("purchase").alias("accepted"), who("view").alias("pending"), F.countDistinct("person").alias("total"))


# Feeds and recommendations.

FOLLOWED = "SELECT DISTINCT person FROM observation WHERE source = 'purchase' AND value > 50"


@R.add(using("SELECT person, competition, strftime(day, '%Y-%m-%d') AS day, fact FROM (SELECT r.*, row_number() OVER (PARTITION BY r.person, r.competition ORDER BY day DESC, fact DESC) AS rn FROM result r JOIN f USING (person)) WHERE rn = 1 ORDER BY result_day DESC, fact DESC LIMIT 51".replace("result_day", "day"), "result", "observation", f=FOLLOWED))
def following_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest facts of followed people, one per person and competition."""
    followed = observations(spark, sf_dir).where("source = 'purchase' AND value > 50").select("person").distinct()
    df = first_per(results(spark, sf_dir).join(followed, "person", "left_semi"), ["person", "competition"], [F.desc("day"), F.desc("fact")])
    return df.orderBy(F.desc("day"), F.desc("fact")).limit(51).select("person", "competition", iso(F.col("day")).alias("day"), "fact")


@R.add(using("SELECT person, strftime(day, '%Y-%m-%d') AS day FROM (SELECT person, day FROM observation ORDER BY ts DESC, id DESC LIMIT 100)", "observation"))
def threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(100).select("person", iso(F.col("day")).alias("day"))


@R.add(using("SELECT season, least(count(*), 1000) AS shown, count(*) > 1000 AS truncated FROM result GROUP BY season", "result"))
def truncation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("season").agg(F.least(F.count("*"), F.lit(1000)).cast("long").alias("shown"), (F.count("*") > 1000).alias("truncated"))


@R.add(using("SELECT me, other, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY score DESC, other) AS rn FROM (SELECT c.me, c.other, coalesce(b.bouts, 0) * 5 + c.shared + CASE WHEN fm.country = fo.country THEN 10 ELSE 0 END AS score FROM c LEFT JOIN b ON b.me = c.me AND b.rival = c.other JOIN fencer fm ON fm.id = c.me JOIN fencer fo ON fo.id = c.other)) WHERE rn <= 5",
    "oriented", "fencer", p="SELECT DISTINCT competition, me FROM oriented", c="SELECT x.me, y.me AS other, count(*) AS shared FROM p x JOIN p y ON x.competition = y.competition AND x.me <> y.me GROUP BY 1, 2", b="SELECT me, rival, count(*) AS bouts FROM oriented GROUP BY 1, 2"))
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with common competitions, direct bouts and country: a common competition counts one, a bout five, a country ten.

    Competitions have a bounded number of people; each sends its list to each of them, and no pair is shuffled.
    """
    return acquaintances.closest(acquaintances.lists(bouts(spark, sf_dir), fencers(spark, sf_dir), "competition"), 5, 5, 10)


@R.add(using("SELECT root, strftime(min(day), '%Y-%m-%d') AS since, count(*) AS rows FROM (SELECT r.root, DATE '2024-01-01' + CAST(id % 40 AS INTEGER) AS day FROM root r) GROUP BY root", "root"))
def follow_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows of merged people on their root, the earliest date kept."""
    df = identity.closure(fencers(spark, sf_dir)).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")))
    return df.groupBy("root").agg(iso(F.min("day")).alias("since"), F.count("*").alias("rows"))


# Deadlines and eligibility.

@R.add(using("SELECT edition, strftime(d.ordinary, '%Y-%m-%d') AS ordinary, CASE WHEN d.final < DATE '1998-06-01' THEN 'closed' WHEN d.ordinary < DATE '1998-06-01' THEN 'red' WHEN d.ordinary <= DATE '1998-06-08' THEN 'amber' ELSE 'green' END AS status FROM (SELECT edition, date_trunc('week', start) - INTERVAL 14 DAY + INTERVAL 3 DAY AS ordinary, start - INTERVAL 7 DAY AS final FROM edition) d", "edition"))
def deadline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Thursday two weeks before, the final call a week before, and the light they give on a day."""
    now = F.lit("1998-06-01").cast("date")
    d = editions(spark, sf_dir).select("edition", anchored_before(F.col("start"), 2, 3).alias("o"), F.date_sub("start", 7).alias("final"))
    status = F.when(F.col("final") < now, "closed").when(F.col("o") < now, "red").when(F.col("o") <= F.date_add(now, 7), "amber").otherwise("green")
    return d.select("edition", iso(F.col("o")).alias("ordinary"), status.alias("status"))


COMPUTED = "SELECT edition, 'ordinary' AS type, start - INTERVAL 10 DAY AS at, 5 AS surcharge, false AS blocking FROM edition UNION ALL SELECT edition, 'final', start - INTERVAL 7 DAY, NULL, true FROM edition"
PUBLISHED = "SELECT edition, 'ordinary' AS type, start - INTERVAL 9 DAY AS at, CASE WHEN n % 4 = 0 THEN 8 END AS surcharge, n % 5 = 0 AS blocking FROM edition WHERE n % 2 = 0 UNION ALL SELECT edition, 'late', start - INTERVAL 1 DAY, NULL, false FROM edition WHERE n % 3 = 0"


@R.add(using("SELECT edition, type, strftime(coalesce(p.at, c.at), '%Y-%m-%d') AS at, coalesce(p.surcharge, c.surcharge) AS surcharge, coalesce(p.blocking, false) OR coalesce(c.blocking, false) AS blocking, CASE WHEN p.at IS NULL THEN 'computed' WHEN p.surcharge IS NULL AND c.surcharge IS NOT NULL THEN 'published + computed' ELSE 'published' END AS origin FROM p FULL JOIN c USING (edition, type)", "edition", c=COMPUTED, p=PUBLISHED))
def deadline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published deadlines over computed ones, by type: a surcharge that is not published stays the computed one, and either can block."""
    e = editions(spark, sf_dir)

    def deadlines(df: DataFrame, type_: str, days: int, surcharge, blocking) -> DataFrame:
        return df.select("edition", F.lit(type_).alias("type"), F.date_sub("start", days).alias("at"), surcharge.cast("int").alias("surcharge"), blocking.alias("blocking"))

    none, no = F.lit(None), F.lit(False)
    computed = deadlines(e, "ordinary", 10, F.lit(5), no).union(deadlines(e, "final", 7, none, F.lit(True)))
    published = deadlines(e.where("n % 2 = 0"), "ordinary", 9, F.when(F.col("n") % 4 == 0, 8), F.col("n") % 5 == 0).union(deadlines(e.where("n % 3 = 0"), "late", 1, none, no))
    p, c = (df.select("edition", "type", *[F.col(k).alias(f"{side}_{k}") for k in ("at", "surcharge", "blocking")]) for side, df in (("p", published), ("c", computed)))
    df = p.join(c, ["edition", "type"], "full_outer")
    origin = F.when(F.col("p_at").isNull(), "computed").when(F.col("p_surcharge").isNull() & F.col("c_surcharge").isNotNull(), "published + computed").otherwise("published")
    return df.select("edition", "type", iso(F.coalesce("p_at", "c_at")).alias("at"), F.coalesce("p_surcharge", "c_surcharge").alias("surcharge"), (F.coalesce("p_blocking", no) | F.coalesce("c_blocking", no)).alias("blocking"), origin.alias("origin"))


@R.add(using("SELECT o.person, o.k, strftime(e.start, '%Y-%m-%d') AS next_start FROM (SELECT DISTINCT person, k FROM observation) o JOIN (SELECT *, row_number() OVER (ORDER BY start, edition) AS k FROM edition) e ON e.k = o.k", "observation", "edition"))
def deadline_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_in_order(editions(spark, sf_dir), ["start", "edition"], "k").select("k", "start")
    return observations(spark, sf_dir).select("person", "k").distinct().join(e, "k").select("person", "k", iso(F.col("start")).alias("next_start"))


LADDER = [("M17", 1981, 1999), ("M20", 1978, 1980), ("M23", 1975, 1977), ("ABS", 1900, 1974)]
LADDER_SQL = "(VALUES " + ", ".join(f"('{c}', {lo}, {hi}, {i})" for i, (c, lo, hi) in enumerate(LADDER)) + ") AS t(category, lo, hi, step)"


@R.add(using(f"SELECT person, birth_year, own.category AS own, string_agg(up.category, ',' ORDER BY up.step) AS allowed FROM (SELECT person, 1960 + person % 40 AS birth_year FROM athlete) p JOIN {LADDER_SQL.replace('AS t(', 'AS own(')} ON birth_year BETWEEN own.lo AND own.hi JOIN {LADDER_SQL.replace('AS t(', 'AS up(')} ON up.step >= own.step GROUP BY ALL", "athlete"))
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of a birth year and all those above it: a range join to a handful of rows."""
    ladder = spark.createDataFrame([(c, lo, hi, i) for i, (c, lo, hi) in enumerate(LADDER)], "category string, lo int, hi int, step int")
    own, up = F.broadcast(ladder).alias("own"), F.broadcast(ladder).alias("up")
    p = athletes(spark, sf_dir).select("person", (1960 + F.col("person") % 40).alias("birth_year"))
    df = p.join(own, F.col("birth_year").between(F.col("own.lo"), F.col("own.hi"))).join(up, F.col("up.step") >= F.col("own.step"))
    out = df.groupBy("person", "birth_year", F.col("own.category").alias("own")).agg(F.sort_array(F.collect_list(F.struct("up.step", "up.category"))).alias("a"))
    return out.select("person", "birth_year", "own", F.array_join(F.transform("a", lambda x: x["category"]), ",").alias("allowed"))


# Reminders of deadlines.

RULES = (
    (None, None, "ordinary", 10, None, None, "23:59:59", 5, False), ("HIGH", None, "ordinary", None, 2, 3, "12:00:00", 10, False), ("HIGH", "int", "ordinary", 12, None, None, "18:00:00", 20, False),
    (None, "int", "final", 7, None, None, "20:00:00", None, True),
)
RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES) + ") AS rule(category, source, type, days, weeks, weekday, clock, surcharge, blocking)"
STATUSES = ("draft", "submitted", "pending_club", "withdrawn", "club_approved")
NOW = "1998-06-01 10:00:00"
# Only deadlines of the three days after it can be in the result, all in summer time, two hours ahead.
COMPUTED_AT = "CAST(CASE WHEN weeks IS NOT NULL THEN date_trunc('week', start) - to_days(CAST(weeks * 7 - weekday AS INTEGER)) ELSE start - to_days(CAST(days AS INTEGER)) END AS DATE) + CAST(clock AS TIME) - INTERVAL 2 HOUR"
BY_RULE = f"""SELECT edition AS event, type, {COMPUTED_AT} AS due, surcharge, blocking FROM edition e JOIN {RULES_SQL} ON (rule.category IS NULL OR rule.category = e.city) AND (rule.source IS NULL OR rule.source = e.source)
    QUALIFY row_number() OVER (PARTITION BY edition, type ORDER BY (rule.category IS NOT NULL)::INT + (rule.source IS NOT NULL)::INT DESC) = 1"""
SAID = "SELECT edition AS event, 'ordinary' AS type, start - INTERVAL 9 DAY + INTERVAL 21 HOUR AS due, n % 5 = 0 AS blocking FROM edition WHERE n % 2 = 0 UNION ALL SELECT edition, 'late', start - INTERVAL 1 DAY + INTERVAL 21 HOUR, n % 3 = 0 FROM edition"
BOTH = "SELECT event, type, coalesce(p.due, c.due) AS due, coalesce(p.blocking, false) OR coalesce(c.blocking, false) AS blocking FROM p FULL JOIN c USING (event, type)"
NEXT = f"""SELECT event, type, due, CAST(ceil(date_diff('microsecond', TIMESTAMP '{NOW}', due) / 86400000000) AS BIGINT) AS days FROM b WHERE due > TIMESTAMP '{NOW}' AND (type = 'ordinary' OR blocking)
    QUALIFY row_number() OVER (PARTITION BY event ORDER BY due, NOT blocking, type) = 1"""
ENTERED = f"""SELECT fact AS entry, strftime(day, '%Y%m%d') || '-' || substr(category, 1, 1) AS event, {list(STATUSES)}[fact % 5 + 1] AS status, 'p' || person || '@example.org' AS owner,
    CASE WHEN person % 7 = 0 THEN 'p' || person || '@example.org' WHEN person % 3 = 0 THEN 'g' || person || '@example.org' END AS guardian FROM result"""


@R.add(using("""SELECT key, entry, event, mail, type, strftime(due, '%Y-%m-%d %H:%M:%S') AS at, days FROM (SELECT 'deadline:' || entry || ':' || type || ':' || strftime(due, '%Y-%m-%d') || ':' || mail AS key, * FROM (
    SELECT DISTINCT entry, event, unnest([owner, guardian]) AS mail FROM e WHERE status NOT IN ('submitted', 'withdrawn')) JOIN x USING (event) WHERE days <= 3 AND mail IS NOT NULL) WHERE entry % 13 <> 0""",
    "result", "edition", c=BY_RULE, p=SAID, b=BOTH, x=NEXT, e=ENTERED))
def entry_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails about open entries whose next ordinary or blocking deadline is at most three days off, in local time, but those sent already."""
    e = editions(spark, sf_dir).withColumnsRenamed({"edition": "event", "city": "category"}).withColumn("zone", F.lit("Europe/Madrid"))
    rules = spark.createDataFrame(list(RULES), "category string, source string, type string, days int, weeks int, weekday int, clock string, surcharge int, blocking boolean")
    evening = lambda days: (F.date_sub("start", days).cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("at")
    none = F.lit(None).cast("int").alias("surcharge")
    said = e.where("n % 2 = 0").select("event", F.lit("ordinary").alias("type"), evening(9), none, (F.col("n") % 5 == 0).alias("blocking"))
    said = said.union(e.select("event", F.lit("late"), evening(1), none, F.col("n") % 3 == 0))
    merged = deadlines.merged(said, deadlines.by_rules(e, rules, ["category", "source"]))
    r, person = results(spark, sf_dir), F.col("person")
    mail = lambda letter: F.concat(F.lit(letter), person, F.lit("@example.org"))
    entries = r.select(
        F.col("fact").alias("entry"), F.concat_ws("-", F.date_format("day", "yyyyMMdd"), F.substring("category", 1, 1)).alias("event"), F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("fact") % 5 + 1).cast("int")).alias("status"),
        mail("p").alias("owner"), F.when(person % 7 == 0, mail("p")).when(person % 3 == 0, mail("g")).alias("guardian"),
    )
    now = F.lit(f"{NOW}+00:00").cast("timestamp")
    all_ = deadlines.reminders(entries, merged, spark.createDataFrame([], "key string"), now)
    # What a run before has sent: every thirteenth entry's.
    due = deadlines.reminders(entries, merged, all_.where("entry % 13 = 0").select("key"), now)
    return due.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
