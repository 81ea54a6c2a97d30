"""Queries over documents, entries, sources, loads, notifications, upkeep and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions.dates import iso
from rostrum.functions.text import deletions, words
from rostrum.operators import upkeep
from rostrum.operators.numbering import numbered_in_order
from rostrum.operators.storage import written
from rostrum.operators.windows import numbered
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.plans.texts import form_sql
from rostrum.sources.adapter import athletes, bouts, editions, fencers, observations, results, table

R = Registry()


# Documents.

@R.add("SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents")
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by hash: groups of one are settled before anything is joined back."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    g = df.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return df.join(g, "hash").select("doc_id", "hash", "copies", "first")


VALID = "SELECT doc_id, lang || '/' || source AS family, CASE WHEN d > 1 THEN 'duplicate' WHEN contains(text, 'License') AND n > 1 THEN 'cancelled' WHEN n = 1 THEN 'in force' ELSE 'superseded' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS d, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS n FROM documents)"


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("hash"), F.contains("text", F.lit("License")).alias("marked"))
    # First copies and newest of a family are extremes of groups, added up before they are shuffled, however large a family is.
    first, newest = df.groupBy("hash").agg(F.min("doc_id").alias("first")), df.groupBy("lang", "source").agg(F.max("doc_id").alias("newest"))
    df = df.join(first, "hash").join(newest, ["lang", "source"])
    state = F.when(F.col("doc_id") > F.col("first"), "duplicate").when(F.col("marked") & (F.col("doc_id") < F.col("newest")), "cancelled").when(F.col("doc_id") == F.col("newest"), "in force").otherwise("superseded")
    return df.select("doc_id", F.concat_ws("/", "lang", "source").alias("family"), state.alias("state"))


@R.add(VALID)
def document_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of a family is in force; copies, cancelled and older ones are not."""
    return validity(spark, sf_dir)


@R.add(f"SELECT count(DISTINCT family) AS families, count(*) FILTER (WHERE state = 'in force') AS in_force, count(*) FILTER (WHERE state = 'superseded') AS superseded, count(*) FILTER (WHERE state = 'cancelled') AS cancelled, count(*) FILTER (WHERE state = 'duplicate') AS duplicate FROM ({VALID})")
def validity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return validity(spark, sf_dir).agg(F.countDistinct("family").alias("families"), n("in force").alias("in_force"), n("superseded").alias("superseded"), n("cancelled").alias("cancelled"), n("duplicate").alias("duplicate"))


@R.add("SELECT page_id, CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS number, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(length(html) AS BIGINT) AS size FROM pages")
def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("url", "([0-9]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(n != "", n.try_cast("long")).alias("number"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.char_length("html").cast("long").alias("size"))


# Entries.

MOVES = {("view", "click"): "open", ("click", "purchase"): "confirm", ("view", "purchase"): "confirm", ("purchase", "refund"): "cancel", ("click", "view"): "back"}
MOVE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{r}')" for (a, b), r in MOVES.items()) + ") AS m(before, after, reason)"


@R.add(using(f"SELECT s.before, s.after, coalesce(m.reason, 'not allowed') AS reason, count(*) AS n FROM (SELECT lag(source) OVER (PARTITION BY person ORDER BY ts, id) AS before, source AS after FROM observation) s LEFT JOIN {MOVE_SQL} ON m.before = s.before AND m.after = s.after WHERE s.before IS NOT NULL GROUP BY ALL", "observation"))
def entry_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = F.broadcast(spark.createDataFrame([(a, b, r) for (a, b), r in MOVES.items()], "before string, after string, reason string"))
    steps = observations(spark, sf_dir).select(F.lag("source").over(Window.partitionBy("person").orderBy("ts", "id")).alias("before"), F.col("source").alias("after")).where("before IS NOT NULL")
    return steps.groupBy("before", "after").agg(F.count("*").alias("n")).join(moves, ["before", "after"], "left").select("before", "after", F.coalesce("reason", F.lit("not allowed")).alias("reason"), "n")


# Loads.

LOAD = """SELECT competition, CASE WHEN new = 0 THEN 'empty' WHEN old = 0 THEN 'new' WHEN old = new THEN 'keep' WHEN new > old THEN 'replace' ELSE 'merge' END AS mode, old, new FROM
    (SELECT competition, count(*) FILTER (WHERE person % 5 <> 0) AS old, count(*) FILTER (WHERE person % 4 <> 0) AS new FROM result GROUP BY competition)"""


@R.add(using(LOAD, "result"))
def load_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a new reading of a competition is loaded, by what is stored and what it brings."""
    df = results(spark, sf_dir).groupBy("competition").agg(F.count_if(F.col("person") % 5 != 0).alias("old"), F.count_if(F.col("person") % 4 != 0).alias("new"))
    o, n = F.col("old"), F.col("new")
    return df.select("competition", F.when(n == 0, "empty").when(o == 0, "new").when(o == n, "keep").when(n > o, "replace").otherwise("merge").alias("mode"), "old", "new")


@R.add(using("SELECT competition, CASE WHEN reasons = '' THEN 'accept' WHEN contains(reasons, 'few') THEN 'reject' ELSE 'review' END AS decision, reasons FROM (SELECT competition, concat_ws(',', CASE WHEN n < 3 THEN 'few' END, CASE WHEN people < n THEN 'repeated' END, CASE WHEN weapons > 1 THEN 'mixed' END, CASE WHEN teams > 0 THEN 'teams' END) AS reasons FROM (SELECT competition, count(*) AS n, count(DISTINCT person) AS people, count(DISTINCT weapon) AS weapons, count(*) FILTER (WHERE format = 'EQUIPOS') AS teams FROM result GROUP BY competition))", "result"))
def reconcile_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept, review or reject a source's competition, with the reasons."""
    df = results(spark, sf_dir).groupBy("competition").agg(F.count("*").alias("n"), F.countDistinct("person").alias("people"), F.countDistinct("weapon").alias("weapons"), F.count_if(F.col("format") == "EQUIPOS").alias("teams"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 3, F.lit("few")), F.when(F.col("people") < F.col("n"), F.lit("repeated")), F.when(F.col("weapons") > 1, F.lit("mixed")), F.when(F.col("teams") > 0, F.lit("teams"))))
    df = df.withColumn("r", reasons)
    return df.select("competition", F.when(F.size("r") == 0, "accept").when(F.array_contains("r", "few"), "reject").otherwise("review").alias("decision"), F.array_join("r", ",").alias("reasons"))


OLD = "SELECT fact, person, CASE WHEN fact % 7 = 0 THEN points + 1 ELSE points END AS points, place FROM result WHERE fact % 3 <> 0 UNION ALL SELECT -fact, person, points, place FROM result WHERE fact % 50 = 0"
NEW = "SELECT fact, person, CASE WHEN fact % 11 = 0 THEN NULL ELSE points END AS points, place FROM result WHERE fact % 4 <> 0"


def old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = results(spark, sf_dir).select("fact", "person", "points", "place")
    f = F.col("fact")
    old = r.where(f % 3 != 0).withColumn("points", F.when(f % 7 == 0, F.col("points") + 1).otherwise(F.col("points")))
    old = old.unionByName(r.where(f % 50 == 0).withColumn("fact", -f))
    return old, r.where(f % 4 != 0).withColumn("points", F.when(f % 11 != 0, F.col("points")))


@R.add(using("SELECT coalesce(o.fact, n.fact) AS fact, coalesce(n.person, o.person) AS person, coalesce(n.points, o.points) AS points, coalesce(n.place, o.place) AS place FROM o FULL JOIN n ON n.fact = o.fact", "result", o=OLD, n=NEW))
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return upkeep.merge(old, new, ["fact"])


@R.add(using("SELECT coalesce(o.fact, n.fact) AS fact, coalesce(o.person, n.person) AS person, CASE WHEN o.place = 1 OR n.fact IS NULL THEN o.points ELSE coalesce(n.points, o.points) END AS points, CASE WHEN o.place = 1 OR n.fact IS NULL THEN o.place ELSE coalesce(n.place, o.place) END AS place FROM o FULL JOIN n ON n.fact = o.fact", "result", o=OLD, n=NEW))
def sticky_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person that is stored stays; rows with place 1 are locked."""
    old, new = old_new(spark, sf_dir)
    return upkeep.merge(old, new, ["fact"], sticky=["person"], locked=F.col("s.place") == 1)


@R.add(using("SELECT fact FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.fact = n.fact)", "result", o=OLD, n=NEW))
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return upkeep.insert_or_ignore(old, new, ["fact"]).select("fact")


@R.add(using("SELECT o.fact, o.place FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.fact = o.fact)", "result", o=OLD, n=NEW))
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return upkeep.missing(old, new, ["fact"]).select("fact", "place")


@R.add(using("SELECT n.fact, CASE WHEN o.fact IS NULL THEN 'created' WHEN n.points IS NOT DISTINCT FROM o.points AND n.place IS NOT DISTINCT FROM o.place THEN 'equal' ELSE 'updated' END AS decision FROM n LEFT JOIN o ON o.fact = n.fact", "result", o=OLD, n=NEW))
def write_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return upkeep.decisions(old, new, ["fact"], ["points", "place"])


@R.add(using("SELECT season, weapon, missing, total, missing > 10 AND missing > 0.25 * total AS refused FROM (SELECT season, weapon, count(*) FILTER (WHERE fact % 4 = 0 OR (weapon = 'SABLE' AND fact % 3 = 0)) AS missing, count(*) AS total FROM result GROUP BY season, weapon)", "result"))
def guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent rows are deleted unless they are many and a large share of their group."""
    r = results(spark, sf_dir)
    seen = r.where(~((F.col("fact") % 4 == 0) | ((F.col("weapon") == "SABLE") & (F.col("fact") % 3 == 0))))
    gone = upkeep.missing(r, seen, ["fact"]).groupBy("season", "weapon").agg(F.count("*").alias("missing"))
    df = r.groupBy("season", "weapon").agg(F.count("*").alias("total")).join(gone, ["season", "weapon"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
    return df.withColumn("refused", (F.col("missing") > 10) & (F.col("missing") > 0.25 * F.col("total")))


@R.add("""SELECT o_orderkey, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS mark FROM orders""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", upkeep.fingerprint("o_orderstatus", "o_orderpriority", "o_custkey").alias("mark"))


@R.add("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 20000 THEN 'price' END, CASE WHEN NOT o_custkey % 7 <> 0 THEN 'person' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders WHERE NOT (o_totalprice > 20000 AND o_custkey % 7 <> 0 AND o_orderstatus <> 'P')")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"price": F.col("o_totalprice") > 20000, "person": F.col("o_custkey") % 7 != 0, "status": F.col("o_orderstatus") != "P"}
    _, bad = upkeep.validated(table(spark, sf_dir, "orders"), checks)
    return bad.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


# Linking of rows and people.

LISTED = "SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS external, lower(substr(c_name, 1, 8)) || CAST(c_custkey % 400 AS VARCHAR) AS name, c_nationkey AS country FROM customer"
KNOWN = "SELECT c_custkey AS person, lower(substr(c_name, 1, 8)) || CAST(c_custkey % 500 AS VARCHAR) AS name, c_nationkey AS country FROM customer WHERE c_custkey % 2 = 0"


LINKED = "SELECT l.row, CASE WHEN e.person IS NOT NULL THEN e.person WHEN n.candidates = 1 THEN n.person END AS person, CASE WHEN e.person IS NOT NULL THEN 'id' WHEN n.candidates = 1 THEN 'name' WHEN n.candidates > 1 THEN 'several' ELSE 'none' END AS reason FROM l LEFT JOIN k e ON e.person = l.external LEFT JOIN (SELECT name, country, count(*) AS candidates, min(person) AS person FROM k GROUP BY name, country) n ON n.name = l.name AND n.country = l.country"


@R.add(using(LINKED, l=LISTED, k=KNOWN))
def list_row_person_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List rows to people: by external id, else by a name and country that only one has; the reason is told."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = lambda m: F.concat(F.lower(F.substring("c_name", 1, 8)), (key % m).cast("string"))
    listed = c.select(key.alias("row"), F.when(key % 3 == 0, key).alias("external"), name(400).alias("name"), F.col("c_nationkey").alias("country"))
    known = c.where(key % 2 == 0).select(key.alias("person"), name(500).alias("name"), F.col("c_nationkey").alias("country"))
    by_name = known.groupBy("name", "country").agg(F.count("*").alias("candidates"), F.min("person").alias("by_name"))
    df = listed.join(known.select(F.col("person").alias("external"), F.lit(True).alias("there")), "external", "left").join(by_name, ["name", "country"], "left")
    reason = F.when(F.col("there"), "id").when(F.col("candidates") == 1, "name").when(F.col("candidates") > 1, "several").otherwise("none")
    return df.select("row", F.when(F.col("there"), F.col("external")).when(F.col("candidates") == 1, F.col("by_name")).alias("person"), reason.alias("reason"))


@R.add(using("SELECT row, list, CASE WHEN links = 1 OR (reason = 'id' AND by_id = 1) THEN person END AS person, CASE WHEN person IS NULL OR links = 1 OR (reason = 'id' AND by_id = 1) THEN reason ELSE 'repeated' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY list, person) AS links, count(*) FILTER (WHERE reason = 'id') OVER (PARTITION BY list, person) AS by_id FROM (SELECT *, row % 3 AS list FROM w))", l=LISTED, k=KNOWN, w=LINKED))
def one_person_per_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person that several rows of a list link to keeps the only link by id, if there is just one; the other rows lose theirs."""
    df = list_row_person_link(spark, sf_dir).withColumn("list", F.col("row") % 3)
    links = df.where("person IS NOT NULL").groupBy("list", "person").agg(F.count("*").alias("links"), F.count_if(F.col("reason") == "id").alias("by_id"))
    df = df.join(links, ["list", "person"], "left")
    keep = (F.col("links") == 1) | ((F.col("reason") == "id") & (F.col("by_id") == 1))
    return df.select("row", "list", F.when(keep, F.col("person")).alias("person"), F.when(F.col("person").isNull() | keep, F.col("reason")).otherwise("repeated").alias("reason"))


@R.add(using("SELECT f.id AS fencer, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(a.person) END AS person FROM fencer f JOIN athlete a ON a.country = f.country AND a.person % 40 = f.id % 40 GROUP BY f.id", "fencer", "athlete"))
def census_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many people a census entry may be, and who it is where there is one: blocks of country and birth year are counted before they are joined, so that no pairs are made."""
    f = fencers(spark, sf_dir).select(F.col("id").alias("fencer"), "country", (F.col("id") % 40).alias("year"))
    block = athletes(spark, sf_dir).groupBy("country", (F.col("person") % 40).alias("year")).agg(F.count("*").alias("candidates"), F.min("person").alias("person"))
    return f.join(block, ["country", "year"]).select("fencer", "candidates", F.when(F.col("candidates") == 1, F.col("person")).alias("person"))


@R.add(using("SELECT edition, min(edition) OVER (PARTITION BY city, people) AS class, count(*) OVER (PARTITION BY city, people) AS members FROM s", "edition", s="SELECT e.edition, e.city, string_agg(CAST(r.place AS VARCHAR), ',' ORDER BY r.place) AS people FROM edition e JOIN result r ON r.day = e.start AND r.category = e.city GROUP BY ALL"))
def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of a city by the multiset of their places: each with the first of those that have an equal sorted list, and how many there are."""
    r = results(spark, sf_dir).select(F.col("day").alias("start"), F.col("category").alias("city"), "place")
    s = editions(spark, sf_dir).join(r, ["start", "city"]).groupBy("edition", "city").agg(F.array_join(F.sort_array(F.collect_list("place")).cast("array<string>"), ",").alias("people"))
    classes = s.groupBy("city", "people").agg(F.min("edition").alias("class"), F.count("*").alias("members"))
    return s.join(classes, ["city", "people"]).select("edition", "class", "members")


@R.add()
def fuzzy_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two lists within one error, unique on both sides, within blocks of one country."""
    c = table(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("l"), F.col("c_nationkey").alias("country"), F.lower("c_name").alias("ln"))
    right = c.select(F.col("c_custkey").alias("r"), F.col("c_nationkey").alias("country"), F.regexp_replace(F.lower("c_name"), "c", "k").alias("rn"))
    return unique_names(left, right)


def unique_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r and far of names (l, country, ln) and (r, country, rn) within one error that have no other such name in their country.

    Distinct names meet, each with the number of rows that have it: a name of many
    rows is one row of the join, and whoever is near it has no single candidate. Names
    are spread before they get a row per deletion, and those rows are never broadcast:
    Spark's estimate of their size is that of the names alone.
    """
    ls = left.repartition("country", "ln").groupBy("country", "ln").agg(F.min("l").alias("l"), F.countDistinct("l").alias("nl"))
    rs = right.repartition("country", "rn").groupBy("country", "rn").agg(F.min("r").alias("r"), F.countDistinct("r").alias("nr"))
    vl, vr = (t.withColumn("v", F.explode(deletions(F.col(c)))) for t, c in ((ls, "ln"), (rs, "rn")))
    near = vl.join(vr.hint("merge"), ["country", "v"]).drop("v").distinct().withColumn("far", F.levenshtein("ln", "rn", 1)).where("far >= 0")
    near = written(near, "near")
    one = near.groupBy("country", "ln").agg(F.sum("nr").alias("rs")).where("rs = 1").select("country", "ln")
    other = near.groupBy("country", "rn").agg(F.sum("nl").alias("ls")).where("ls = 1").select("country", "rn")
    return near.join(one.hint("merge"), ["country", "ln"], "left_semi").join(other.hint("merge"), ["country", "rn"], "left_semi").select("l", "r", "far")


@R.add(using("SELECT x.competition AS whole, y.competition AS part, count(*) AS common, round(count(*) / max(y.n), 6) AS share FROM (SELECT competition, ym, person, count(*) OVER (PARTITION BY competition) AS n FROM (SELECT DISTINCT competition, ym, person % 30 AS person FROM result)) x JOIN (SELECT competition, ym, person, count(*) OVER (PARTITION BY competition) AS n FROM (SELECT DISTINCT competition, ym, person % 30 AS person FROM result)) y ON x.ym = y.ym AND x.person = y.person AND x.competition <> y.competition AND x.n >= y.n GROUP BY 1, 2 HAVING count(*) >= 0.8 * max(y.n)", "result"))
def overlap_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a combined competition: at least four fifths of their names are the whole's, too."""
    p = results(spark, sf_dir).select("competition", "ym", (F.col("person") % 30).alias("person")).distinct().withColumn("n", F.count("*").over(Window.partitionBy("competition")))
    x, y = p.alias("x"), p.alias("y")
    on = (F.col("x.ym") == F.col("y.ym")) & (F.col("x.person") == F.col("y.person")) & (F.col("x.competition") != F.col("y.competition")) & (F.col("x.n") >= F.col("y.n"))
    g = x.join(y, on).groupBy(F.col("x.competition").alias("whole"), F.col("y.competition").alias("part")).agg(F.count("*").alias("common"), F.max("y.n").alias("n"))
    return g.where(F.col("common") >= 0.8 * F.col("n")).select("whole", "part", "common", F.round(F.col("common") / F.col("n"), 6).alias("share"))


# Notifications, policies, coverage.

@R.add(using("SELECT person, strftime(day, '%Y-%m-%d') AS day, arg_min(source, (CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, source)) AS motive, count(*) AS n, array_to_string(list_slice(list_sort(list(k)), 1, 5), ',') AS lines FROM observation GROUP BY person, day", "observation"))
def notification_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notification per person and day: the strongest motive, and up to five lines."""
    order = F.when(F.col("source") == "purchase", 1).when(F.col("source") == "click", 2).otherwise(3)
    df = observations(spark, sf_dir).groupBy("person", "day").agg(F.min_by("source", F.struct(order.alias("o"), "source")).alias("motive"), F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("ks"))
    return df.select("person", iso(F.col("day")).alias("day"), "motive", "n", F.array_join(F.slice("ks", 1, 5).cast("array<string>"), ",").alias("lines"))


@R.add(using("SELECT edition, CASE WHEN age < 0 THEN 'wait' WHEN age <= 7 THEN 'daily' WHEN age <= 28 THEN 'weekly' WHEN age <= 60 THEN 'fortnightly' WHEN age <= 90 THEN 'final' ELSE 'frozen' END AS level FROM (SELECT edition, date_diff('day', stop, DATE '1998-06-01') AS age FROM edition)", "edition"))
def refresh_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("1998-06-01").cast("date"), F.col("stop"))
    return editions(spark, sf_dir).select("edition", F.when(age < 0, "wait").when(age <= 7, "daily").when(age <= 28, "weekly").when(age <= 60, "fortnightly").when(age <= 90, "final").otherwise("frozen").alias("level"))


@R.add(using("SELECT edition, CASE WHEN n = 1 THEN 1 WHEN source = 'int' THEN 7 ELSE 14 END AS days, n % 3 = 0 AND date_diff('day', stop, DATE '1998-06-01') < 7 AS skip FROM edition", "edition"))
def refetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.datediff(F.lit("1998-06-01").cast("date"), F.col("stop")) < 7
    return editions(spark, sf_dir).select("edition", F.when(F.col("n") == 1, 1).when(F.col("source") == "int", 7).otherwise(14).alias("days"), ((F.col("n") % 3 == 0) & fresh).alias("skip"))


@R.add(using("SELECT season, weapon, CASE WHEN lag(last) OVER w IS NULL THEN 'first' WHEN date_diff('day', lag(last) OVER w, last) >= 360 THEN 'weekly' ELSE 'after competition' END AS cadence, strftime(last, '%Y-%m-%d') AS last_day FROM (SELECT season, weapon, max(day) AS last FROM result GROUP BY season, weapon) WINDOW w AS (PARTITION BY weapon ORDER BY season)", "result"))
def ranking_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results(spark, sf_dir).groupBy("season", "weapon").agg(F.max("day").alias("last"))
    before = F.lag("last").over(Window.partitionBy("weapon").orderBy("season"))
    return df.select("season", "weapon", F.when(before.isNull(), "first").when(F.datediff("last", before) >= 360, "weekly").otherwise("after competition").alias("cadence"), iso(F.col("last")).alias("last_day"))


@R.add(using("SELECT k, arg_min(source, (CASE source WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, ts, id)) AS best FROM observation GROUP BY k", "observation"))
def best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("source") == "purchase", 1).when(F.col("source") == "view", 2).otherwise(3)
    return observations(spark, sf_dir).groupBy("k").agg(F.min_by("source", F.struct(order.alias("o"), "ts", "id")).alias("best"))


@R.add(using("SELECT season, count(*) AS competitions, count(*) FILTER (WHERE pools > 0) AS with_pools, count(*) FILTER (WHERE tableau > 0) AS with_tableau, count(*) FILTER (WHERE pools > 0 AND tableau > 0) AS complete FROM (SELECT competition, min(season) AS season, count(*) FILTER (WHERE phase = 'POULE') AS pools, count(*) FILTER (WHERE phase = 'TABLEAU') AS tableau FROM bout GROUP BY competition) GROUP BY season", "bout"))
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bouts(spark, sf_dir).groupBy("competition").agg(F.min("season").alias("season"), F.count_if(F.col("phase") == "POULE").alias("pools"), F.count_if(F.col("phase") == "TABLEAU").alias("tableau"))
    p, t = F.col("pools") > 0, F.col("tableau") > 0
    return c.groupBy("season").agg(F.count("*").alias("competitions"), F.count_if(p).alias("with_pools"), F.count_if(t).alias("with_tableau"), F.count_if(p & t).alias("complete"))


@R.add(using("SELECT edition, n AS cost, row_number() OVER (ORDER BY season DESC, n, edition) AS task FROM edition e WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM result r WHERE r.day = e.start AND r.category = e.city AND r.place = 1)", "edition"))
def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be read, new seasons and cheap units first, with its estimated cost; an edition of one row alone is none, since a single row is no classification."""
    done = results(spark, sf_dir).where("place = 1").select(F.col("day").alias("start"), F.col("category").alias("city")).distinct()
    e = editions(spark, sf_dir).where("n >= 2").join(done, ["start", "city"], "left_anti")
    return numbered_in_order(e, [F.desc("season"), "n", "edition"], "task").select("edition", F.col("n").alias("cost"), "task")


@R.add(using("SELECT a.zone, count(*) AS people, count(*) FILTER (WHERE balance < 0) AS warnings, min(best) AS best_place, CAST(sum(n) AS BIGINT) AS results FROM athlete a LEFT JOIN (SELECT person, min(place) AS best, count(*) AS n FROM result GROUP BY person) r USING (person) GROUP BY a.zone", "athlete", "result"))
def coach_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).groupBy("person").agg(F.min("place").alias("best"), F.count("*").alias("n"))
    return athletes(spark, sf_dir).join(r, "person", "left").groupBy("zone").agg(F.count("*").alias("people"), F.count_if(F.col("balance") < 0).alias("warnings"), F.min("best").alias("best_place"), F.sum("n").alias("results"))


# Small operators.

@R.add(using("SELECT competition, CASE WHEN source = 'int' THEN 'INTERNACIONAL' WHEN category = 'URGENT' THEN 'NACIONAL' END AS scope, regexp_matches(season, '^[0-9]{4}$') AS one_year, count(*) AS n FROM result GROUP BY ALL", "result"))
def scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.coalesce(F.when(F.col("source") == "int", "INTERNACIONAL"), F.when(F.col("category") == "URGENT", "NACIONAL"))
    return results(spark, sf_dir).groupBy("competition", scope.alias("scope"), F.col("season").rlike("^[0-9]{4}$").alias("one_year")).agg(F.count("*").alias("n"))


@R.add(using("SELECT fact, e1.edition FROM result r JOIN edition e1 ON e1.start = r.day AND e1.city = r.category WHERE r.place = 1 UNION SELECT fact, strftime(day, '%Y%m%d') || '-' || substr(category, 1, 1) FROM result WHERE source = 'int' AND place <= 2", "edition"))
def constructed_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = results(spark, sf_dir), editions(spark, sf_dir).select(F.col("start").alias("day"), F.col("city").alias("category"), "edition")
    one = r.where("place = 1").join(e, ["day", "category"]).select("fact", "edition")
    other = r.where("source = 'int' AND place <= 2").select("fact", F.concat_ws("-", F.date_format("day", "yyyyMMdd"), F.substring("category", 1, 1)).alias("edition"))
    return one.union(other).distinct()


@R.add(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split({form_sql('p_name')}, ' '), lambda x: NOT list_contains(string_split({form_sql('p_type')}, ' '), x)))), ',') AS only_name, len(list_intersect(list_distinct(string_split({form_sql('p_name')}, ' ')), string_split({form_sql('p_type')}, ' '))) AS shared FROM part")
def array_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = words(F.col("p_name")), words(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.array_except(n, t)), ",").alias("only_name"), F.size(F.array_intersect(n, t)).cast("long").alias("shared"))


SYNONYMS = {"steel": "metal", "brass": "metal", "copper": "metal", "tin": "metal", "nickel": "metal", "small": "size", "medium": "size", "large": "size"}
SYN_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS.items()) + ") AS s(word, concept)"


@R.add(f"SELECT p_partkey, array_to_string(list_sort(list(DISTINCT coalesce(concept, token))), ' ') AS terms FROM (SELECT p_partkey, unnest(string_split({form_sql('p_type')}, ' ')) AS token FROM part) LEFT JOIN {SYN_SQL} ON s.word = token GROUP BY p_partkey")
def synonym_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_of = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    terms = F.transform(words(F.col("p_type")), lambda w: F.coalesce(F.try_element_at(table_of, w), w))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(terms)), " ").alias("terms"))


EXONYMS = {"united states": "usa", "united kingdom": "uk", "saudi arabia": "ksa"}


CITY_FORM = form_sql("n_name")
CITY_CASES = " ".join(f"WHEN {CITY_FORM} = '{a}' THEN '{b}'" for a, b in EXONYMS.items())


@R.add(f"SELECT n_nationkey, CASE {CITY_CASES} ELSE {CITY_FORM} END AS city_key FROM nation")
def city_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which a place's several names meet."""
    from rostrum.functions.text import search_form

    form = search_form(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXONYMS.items() for x in kv]), form), form).alias("city_key"))


@R.add(using("SELECT fact, CASE WHEN format = 'EQUIPOS' THEN 'team' WHEN source = 'int' AND category = 'URGENT' THEN 'world' WHEN source = 'int' THEN 'satellite' WHEN category IN ('URGENT', 'HIGH') THEN 'national' ELSE 'regional' END AS type FROM result", "result"))
def performance_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("category"), F.col("source")
    return results(spark, sf_dir).select("fact", F.when(F.col("format") == "EQUIPOS", "team").when((s == "int") & (c == "URGENT"), "world").when(s == "int", "satellite").when(c.isin("URGENT", "HIGH"), "national").otherwise("regional").alias("type"))


@R.add(using("SELECT person, best, club, last_season FROM (SELECT person, min(place) AS best, max(season) AS last_season FROM result GROUP BY person) JOIN athlete USING (person)", "result", "athlete"))
def best_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).groupBy("person").agg(F.min("place").alias("best"), F.max("season").alias("last_season"))
    return r.join(athletes(spark, sf_dir).select("person", "club"), "person").select("person", "best", "club", "last_season")


@R.add(using("SELECT edition, date_diff('day', start, stop) AS days, strftime(date_trunc('week', start), '%Y-%m-%d') AS week, CAST(isodow(start) - 1 AS INTEGER) AS weekday, strftime(start, '%B') AS month FROM edition", "edition"))
def date_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions(spark, sf_dir).select("edition", F.datediff("stop", "start").cast("long").alias("days"), iso(F.date_trunc("week", "start")).alias("week"), F.weekday("start").cast("int").alias("weekday"), F.date_format("start", "MMMM").alias("month"))


# Streams (extras: the windows and sessions have no counterpart among the operators above). Each equals its batch twin on finished data.

@R.add()
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.streaming import outbox

    return outbox.to_end(outbox.deduplicated(outbox.events(spark, sf_dir))).select("event_id")


@R.add()
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.streaming import outbox

    return outbox.to_end(outbox.tumbling(outbox.events(spark, sf_dir)))


@R.add()
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.streaming import outbox

    return outbox.to_end(outbox.user_sessions(outbox.events(spark, sf_dir)))


@R.add()
def stream_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each person's registration as its events are read: new, changed, withdrawn, returned, late, final."""
    from rostrum.streaming import outbox, registrations

    own = spark.newSession()  # another state store than the session's other streams have
    own.conf.set("spark.sql.streaming.stateStore.providerClass", registrations.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    readings = outbox.events(own, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", F.coalesce("event_type", F.lit("")).alias("content"), F.coalesce(F.col("value") >= 10, F.lit(False)).alias("present"))
    return outbox.to_end(registrations.followed(readings))
