"""Queries over sources in several forms, snapshots, deliveries, made keys and brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions import ical
from rostrum.functions.dates import iso, utc_offset_hours
from rostrum.functions.text import words
from rostrum.operators import bracket, pairs, repair, upkeep
from rostrum.plans.calendar import LINK, LINKED, links
from rostrum.plans.oracle import using
from rostrum.plans.registry import Registry
from rostrum.plans.stewardship import NEW, OLD, old_new
from rostrum.plans.texts import form_sql
from rostrum.sources.adapter import athletes, bouts, editions, observations, results, table
from rostrum.sources.readers import html_items, struct_list

R = Registry()


# Sources.

@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of SQL with named parameters over a view."""
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least"
    return spark.sql(sql, args={"status": "F", "least": 100000}, orders=table(spark, sf_dir, "orders"))


ASKED = '[{"weapon": "SABLE", "place": 1}, {"weapon": "FLORETE", "place": 2}, {"weapon": "SABLE", "place": 3}]'


@R.add(using("SELECT fact, weapon, place FROM result WHERE (weapon, place) IN (('SABLE', 1), ('FLORETE', 2), ('SABLE', 3))", "result"))
def struct_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the pairs that a JSON parameter lists."""
    asked = struct_list(spark, ASKED, "weapon string, place bigint")
    return results(spark, sf_dir).join(F.broadcast(asked), ["weapon", "place"], "left_semi").select("fact", "weapon", "place")


ITEM = '<li><a href="([^"]*)">([^<]*)</a></li>'


@R.add(f"SELECT page_id, CAST(unnest(range(1, len(hrefs) + 1)) AS BIGINT) AS pos, unnest(hrefs) AS href, unnest(labels) AS label FROM (SELECT page_id, regexp_extract_all(html, '{ITEM}', 1) AS hrefs, regexp_extract_all(html, '{ITEM}', 2) AS labels FROM pages)")
def html_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a page's lists with their place in it."""
    return html_items(table(spark, sf_dir, "pages"), "html", ITEM, ["href", "label"]).select("page_id", "pos", "href", "label")


# Snapshots.

@R.add(using("SELECT o.fact, o.place, CASE WHEN n.fact IS NULL THEN '1999-01-01' END AS disappeared FROM o LEFT JOIN n ON n.fact = o.fact", "result", o=OLD, n=NEW))
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a full scan no longer has are marked with its day; those that it has lose the mark."""
    old, new = old_new(spark, sf_dir)
    marked = upkeep.mark_missing(old.withColumn("gone", F.lit(None).cast("date")), new, ["fact"], F.lit("1999-01-01").cast("date"), "gone")
    return marked.select("fact", "place", iso(F.col("gone")).alias("disappeared"))


@R.add(using("SELECT o.fact, o.person, CASE WHEN n.fact IS NULL THEN o.points ELSE n.points END AS points, CASE WHEN n.fact IS NULL THEN o.place ELSE n.place END AS place, n.fact IS NOT NULL AND (n.points IS DISTINCT FROM o.points OR n.place IS DISTINCT FROM o.place) AS changed FROM o LEFT JOIN n ON n.fact = o.fact", "result", o=OLD, n=NEW))
def update_from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return upkeep.update_from(old, new, ["fact"], ["points", "place"])


SNAP_OLD = "SELECT fact, ym AS snapshot, place FROM result WHERE ym <= 199712"
SNAP_NEW = "SELECT fact, ym AS snapshot, place + 1 AS place FROM result WHERE ym BETWEEN 199711 AND 199801 AND fact % 2 = 0"


@R.add(using("SELECT fact, snapshot, place FROM o WHERE snapshot NOT IN (SELECT snapshot FROM n) UNION ALL SELECT fact, snapshot, place FROM n", "result", o=SNAP_OLD, n=SNAP_NEW))
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots after an append: those that are written again replace the ones of their day."""
    r = results(spark, sf_dir).withColumnRenamed("ym", "snapshot")
    old = r.where("snapshot <= 199712").select("fact", "snapshot", "place")
    new = r.where("snapshot BETWEEN 199711 AND 199801 AND fact % 2 = 0").select("fact", "snapshot", (F.col("place") + 1).alias("place"))
    return upkeep.replace_snapshots(old, new, "snapshot")


@R.add(using("SELECT competition, line, a, b FROM (SELECT *, min(competition) OVER (PARTITION BY a, b, day) AS least FROM bout) WHERE competition = least", "bout"))
def canonical_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of the smallest competition where several hold the pair on one day."""
    return pairs.canonical_copy(bouts(spark, sf_dir), ["a", "b", "day"], "competition").select("competition", "line", "a", "b")


# Deliveries and work slots.

INBOX = "SELECT person, k, min(value) AS content, bool_or(id % 2 = 0) AS read FROM observation WHERE id % 3 <> 0 GROUP BY person, k"
NOTICES = "SELECT person, k, max(value) AS content FROM observation WHERE id % 4 <> 0 GROUP BY person, k"


@R.add(using("SELECT coalesce(o.person, n.person) AS person, coalesce(o.k, n.k) AS k, coalesce(n.content, o.content) AS content, CASE WHEN o.person IS NULL THEN 'new' WHEN n.person IS NULL THEN 'kept' WHEN n.content IS NOT DISTINCT FROM o.content THEN 'unchanged' ELSE 'updated' END AS state, o.person IS NOT NULL AND (n.person IS NULL OR n.content IS NOT DISTINCT FROM o.content) AND o.read AS read FROM o FULL JOIN n ON n.person = o.person AND n.k = o.k", "observation", o=INBOX, n=NOTICES))
def inbox_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices by profile and key: the same content again changes nothing, other content makes a notice unread."""
    ob = observations(spark, sf_dir)
    stored = ob.where("id % 3 <> 0").groupBy("person", "k").agg(F.min("value").alias("content"), F.bool_or(F.col("id") % 2 == 0).alias("read"))
    new = ob.where("id % 4 <> 0").groupBy("person", "k").agg(F.max("value").alias("content"))
    return upkeep.deliver(stored, new, ["person", "k"], "content", "read")


@R.add(using("SELECT id, person, source FROM observation WHERE id > 100 AND ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY ORDER BY id LIMIT 500", "observation"))
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch behind a consumer's cursor: in order of ids, at most 500, nothing that retention has passed."""
    kept = F.col("ts") > F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    return observations(spark, sf_dir).where((F.col("id") > 100) & kept).orderBy("id").limit(500).select("id", "person", "source")


@R.add(using("SELECT source AS task, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, min(id) AS claimant, count(*) AS claims FROM observation GROUP BY source, date_trunc('minute', ts)", "observation"))
def slot_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who runs a task in a minute: the first to claim the slot, all others do nothing."""
    slot = F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute")
    return observations(spark, sf_dir).groupBy(F.col("source").alias("task"), slot).agg(F.min("id").alias("claimant"), F.count("*").alias("claims"))


@R.add(using("SELECT id, CAST(1 + sum(CASE WHEN before <> content THEN 1 ELSE 0 END) OVER (PARTITION BY person, k ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM (SELECT *, lag(content) OVER (PARTITION BY person, k ORDER BY ts, id) AS before FROM (SELECT *, floor(value / 20) AS content FROM observation))", "observation"))
def revision_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of each reading: one more whenever the content is another than before."""
    w = Window.partitionBy("person", "k").orderBy("ts", "id")
    df = observations(spark, sf_dir).withColumn("content", F.floor(F.col("value") / 20))
    df = df.withColumn("new", F.when(F.lag("content").over(w) != F.col("content"), 1).otherwise(0))
    return df.select("id", (1 + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("revision"))


# Keys.

@R.add(using("SELECT coalesce(l.main, e.edition) AS card, count(DISTINCT r.person) AS people, count(*) AS entries FROM edition e JOIN result r ON r.day = e.start AND r.category = e.city LEFT JOIN l ON l.secondary = e.edition AND l.status = 'AUTOMATICO' GROUP BY 1", "edition", k=LINK, l=LINKED))
def canonical_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of linked events on one card: the main event's, or their own."""
    r = results(spark, sf_dir).select(F.col("day").alias("start"), F.col("category").alias("city"), "person")
    sure = links(spark, sf_dir).where("status = 'AUTOMATICO'").select(F.col("secondary").alias("edition"), "main")
    df = editions(spark, sf_dir).join(r, ["start", "city"]).join(sure, "edition", "left")
    return df.groupBy(F.coalesce("main", "edition").alias("card")).agg(F.countDistinct("person").alias("people"), F.count("*").alias("entries"))


@R.add(using("SELECT e.edition, count(*) AS facts, min(r.place) AS best FROM edition e JOIN result r ON r.source = 'int' AND strftime(r.day, '%Y%m%d') = substr(e.edition, 1, 8) AND substr(r.category, 1, 1) = substr(e.edition, 10, 1) GROUP BY e.edition", "edition"))
def inverse_constructed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an edition by taking its key apart: the key becomes columns that join, facts are added up before they meet it."""
    facts = results(spark, sf_dir).where("source = 'int'").groupBy("day", F.substring("category", 1, 1).alias("letter")).agg(F.count("*").alias("facts"), F.min("place").alias("best"))
    e = editions(spark, sf_dir).select("edition", F.to_date(F.substring("edition", 1, 8), "yyyyMMdd").alias("day"), F.substring("edition", 10, 1).alias("letter"))
    return e.join(facts, ["day", "letter"]).groupBy("edition").agg(F.sum("facts").cast("long").alias("facts"), F.min("best").alias("best"))


VAGUE = ("LOW", "MEDIUM")
VAGUE_SQL = "('LOW', 'MEDIUM')"


@R.add(using(f"SELECT e.edition, CASE WHEN e.city NOT IN {VAGUE_SQL} THEN e.city WHEN m.city NOT IN {VAGUE_SQL} THEN m.city END AS type, CASE WHEN e.city NOT IN {VAGUE_SQL} THEN 'own' WHEN m.city NOT IN {VAGUE_SQL} THEN 'canonical' END AS origin FROM edition e LEFT JOIN (SELECT start, max(city) AS city FROM edition GROUP BY start) m ON m.start = e.start", "edition"))
def documented_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type with where it is from: an event's own if it says something, else its canonical event's, else none."""
    e = editions(spark, sf_dir)
    canonical = e.groupBy("start").agg(F.max("city").alias("other"))
    own, other = ~F.col("city").isin(*VAGUE), ~F.col("other").isin(*VAGUE)
    df = e.join(canonical, "start", "left")
    return df.select("edition", F.when(own, F.col("city")).when(other, F.col("other")).alias("type"), F.when(own, "own").when(other, "canonical").alias("origin"))


@R.add(using("SELECT w || '-' || f || '-' || c AS key, w AS weapon, f AS format, c AS category FROM (SELECT DISTINCT weapon AS w FROM result), (SELECT DISTINCT format AS f FROM result), (SELECT DISTINCT category AS c FROM result)", "result"))
def key_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys that a source can be asked for, from the values that its results have: a few enumerations, gathered as one row."""
    df = results(spark, sf_dir).agg(*[F.collect_set(c).alias(c) for c in ("weapon", "format", "category")])
    for c in ("weapon", "format", "category"):
        df = df.withColumn(c, F.explode(c))
    return df.select(F.concat_ws("-", "weapon", "format", "category").alias("key"), "weapon", "format", "category")


@R.add(using("SELECT a.club, count(*) AS pending, strftime(min(o.first), '%Y-%m-%d') AS since FROM (SELECT person, k, min(day) AS first FROM observation GROUP BY person, k HAVING NOT bool_or(source IN ('purchase', 'signup'))) o JOIN athlete a USING (person) GROUP BY a.club", "observation", "athlete"))
def club_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a club: registrations of its people that nobody has answered."""
    o = observations(spark, sf_dir).groupBy("person", "k").agg(F.min("day").alias("first"), F.bool_or(F.col("source").isin("purchase", "signup")).alias("done")).where("NOT done")
    return o.join(athletes(spark, sf_dir).select("person", "club"), "person").groupBy("club").agg(F.count("*").alias("pending"), iso(F.min("first")).alias("since"))


# Text and time.

NYC = """SELECT edition, CASE WHEN start >= make_date(year(start), 4, 1) + CAST((7 - dayofweek(make_date(year(start), 4, 1))) % 7 AS INTEGER)
    AND start < make_date(year(start), 10, 31) - CAST(dayofweek(make_date(year(start), 10, 31)) AS INTEGER) THEN -4.0 ELSE -5.0 END::DOUBLE AS hours FROM edition"""


@R.add(using(NYC, "edition"))
def zone_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between local noon and UTC at a place, by the rules of that year."""
    return editions(spark, sf_dir).select("edition", utc_offset_hours(F.col("start"), "America/New_York").alias("hours"))


TOKENS = f"SELECT DISTINCT token FROM (SELECT unnest(string_split({form_sql('p_name')}, ' ')) AS token FROM part) WHERE length(token) > 2"


@R.add(f"WITH t AS ({TOKENS}), d AS (SELECT token, substr(token, 1, i - 1) || '?' || substr(token, i + 1) AS damaged FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t)) SELECT damaged, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(t.token) END AS repaired FROM (SELECT DISTINCT damaged FROM d) JOIN t ON t.token LIKE replace(damaged, '?', '_') GROUP BY damaged")
def letter_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in which a letter was lost, by the one word of the dictionary that they can have been."""
    t = table(spark, sf_dir, "part").select(F.explode(words(F.col("p_name"))).alias("token")).where(F.char_length("token") > 2).distinct()
    damaged = t.select(F.explode(repair.holes(F.col("token"))).alias("hole")).select(F.concat("hole.head", F.lit("?"), "hole.tail").alias("damaged")).distinct()
    return repair.lost_letters(damaged, "damaged", t, "token")


def ics(edition, start, stop, city, n):
    """An edition as the text of a calendar's event."""
    text = F.concat(F.lit("Open, "), city, F.lit("; "), n.cast("string"), F.lit(" entries"))
    more = F.concat(F.lit("Entries close seven days before the first day, "), iso(start), F.lit("; late ones are settled by the organisers of "), city)
    return ical.event(F.concat(edition, F.lit("@rostrum")), start, stop, text, more)


ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), ';', '\\;'), ',', '\\,')"
MORE = "'Entries close seven days before the first day, ' || strftime(start, '%Y-%m-%d') || '; late ones are settled by the organisers of ' || city"
LONG = "('DESCRIPTION:' || " + ESCAPED.format(MORE) + ")"
CRLF = " || chr(13) || chr(10) || "
FOLDED = f"(substr({LONG}, 1, 75) || regexp_replace(substr({LONG}, 76), '(.{{1,74}})', chr(13) || chr(10) || ' \\1', 'g'))"
EVENT = CRLF.join(["'BEGIN:VEVENT'", "'UID:' || edition || '@rostrum'", "'DTSTART;VALUE=DATE:' || strftime(start, '%Y%m%d')", "'DTEND;VALUE=DATE:' || strftime(stop + 1, '%Y%m%d')", "'SUMMARY:' || " + ESCAPED.format("('Open, ' || city || '; ' || CAST(n AS VARCHAR) || ' entries')"), FOLDED, "'END:VEVENT'"])


@R.add(using(f"SELECT edition, {EVENT} AS ics FROM edition", "edition"))
def ical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = editions(spark, sf_dir)
    return e.select("edition", ics(F.col("edition"), F.col("start"), F.col("stop"), F.col("city"), F.col("n")).alias("ics"))


# Brackets.

DRAWN = "(VALUES (2, 1, 1), (4, 1, 1), (4, 2, 2), (8, 1, 1), (8, 4, 2), (8, 2, 3), (8, 3, 4)) AS d(size, place, seat)"


@R.add(using(f"SELECT w.competition, CAST(d.size AS INTEGER) AS size, w.fact AS winner, row_number() OVER (PARTITION BY w.competition, d.size ORDER BY d.seat) AS seat FROM result w JOIN {DRAWN} ON d.place = w.place JOIN result l ON l.competition = w.competition AND l.place = d.size + 1 - d.place", "result"))
def bracket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three rounds of a competition, made of its first eight places (a fact is a seat: a person can have several places here), in the order in which they are drawn."""
    top = results(spark, sf_dir).where("place <= 8").groupBy("competition").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int"), F.col("fact")))).alias("of"))
    made = top.select("competition", "of", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.lit(i).alias("i")) for n in (2, 4, 8) for i in range(1, n // 2 + 1)])).alias("x"))
    rows = made.select("competition", "x.size", F.try_element_at("of", F.col("x.i")).alias("w"), F.try_element_at("of", F.col("x.size") + 1 - F.col("x.i")).alias("l"), F.col("x.i").alias("number"), "x.i").where("l IS NOT NULL")
    rows = rows.select("competition", "size", F.col("w").alias("a"), F.col("l").alias("b"), F.col("w").alias("winner"), "number")
    return bracket.ordered(rows, ["competition"]).select("competition", "size", "winner", "seat")
