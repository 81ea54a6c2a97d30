"""Queries over bouts: balances, head-to-head, rivals, pools, consistency and country aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions.dates import iso
from rostrum.operators import joins, pairs
from rostrum.operators.storage import divided
from rostrum.operators.windows import best_of, first_per, longest_streak, numbered, ranked, running_sum, top_k
from rostrum.plans.oracle import BALANCE, RATE, using
from rostrum.plans.registry import Registry
from rostrum.sources.adapter import bouts, fencers, table

R = Registry()
ME, RIVAL = 5, 7


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.orient(bouts(spark, sf_dir), "a", "b", "score_a", "score_b")


def pair(df: DataFrame) -> DataFrame:
    """The bouts of two people; the condition reaches the scan, since it is put before the sides are made."""
    return pairs.orient(df.where(((F.col("a") == ME) & (F.col("b") == RIVAL)) | ((F.col("a") == RIVAL) & (F.col("b") == ME))), "a", "b", "score_a", "score_b").where((F.col("me") == ME) & (F.col("rival") == RIVAL))


PAIR = f"me = {ME} AND rival = {RIVAL}"


@R.add(using(f"SELECT me, {BALANCE}, {RATE} AS win_rate, count(DISTINCT rival) AS rivals FROM oriented GROUP BY me", "oriented"))
def bout_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir).groupBy("me").agg(*pairs.balance(), F.countDistinct("rival").alias("rivals"))
    return df.withColumn("win_rate", pairs.win_rate())


@R.add(using(f"SELECT me, coalesce(phase, '*') AS phase, coalesce(season, '*') AS season, {BALANCE} FROM oriented GROUP BY GROUPING SETS ((me), (me, phase), (me, season))", "oriented"))
def bout_balance_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir).groupingSets([["me"], ["me", "phase"], ["me", "season"]], "me", "phase", "season").agg(*pairs.balance())
    return df.withColumns({"phase": F.coalesce("phase", F.lit("*")), "season": F.coalesce("season", F.lit("*"))})


@R.add(using(f"SELECT me, rival, {BALANCE} FROM oriented WHERE {PAIR} GROUP BY me, rival", "oriented"))
def h2h_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(bouts(spark, sf_dir)).groupBy("me", "rival").agg(*pairs.balance())


PAGE = 20


@R.add(using("SELECT competition, line, strftime(day, '%Y-%m-%d') AS day, phase, favor, contra FROM oriented WHERE me = 5 AND favor <> contra AND (day, competition, line, rival, favor, contra, phase) < (DATE '1998-01-01', 0, 0, 0, 0, 0, '') ORDER BY oriented.day DESC, competition DESC, line DESC, rival DESC, favor DESC, contra DESC, phase DESC LIMIT 21", "oriented"))
def h2h_bouts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first after a keyset cursor over all that tells bouts apart, one row more than a page."""
    df = oriented(spark, sf_dir).where((F.col("me") == ME) & (F.col("favor") != F.col("contra")))
    key = ["day", "competition", "line", "rival", "favor", "contra", "phase"]
    df = df.where(F.struct(*key) < F.struct(F.lit("1998-01-01").cast("date"), F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(0), F.lit(0), F.lit("")))
    df = df.orderBy(*map(F.desc, key)).limit(PAGE + 1)
    return df.select("competition", "line", iso(F.col("day")).alias("day"), "phase", "favor", "contra")


@R.add(using("""SELECT rival, competition, line, strftime(day, '%Y-%m-%d') AS on_day, CAST(sum(sign(favor - contra)) OVER (PARTITION BY rival ORDER BY day, phase, competition, line, favor, contra ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
    FROM oriented WHERE me = 5""", "oriented"))
def h2h_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir).where(F.col("me") == ME)
    df = running_sum(df, ["rival"], ["day", "phase", "competition", "line", "favor", "contra"], F.signum(F.col("favor") - F.col("contra")), "balance")
    return df.select("rival", "competition", "line", iso(F.col("day")).alias("on_day"), F.col("balance").cast("long").alias("balance"))


@R.add(using(f"""SELECT season, {BALANCE}, count(DISTINCT competition) AS shared FROM oriented WHERE {PAIR} GROUP BY season""", "oriented"))
def h2h_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(bouts(spark, sf_dir)).groupBy("season").agg(*pairs.balance(), F.countDistinct("competition").alias("shared"))


@R.add(using("""SELECT c.competition, count(b.line) AS bouts, coalesce(string_agg(CAST(b.favor AS VARCHAR) || ':' || CAST(b.contra AS VARCHAR), ',' ORDER BY b.line), '') AS scores
    FROM c LEFT JOIN (SELECT * FROM oriented WHERE me = 5 AND rival = 7) b ON b.competition = c.competition GROUP BY c.competition""",
    "oriented", shared="(SELECT competition FROM oriented WHERE me = 5 INTERSECT SELECT competition FROM oriented WHERE me = 7)", c="SELECT competition FROM shared UNION SELECT competition FROM oriented WHERE me = 5 AND rival = 7"))
def common_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir)
    mine, theirs = df.where(F.col("me") == ME), df.where(F.col("me") == RIVAL)
    direct = mine.where(F.col("rival") == RIVAL)
    shared = mine.select("competition").intersect(theirs.select("competition")).union(direct.select("competition")).distinct()
    duels = direct.groupBy("competition").agg(F.count("*").alias("bouts"), F.sort_array(F.collect_list(F.struct("line", "favor", "contra"))).alias("list"))
    scores = F.array_join(F.transform("list", lambda b: F.concat_ws(":", b["favor"], b["contra"])), ",")
    return shared.join(duels, "competition", "left").select("competition", F.coalesce("bouts", F.lit(0)).cast("long").alias("bouts"), F.coalesce(scores, F.lit("")).alias("scores"))


@R.add(using(f"SELECT ra.root AS me, rb.root AS rival, {BALANCE} FROM oriented o JOIN root ra ON ra.id = o.me JOIN root rb ON rb.id = o.rival WHERE ra.root <> rb.root GROUP BY 1, 2", "oriented", "root"))
def rival_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.operators.identity import closure

    roots = closure(fencers(spark, sf_dir))
    df = oriented(spark, sf_dir).join(roots.select(F.col("id").alias("me"), F.col("root").alias("me_root")), "me").join(roots.select(F.col("id").alias("rival"), F.col("root").alias("rival_root")), "rival")
    df = df.where("me_root <> rival_root").select(F.col("me_root").alias("me"), F.col("rival_root").alias("rival"), "favor", "contra")
    return df.groupBy("me", "rival").agg(*pairs.balance())


@R.add(using("""SELECT me, rival, bouts, rn, strftime(last_day, '%Y-%m-%d') AS last_day, last_score FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY bouts DESC, last_day DESC, rival) AS rn FROM g) WHERE rn <= 8""",
    "oriented", g="SELECT me, rival, count(*) AS bouts, max(day) AS last_day, arg_max(CAST(favor AS VARCHAR) || '-' || CAST(contra AS VARCHAR), (day, competition, line, favor, contra)) AS last_score FROM oriented GROUP BY me, rival"))
def frequent_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = oriented(spark, sf_dir).groupBy("me", "rival").agg(F.count("*").alias("bouts"), F.max("day").alias("last"), F.max_by(F.concat_ws("-", "favor", "contra"), F.struct("day", "competition", "line", "favor", "contra")).alias("last_score"))
    return top_k(g, ["me"], [F.desc("bouts"), F.desc("last"), "rival"], 8).select("me", "rival", "bouts", "rn", iso(F.col("last")).alias("last_day"), "last_score")


@R.add(using("SELECT me, rival, max(run) AS streak FROM r GROUP BY me, rival", "oriented",
    i="SELECT *, sum(CASE WHEN favor > contra THEN 0 ELSE 1 END) OVER (PARTITION BY me, rival ORDER BY day, competition, line, favor, contra ROWS UNBOUNDED PRECEDING) AS island FROM oriented",
    r="SELECT me, rival, island, count(*) FILTER (WHERE favor > contra) AS run FROM i GROUP BY me, rival, island"))
def rival_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_streak(oriented(spark, sf_dir), ["me", "rival"], ["day", "competition", "line", "favor", "contra"], pairs.won())


RECORDS = {
    "most_bouts": "bouts", "most_wins": "wins", "most_losses": "losses", "most_undecided": "undecided", "most_touches": "touches_for", "most_received": "touches_against",
    "best_difference": "touches_for - touches_against", "worst_difference": "touches_against - touches_for", "one_touch": "one_touch",
}


@R.add(using("\nUNION ALL ".join(f"SELECT me, '{k}' AS record, arg_max(rival, ({v}, -rival)) AS rival, CAST(max({v}) AS BIGINT) AS amount FROM g GROUP BY me" for k, v in RECORDS.items()), "oriented",
    g=f"SELECT me, rival, {BALANCE}, count(*) FILTER (WHERE abs(favor - contra) = 1) AS one_touch FROM oriented GROUP BY me, rival"))
def rival_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine records in one pass over the table of rivals."""
    g = oriented(spark, sf_dir).groupBy("me", "rival").agg(*pairs.balance(), F.count_if(F.abs(F.col("favor") - F.col("contra")) == 1).alias("one_touch"))
    best = g.groupBy("me").agg(*[F.max(F.struct(F.expr(v).cast("long").alias("amount"), (-F.col("rival")).alias("r"))).alias(k) for k, v in RECORDS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("record"), (-F.col(f"{k}.r")).alias("rival"), F.col(f"{k}.amount").alias("amount")) for k in RECORDS]))
    return best.select("me", rows.alias("x")).select("me", "x.*")


@R.add(using("""SELECT me, scope, list, rival, rn, amount FROM (
      SELECT me, scope, 'faced' AS list, rival, bouts AS amount, row_number() OVER (PARTITION BY me, scope ORDER BY bouts DESC, wins DESC, rival) AS rn FROM g
      UNION ALL SELECT me, scope, 'beaten', rival, wins, row_number() OVER (PARTITION BY me, scope ORDER BY wins DESC, losses, rival) FROM g
      UNION ALL SELECT me, scope, 'nemesis', rival, losses, row_number() OVER (PARTITION BY me, scope ORDER BY losses DESC, wins, rival) FROM g) WHERE rn <= 5""",
    "oriented", s="SELECT *, CASE WHEN phase = 'TABLEAU' THEN 'INTERNACIONAL' ELSE 'NACIONAL' END AS own FROM oriented", e="SELECT *, 'todo' AS scope FROM s UNION ALL SELECT *, own FROM s", g=f"SELECT me, scope, rival, {BALANCE} FROM e GROUP BY me, scope, rival"))
def rivals_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first of three lists in two scopes: of rivals with one balance only the five least ids can be among them, so no list sorts the others."""
    own = F.when(F.col("phase") == "TABLEAU", "INTERNACIONAL").otherwise("NACIONAL")
    df = divided(oriented(spark, sf_dir).select("me", "rival", "favor", "contra", own.alias("own")), 2 * table(spark, sf_dir, "lineitem").count(), "me")
    figures = ("bouts", "wins", "losses")
    per = df.groupBy("me", "rival", "own").agg(F.count("*").alias("bouts"), F.count_if(pairs.won()).alias("wins"), F.count_if(pairs.lost()).alias("losses"))
    whole = per.groupBy("me", "rival").agg(*[F.sum(c).alias(c) for c in figures]).select("me", F.lit("todo").alias("scope"), "rival", *figures)
    keys = ["me", "scope"]
    few = top_k(whole.union(per.select("me", "own", "rival", *figures)), [*keys, *figures], ["rival"], 5, "least")
    lists = {"faced": ("bouts", [F.desc("bouts"), F.desc("wins"), "rival"]), "beaten": ("wins", [F.desc("wins"), "losses", "rival"]), "nemesis": ("losses", [F.desc("losses"), "wins", "rival"])}
    for name, (_, order) in lists.items():
        few = numbered(few, keys, order, f"rn_{name}")
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(c).alias("amount"), F.col(f"rn_{n}").alias("rn")) for n, (c, _) in lists.items()]))
    return few.select("me", "scope", "rival", one.alias("x")).select("me", "scope", "rival", "x.*").where("rn <= 5")


@R.add(using("SELECT competition, me, count(*) AS bouts, count(*) FILTER (WHERE favor > contra) AS v, CAST(sum(favor) AS BIGINT) AS given, CAST(sum(contra) AS BIGINT) AS received, string_agg(CAST(rival AS VARCHAR) || '=' || CAST(favor AS VARCHAR), ' ' ORDER BY rival, line, favor) AS cells FROM oriented WHERE phase = 'POULE' GROUP BY competition, me", "oriented"))
def pool_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir).where("phase = 'POULE'").groupBy("competition", "me").agg(
        F.count("*").alias("bouts"), F.count_if(pairs.won()).alias("v"), F.sum("favor").cast("long").alias("given"), F.sum("contra").cast("long").alias("received"), F.sort_array(F.collect_list(F.struct("rival", "line", "favor"))).alias("list"))
    return df.withColumn("cells", F.array_join(F.transform("list", lambda c: F.concat_ws("=", c["rival"], c["favor"])), " ")).drop("list")


@R.add(using("""SELECT competition, me, 'twice_in_round' AS problem, count(*) AS n FROM t GROUP BY competition, me HAVING count(*) > 1
    UNION ALL SELECT competition, least(a, b), 'repeated_pair', count(*) FROM bout GROUP BY competition, least(a, b), greatest(a, b) HAVING count(*) > 1
    UNION ALL SELECT l.competition, l.me, 'loser_continues', count(*) FROM t l JOIN t n ON n.competition = l.competition AND n.me = l.me AND n.line > l.line WHERE l.favor < l.contra GROUP BY l.competition, l.me""", "oriented", t="SELECT * FROM oriented WHERE phase = 'TABLEAU'"))
def bracket_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of a bracket: who is twice in it, pairs that repeat, losers that go on (a window, not a self-join)."""
    t = oriented(spark, sf_dir).where("phase = 'TABLEAU'")
    key = ["competition", "me"]
    twice = t.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("twice_in_round").alias("problem"), "n")
    same = bouts(spark, sf_dir).groupBy("competition", F.least("a", "b").alias("me"), F.greatest("a", "b").alias("other")).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated_pair").alias("problem"), "n")
    after = F.count("*").over(Window.partitionBy(*key).orderBy("line").rangeBetween(1, Window.unboundedFollowing))
    goes = t.withColumn("after", after).where(pairs.lost()).groupBy(*key).agg(F.sum("after").alias("n")).where("n > 0").select(*key, F.lit("loser_continues").alias("problem"), "n")
    return twice.unionByName(same).unionByName(goes)


SIGNATURE = "CASE WHEN a < b THEN CAST(a AS VARCHAR) || ':' || CAST(score_a AS VARCHAR) || '|' || CAST(b AS VARCHAR) || ':' || CAST(score_b AS VARCHAR) ELSE CAST(b AS VARCHAR) || ':' || CAST(score_b AS VARCHAR) || '|' || CAST(a AS VARCHAR) || ':' || CAST(score_a AS VARCHAR) END"


def signature():
    """An order-free signature of a bout."""
    one, other = F.concat_ws(":", "a", "score_a"), F.concat_ws(":", "b", "score_b")
    return F.when(F.col("a") < F.col("b"), F.concat_ws("|", one, other)).otherwise(F.concat_ws("|", other, one))


@R.add(using(f"SELECT {SIGNATURE} AS signature, count(*) AS n, min(competition) AS first, count(DISTINCT season) AS seasons FROM bout GROUP BY 1 HAVING count(*) > 1", "bout"))
def bout_signature_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bouts(spark, sf_dir).groupBy(signature().alias("signature")).agg(F.count("*").alias("n"), F.min("competition").alias("first"), F.countDistinct("season").alias("seasons")).where("n > 1")


@R.add(using(f"SELECT competition, line, s FROM (SELECT competition, line, {SIGNATURE} AS s, row_number() OVER (PARTITION BY {SIGNATURE}, season ORDER BY competition DESC, line DESC) AS rn FROM bout) WHERE rn = 1", "bout"))
def repeats_across_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one signature within a season the latest round stays."""
    return first_per(bouts(spark, sf_dir).withColumn("s", signature()), ["s", "season"], [F.desc("competition"), F.desc("line")]).select("competition", "line", "s")


@R.add(using("SELECT competition, line, score_a = 5 AND score_b = 5 AS both_five, score_a = score_b AS tie, (score_a > score_b) <> (line % 2 = 1) AND score_a <> score_b AS incoherent, arg_max FROM (SELECT *, first_value(line) OVER (PARTITION BY competition ORDER BY score_a + score_b DESC, line) AS arg_max FROM bout)", "bout"))
def bout_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bouts(spark, sf_dir)
    pick = best_of(best, ["competition"], F.struct((F.col("score_a") + F.col("score_b")).alias("t"), (-F.col("line")).alias("l")), ["line"]).withColumnRenamed("line", "arg_max")
    a, b = F.col("score_a"), F.col("score_b")
    return best.join(pick, "competition").select("competition", "line", ((a == 5) & (b == 5)).alias("both_five"), (a == b).alias("tie"), (((a > b) != (F.col("line") % 2 == 1)) & (a != b)).alias("incoherent"), "arg_max")


@R.add(using("""SELECT one, other, common, x.n AS people_one, y.n AS people_other FROM (SELECT x.competition AS one, y.competition AS other, count(DISTINCT x.person) AS common FROM p x JOIN p y ON x.person = y.person AND abs(date_diff('day', x.day, y.day)) <= 2 AND x.competition < y.competition GROUP BY 1, 2)
    JOIN f x ON x.competition = one JOIN f y ON y.competition = other WHERE common >= 2 AND 2 * common >= least(x.n, y.n)""",
    "oriented", p="SELECT DISTINCT competition, me AS person, day FROM oriented", f="SELECT competition, count(DISTINCT person) AS n FROM p GROUP BY competition"))
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions that share two people or more, half of the smaller field at least, within two days.

    A person's bouts meet where they are sorted by day, each those of it and the two days after; only pairs are shuffled again.
    """
    b = bouts(spark, sf_dir)
    field = b.groupBy("competition").agg(F.size(F.array_union(F.collect_set("a"), F.collect_set("b"))).cast("long").alias("n"))
    sides = b.where("competition IS NOT NULL AND day IS NOT NULL").select("competition", F.unix_date("day").alias("day"), F.explode(F.array("a", "b")).alias("person"))
    p = divided(sides, 2 * table(spark, sf_dir, "lineitem").count(), "person").dropDuplicates(["person", "day", "competition"])
    after = F.collect_list("competition").over(Window.partitionBy("person").orderBy("day").rangeBetween(0, 2))
    met = p.withColumn("after", after).withColumn("other", F.explode("after")).where("competition <> other").select("person", F.least("competition", "other").alias("one"), F.greatest("competition", "other").alias("other"))
    common = met.dropDuplicates(["person", "one", "other"]).groupBy("one", "other").agg(F.count("*").alias("common")).where("common >= 2")
    df = common.join(field.toDF("one", "people_one"), "one").join(field.toDF("other", "people_other"), "other")
    return df.where(2 * F.col("common") >= F.least("people_one", "people_other"))


@R.add(using("SELECT a AS person, season FROM bout UNION SELECT b, season FROM bout", "bout"))
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir)
    return df.select(F.explode(F.array("a", "b")).alias("person"), "season").distinct()


@R.add(using("SELECT 'A' AS class, a AS person, count(*) AS n FROM bout GROUP BY a UNION ALL SELECT 'B', b, count(*) FROM bout GROUP BY b", "bout"))
def union_all_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir)
    one = lambda side, col: df.groupBy(F.col(col).alias("person")).agg(F.count("*").alias("n")).withColumn("class", F.lit(side))
    return one("A", "a").unionByName(one("B", "b"))


@R.add(using("SELECT competition, line, a, b FROM bout WHERE (competition, line, a, b) > (1000, 2, 3, 4) ORDER BY competition, line, a, b LIMIT 51", "bout"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor: all columns of the page are its key, since a competition's line may hold several bouts."""
    key = ["competition", "line", "a", "b"]
    after = F.struct(F.lit(1000).cast("long"), F.lit(2), F.lit(3).cast("long"), F.lit(4).cast("long"))
    return bouts(spark, sf_dir).where(F.struct(*key) > after).orderBy(*key).limit(51).select(*key)


@R.add(using(f"SELECT me, rival, bouts, ratio, rn FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY ratio DESC, wins DESC, rival) AS rn FROM (SELECT *, {RATE} AS ratio FROM g WHERE bouts >= 5 AND wins + losses > 0)) WHERE rn <= 3", "oriented", g=f"SELECT me, rival, {BALANCE} FROM oriented GROUP BY me, rival"))
def top_k_min_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = oriented(spark, sf_dir).groupBy("me", "rival").agg(*pairs.balance()).where("bouts >= 5 AND wins + losses > 0").withColumn("ratio", pairs.win_rate())
    return top_k(g, ["me"], [F.desc("ratio"), F.desc("wins"), "rival"], 3).select("me", "rival", "bouts", "ratio", "rn")


# Countries.

SIDES = """SELECT o.*, fm.country AS me_country, fr.country AS rival_country FROM oriented o JOIN fencer fm ON fm.id = o.me JOIN fencer fr ON fr.id = o.rival"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented bouts with both countries."""
    f = fencers(spark, sf_dir).select("id", "country")
    df = oriented(spark, sf_dir)
    return df.join(f.select(F.col("id").alias("me"), F.col("country").alias("me_country")), "me").join(f.select(F.col("id").alias("rival"), F.col("country").alias("rival_country")), "rival")


@R.add(using(f"SELECT me_country, season, phase, {BALANCE}, count(DISTINCT me) AS people, count(DISTINCT competition) AS competitions FROM s GROUP BY me_country, season, phase", "oriented", "fencer", s=SIDES))
def country_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).groupBy("me_country", "season", "phase").agg(*pairs.balance(), F.countDistinct("me").alias("people"), F.countDistinct("competition").alias("competitions"))


@R.add(using("SELECT coalesce(CAST(me_country AS VARCHAR), '') AS country, coalesce(season, '') AS season, coalesce(phase, '') AS phase, count(DISTINCT me) AS people FROM s GROUP BY CUBE (me_country, season, phase)", "oriented", "fencer", s=SIDES))
def country_distinct_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube with exact distinct counts; pairs are distinct before the cube multiplies them."""
    df = sides(spark, sf_dir).select("me_country", "season", "phase", "me").distinct().cube("me_country", "season", "phase").agg(F.countDistinct("me").alias("people"))
    return df.select(F.coalesce(F.col("me_country").cast("string"), F.lit("")).alias("country"), F.coalesce("season", F.lit("")).alias("season"), F.coalesce("phase", F.lit("")).alias("phase"), "people")


FORWARD = "SELECT * FROM s WHERE me_country < rival_country"


@R.add(using(f"SELECT competition, me_country AS one, rival_country AS other, {BALANCE}, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM f GROUP BY 1, 2, 3", "oriented", "fencer", s=SIDES, f=FORWARD))
def country_pair_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sides(spark, sf_dir).where("me_country < rival_country")
    out = df.groupBy("competition", F.col("me_country").alias("one"), F.col("rival_country").alias("other")).agg(*pairs.balance(), F.sort_array(F.collect_list("line")).alias("l"))
    return out.withColumn("lines", F.array_join(F.col("l").cast("array<string>"), ",")).drop("l")


@R.add(using(f"SELECT me_country AS one, rival_country AS other, {BALANCE} FROM s WHERE me_country <> rival_country GROUP BY 1, 2", "oriented", "fencer", s=SIDES))
def country_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orientations of a pair from one aggregate of its forward one."""
    df = sides(spark, sf_dir).where("me_country < rival_country").groupBy("me_country", "rival_country").agg(*pairs.balance())
    c = F.col
    fwd = F.struct(c("me_country").alias("one"), c("rival_country").alias("other"), "bouts", "wins", "losses", "undecided", "touches_for", "touches_against")
    bwd = F.struct(c("rival_country").alias("one"), c("me_country").alias("other"), c("bouts"), c("losses").alias("wins"), c("wins").alias("losses"), c("undecided"), c("touches_against").alias("touches_for"), c("touches_for").alias("touches_against"))
    return df.select(F.explode(F.array(fwd, bwd)).alias("x")).select("x.*")


@R.add(using(f"SELECT me, rival_country, coalesce(season, '') AS season, {BALANCE} FROM s GROUP BY GROUPING SETS ((me, rival_country, season), (me, rival_country))", "oriented", "fencer", s=SIDES))
def country_fencer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by season, and over seasons from those: bouts are not multiplied, and go to their person and country once."""
    narrow = sides(spark, sf_dir).select("me", "rival_country", "season", "favor", "contra").repartition("me", "rival_country")
    per = narrow.groupBy("me", "rival_country", "season").agg(*pairs.balance())
    own = [c for c in per.columns if c not in ("me", "rival_country", "season")]
    df = per.groupingSets([["me", "rival_country", "season"], ["me", "rival_country"]], "me", "rival_country", "season").agg(*[F.sum(c).alias(c) for c in own])
    return df.withColumn("season", F.coalesce("season", F.lit("")))


@R.add(using(f"SELECT coalesce(phase, '*') AS phase, coalesce(season, '*') AS season, {BALANCE} FROM s WHERE me_country = 1 AND rival_country = 3 GROUP BY GROUPING SETS ((), (phase), (season))", "oriented", "fencer", s=SIDES))
def country_duel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by phase and by season, and the grand total, which is there without any bout too."""
    duel = sides(spark, sf_dir).where("me_country = 1 AND rival_country = 3")
    df = duel.groupingSets([["phase"], ["season"]], "phase", "season").agg(*pairs.balance())
    df = df.unionByName(duel.agg(*pairs.balance()), allowMissingColumns=True)
    return df.withColumns({"phase": F.coalesce("phase", F.lit("*")), "season": F.coalesce("season", F.lit("*"))})


@R.add(using("SELECT me, wins, losses, 'best' AS side FROM (SELECT *, row_number() OVER (ORDER BY wins - losses DESC, me) AS n FROM g) WHERE n <= 3 UNION ALL SELECT me, wins, losses, 'worst' FROM (SELECT *, row_number() OVER (ORDER BY losses - wins DESC, me) AS n FROM g) WHERE n <= 3", "oriented", "fencer", s=SIDES, g=f"SELECT me, {BALANCE} FROM s WHERE me_country = 1 AND rival_country = 3 GROUP BY me"))
def country_duel_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sides(spark, sf_dir).where("me_country = 1 AND rival_country = 3").groupBy("me").agg(*pairs.balance())
    ends = [g.orderBy(F.desc(by), "me").limit(3).select("me", "wins", "losses", F.lit(side).alias("side")) for side, by in (("best", F.col("wins") - F.col("losses")), ("worst", F.col("losses") - F.col("wins")))]
    return ends[0].unionByName(ends[1])


@R.add(using("SELECT me, legs, matches, given, received, given - received AS index, rank() OVER (ORDER BY given - received DESC) AS rank FROM (SELECT me, count(*) AS legs, count(DISTINCT competition) AS matches, CAST(sum(favor) AS BIGINT) AS given, CAST(sum(contra) AS BIGINT) AS received FROM oriented WHERE line >= 4 GROUP BY me)", "oriented"))
def relay_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = oriented(spark, sf_dir).where("line >= 4").groupBy("me").agg(F.count("*").alias("legs"), F.countDistinct("competition").alias("matches"), F.sum("favor").cast("long").alias("given"), F.sum("contra").cast("long").alias("received"))
    df = df.withColumn("index", F.col("given") - F.col("received"))
    # Ranks are running sums over the different values of the index, not over people.
    order = Window.orderBy(F.desc("index")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = df.groupBy("index").agg(F.count("*").alias("n")).select("index", (F.coalesce(F.sum("n").over(order), F.lit(0)) + 1).cast("long").alias("rank"))
    return df.join(ranks, "index").select("me", "legs", "matches", "given", "received", "index", "rank")


@R.add(using("SELECT competition, me, spread FROM (SELECT competition, me, max(rival_country) OVER (PARTITION BY competition) AS spread, line, side FROM s) GROUP BY ALL", "oriented", "fencer", s=SIDES))
def partition_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of a competition with the greatest country of all: one aggregate of its bouts, no row a side."""
    f = fencers(spark, sf_dir).select("id", "country")
    df = bouts(spark, sf_dir).join(f.toDF("a", "country_a"), "a").join(f.toDF("b", "country_b"), "b")
    per = df.groupBy("competition").agg(F.max(F.greatest("country_a", "country_b")).alias("spread"), F.collect_set("a").alias("a"), F.collect_set("b").alias("b"))
    return per.select("competition", F.explode(F.array_union("a", "b")).alias("me"), "spread")


@R.add(using("""SELECT competition, CASE WHEN pools = 0 AND tableau = 0 THEN 'none' WHEN pools > 0 AND tableau > 0 THEN 'verified' WHEN tableau > 0 THEN 'partial' ELSE 'pending' END AS state, pools, tableau
    FROM (SELECT competition, count(*) FILTER (WHERE phase = 'POULE') AS pools, count(*) FILTER (WHERE phase = 'TABLEAU') AS tableau FROM bout GROUP BY competition)""", "bout"))
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir).groupBy("competition").agg(F.count_if(F.col("phase") == "POULE").alias("pools"), F.count_if(F.col("phase") == "TABLEAU").alias("tableau"))
    p, t = F.col("pools"), F.col("tableau")
    return df.withColumn("state", F.when((p == 0) & (t == 0), "none").when((p > 0) & (t > 0), "verified").when(t > 0, "partial").otherwise("pending"))
