"""Sinks, streams, dates and word distances against plain Python or their batch twins."""

import datetime
import random

from pyspark.sql import functions as F

from rostrum.functions import dates, ical, names, points, text, udfs
from rostrum.operators import bracket, joins, numbering, pairs, repair, storage, upkeep
from rostrum.plans import catalogue
from rostrum.sources import readers
from rostrum.sources.adapter import observations, table
from rostrum.streaming import outbox

SF = "/root/testdata/sf0.001"


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.partitionBy("k").parquet(path)
    storage.replace_partitions(spark.createDataFrame([(1, "new")], "v_k int, v string").withColumnRenamed("v_k", "k"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "c")]


def test_csv_is_safe_and_reads_back(spark, tmp_path):
    rows = [("=1+1", 1), ('quo"te, and comma', 2), ("plain", 3)]
    storage.write_csv(spark.createDataFrame(rows, "t string, n int"), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert sorted((r.t, int(r.n)) for r in back) == sorted([("'=1+1", 1), *rows[1:]])


def test_numbers_in_order(spark):
    rows = [(i, random.Random(i).choice(["same", "other", "third"])) for i in range(500)]
    got = numbering.numbered_in_order(spark.createDataFrame(rows, "i int, s string").repartition(7), [F.desc("s"), "i"]).collect()
    want = sorted(rows, key=lambda r: r[0])
    want.sort(key=lambda r: r[1], reverse=True)
    assert [r.i for r in sorted(got, key=lambda r: r.rn)] == [i for i, _ in want] and sorted(r.rn for r in got) == list(range(1, 501))


def test_osa():
    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for most in (1, 2, 9):
            n = plain(a, b)
            assert udfs.osa_within(a, b, most) == (n if n <= most else -1)


def test_local_time_over_daylight_saving(spark):
    days = [(datetime.date(2024, 3, 30),), (datetime.date(2024, 3, 31),), (datetime.date(2024, 10, 26),), (datetime.date(2024, 10, 27),)]
    got = [r.t for r in spark.createDataFrame(days, "d date").select(F.date_format(dates.local_instant(F.col("d")), "dd HH:mm").alias("t")).collect()]
    assert got == ["30 22:59", "31 21:59", "26 21:59", "27 22:59"]


def test_small_columns(spark):
    one = spark.createDataFrame([(100.0, 0.5, "a")], "p double, s double, k string")
    row = one.select(points.carried(F.col("p"), F.col("s")).alias("c"), points.carried(F.lit(None).cast("double"), F.col("s")).alias("n"), points.most_specific(F.create_map(F.lit("b"), F.lit(2)), F.col("k"), F.lit("b")).alias("m")).first()
    assert tuple(row) == (50.0, None, 2)
    d = lambda x: F.lit(x).cast("date")
    assert tuple(one.select(joins.valid_on(d("2024-02-01"), d("2024-01-01"), d(None)).alias("a"), joins.valid_on(d("2024-02-01"), d("2024-01-01"), d("2024-01-31")).alias("b")).first()) == (True, False)
    assert one.select(udfs.decomposed(F.lit("\u0141\u00f3d\u017a \ufb01")).alias("t")).first().t == "\u0141odz fi"
    copies = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (2, 9)], "e int, copy int")
    assert sorted(r.copy for r in pairs.canonical_copy(copies, ["e"], "copy").collect()) == [3, 3, 9]


def test_streams_equal_their_batch_twins(spark):
    ev = table(spark, SF, "events")
    first = catalogue.QUERIES["stream_dedupe"](spark, SF).collect()
    keys = observations(spark, SF).select("person", "source", "k").distinct().count()
    assert keys <= len(first) <= ev.count() and len({r.event_id for r in first}) == len(first)
    seen = {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in catalogue.QUERIES["stream_tumbling"](spark, SF).collect()}
    twin = {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in ev.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total").collect()}
    assert seen and all(twin[k] == v for k, v in seen.items())
    last = max(k[0] for k in twin)
    assert all(k in seen for k in twin if k[0] < last - datetime.timedelta(days=3))
    sessions = {(r.user_id, r.start): (r.end, r.n) for r in catalogue.QUERIES["stream_session"](spark, SF).collect()}
    batch = {(r.user_id, r.w.start): (r.w.end, r.n) for r in ev.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).collect()}
    assert sessions and all(batch[k] == v for k, v in sessions.items())


def test_first_and_last_seen_and_delivery(spark, tmp_path):
    ev = table(spark, SF, "events")
    q = outbox.first_last_seen(outbox.events(spark, SF).select("user_id", "ts"))
    states = []
    q.writeStream.outputMode("update").foreachBatch(lambda df, _: states.extend(df.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    want = {r.user_id: (r.first, r.last, r.n) for r in ev.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).collect()}
    assert {r.user_id: (r["first"], r["last"], r["n"]) for r in states} == want
    out = str(tmp_path / "out")
    stream = outbox.events(spark, SF)
    outbox.deliver(stream, out, str(tmp_path / "p"))
    # A second run from the same progress delivers nothing twice.
    outbox.deliver(stream, out, str(tmp_path / "p"))
    assert spark.read.parquet(out).count() == ev.count()


def test_fact_files(spark, tmp_path):
    import json

    good = {"version": 1, "source": "x", "competition": {"competitionKey": "c1"}, "status": {"results": "complete", "pools": "partial", "tableau": "unreadable"}, "results": [{"place": 1, "name": "A"}, {"place": None, "name": "B"}], "bouts": [{"round": "A4", "a": "A", "b": "B", "scoreA": 5, "scoreB": 3}, {"round": "P1", "a": "A", "b": "B", "scoreA": 4, "scoreB": 3}]}
    bad = [{**good, "version": 2}, {"version": 1, "results": []}]
    for i, f in enumerate([good, {**good, "competition": {"competitionKey": "c2"}, "results": [], "bouts": None}, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(f, indent=1))
    found, fought, refused = readers.read_facts(spark, str(tmp_path))
    assert [(r.competition, r.status, r.pos, r.place, r.name) for r in found.orderBy("pos").collect()] == [("c1", "complete", 0, 1, "A"), ("c1", "complete", 1, None, "B")]
    assert [(r.competition, r.status, r["round"], r.scoreA) for r in fought.orderBy("pos").collect()] == [("c1", "unreadable", "A4", 5), ("c1", "partial", "P1", 4)]
    assert sorted(r.file[-6:] for r in refused.collect()) == ["2.json", "3.json"]


def test_similarity_of_written_words(spark):
    """Every kind of likeness, by the SQL of the rule."""
    import duckdb

    from rostrum.plans import texts

    sql = f"SELECT a, b, {texts.SIMILARITY_SQL} FROM (SELECT a, b, {texts.phonetic_sql('a')} AS x, {texts.phonetic_sql('b')} AS y FROM {texts.PAIR_SQL})"
    want = {(a, b): s for a, b, s in duckdb.sql(sql).fetchall()}
    got = {(r.a, r.b): r.s for r in spark.createDataFrame(texts.PAIRS, "a string, b string").withColumn("s", text.similarity(F.col("a"), F.col("b"))).collect()}
    assert got == want and len(set(want.values())) > 6


def test_spanish_order(spark, tmp_path):
    """ñ after n, accents as their letters, case last."""
    order = ["ábaco", "Ana", "árbol", "nube", "nunca", "ñame", "ñoño", "ola", "zeta", "Zúñiga"]
    rows = [(k, n, 1, 0.0, "") for k, n in enumerate(random.Random(1).sample(order, len(order)))] + [(99, "nube", 1, 0.0, "")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = [(r.c_name, r.c_custkey) for r in catalogue.QUERIES["spanish_sort"](spark, str(tmp_path)).collect()]
    assert [n for n, _ in got if n != "nube"] == [n for n in order if n != "nube"]
    assert [n for n, _ in got][3:5] == ["nube", "nube"] and got[3][1] < 99 == got[4][1]


def test_fuzzy_editions(spark, tmp_path):
    """Names by the worst of the query's words, against plain Python."""
    rows = [(k, n, "b", "t", s, 1.0) for k, (n, s) in enumerate([("wrld", 1), ("world open", 0), ("Wörld", 6), ("wrldcup", 5), ("", 0), ("wxyz", 6), ("cups", 2), ("wlrd", 18)])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    ends = ("World Cup", "Championship 1999", "Satellite III", "Open U17", "Grand Prix", "Trophy")

    def score(query, word):
        most = 0 if len(query) <= 3 else 1 if len(query) <= 6 else 2
        return 3 if word == query else 2 if word.startswith(query) else 1 if udfs.osa_within(query, word, most) >= 0 else 0

    want = {}
    for k, n, _, _, s, _ in rows:
        words = f"{n} {ends[s % 6]}".lower().replace("ö", "o").split()
        worst = min(max(score(q, w) for w in words) for q in ("wrld", "cup"))
        if worst:
            want[k] = worst
    assert {r.p_partkey: r.score for r in catalogue.QUERIES["fuzzy_edition_search"](spark, str(tmp_path)).collect()} == want and len(want) > 2


def test_csv_and_html(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;n\n"Gil; ""El"" \nAna";1\nLeón;\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "name string, n int", ";").collect()] == [('Gil; "El" \nAna', 1), ("León", None)]
    html = "<table><tr><th>Day<th></tr>\n<TR class='x'><td><b>1</b> May</td><td></td></TR></table>"
    rows = readers.html_table(spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string"), "html").select("id", "pos", "cells").collect()
    assert [(r.id, r.pos, r.cells) for r in rows if r.pos == 2] == [(1, 2, ["1 May", ""])] and {r.id for r in rows} == {1}
    assert readers.struct_list(spark, "no list", "a int").count() == 0


def test_calendar_text(spark):
    texts = ["short", "a" * 75, "b" * 76, "c" * 223, "ñ" * 38, "\U0001f3c5" * 40, ""]
    for t, f in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ical.folded(F.col("t"))).collect():
        lines = f.split("\r\n")
        assert all(len(x.encode()) <= 75 for x in lines) and lines[0] + "".join(x[1:] for x in lines[1:]) == t and all(x[0] == " " for x in lines[1:])
    assert spark.range(1).select(ical.escaped(F.lit("a,b;c\\d\r\ne\nf")).alias("t")).first().t == "a\\,b\\;c\\\\d\\ne\\nf"


def test_bracket_of_odd_rounds(spark):
    """Two bouts with one winner, a bout that leads nowhere, a bracket without its final, no rows."""
    rows = [(1, 2, 7, 8, 7, 1), (1, 4, 8, 5, 8, 1), (1, 4, 7, 6, 7, 2), (1, 4, 7, 9, 7, 3), (1, 4, 3, 4, 3, 4), (2, 8, 1, 2, 1, 5), (2, 8, 3, 4, 4, 6), (2, 16, 9, 4, 4, 1), (2, 16, 1, 8, 1, 2)]
    df = spark.createDataFrame(rows, "c int, size int, a int, b int, winner int, number int")
    got = sorted((r.c, r["size"], r.seat, r.number) for r in bracket.ordered(df, ["c"]).collect())
    assert got == [(1, 2, 1, 1), (1, 4, 1, 2), (1, 4, 2, 1), (1, 4, 3, 3), (1, 4, 4, 4), (2, 8, 1, 5), (2, 8, 2, 6), (2, 16, 1, 2), (2, 16, 2, 1)]
    assert bracket.ordered(df.limit(0), ["c"]).count() == 0


def test_letters_and_encodings(spark):
    d = spark.createDataFrame([("nu?ez",), ("?",), ("g?l",), ("whole",), (None,)], "t string")
    words = spark.createDataFrame([("nunez",), ("gil",), ("gal",), ("",)], "w string")
    assert sorted((r.t, r.candidates, r.repaired) for r in repair.lost_letters(d, "t", words, "w").collect()) == [("g?l", 2, None), ("nu?ez", 1, "nunez")]
    rows = [("Nuñez".encode().decode("latin-1"),), ("Nuñez",), ("Ã Ł",), ("plain",), (None,), ("",)]
    assert [r.t for r in spark.createDataFrame(rows, "t string").select(text.unmangled(F.col("t")).alias("t")).collect()] == ["Nuñez", "Nuñez", "Ã Ł", "plain", None, ""]


def test_inbox_and_marks(spark):
    stored = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, None, False), (4, "z", True)], "k int, content string, read boolean")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "n")], "k int, content string")
    got = sorted(tuple(r) for r in upkeep.deliver(stored, new, ["k"], "content", "read").collect())
    assert got == [(1, "a", "unchanged", True), (2, "b", "updated", False), (3, None, "unchanged", False), (4, "z", "kept", True), (5, "n", "new", False)]
    again = upkeep.deliver(stored, stored.select("k", "content"), ["k"], "content", "read")
    assert {r.state for r in again.collect()} == {"unchanged"}
    marked = spark.createDataFrame([(1, None), (2, 7), (3, 7)], "k int, gone int")
    out = upkeep.mark_missing(marked, spark.createDataFrame([(3,), (3,)], "k int"), ["k"], F.lit(9), "gone")
    assert sorted((r.k, r.gone) for r in out.select("k", "gone").collect() if r.gone) == [(1, 9), (2, 7)] and out.count() == 3


def test_chunks_add_up_to_one_pass(spark):
    """An aggregate made in twelve parts by the season's year is that of one pass."""
    from rostrum.plans.bouts import oriented

    o = oriented(spark, SF)
    once = lambda df: df.groupBy("me", "season").agg(*pairs.balance())
    part = F.substring("season", 1, 4).cast("int") % 12
    chunks = None
    for i in range(12):
        own = once(o.where(part == i))
        chunks = own if chunks is None else chunks.unionByName(own)
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, once(o).collect()))


def test_name_relations(spark):
    cases = [
        ("perez gil", "ana", "perez gil", "ana", "same"), ("perez", "ana", "perez gil", "ana", "clipped"), ("perez gil", "enri", "perez gil", "enrique", "clipped"),
        ("perez gil", "ana maria", "perez gil", "maria", "compound"), ("fernandez gil", "ana", "fernandes gil", "ana", "variant"), ("gil", "ana", "gal", "ana", "different"),
        ("perez gil", "ana", "gil perez", "ana", "crossed"), ("perez gil", "ana", "perez ruiz", "ana", "cousins"), ("perez gil", "ana", "perez gil", "juan", "siblings"),
        ("perez gil", "luis", "perez gil", "luisa", "clipped"), ("fernandez", "ramon", "fernandes", "ramin", "different"), ("perez", "ana", "ruiz", "juan", "different"), ("", "", "perez", "ana", "different"), (None, "ana", "perez", "ana", None),
    ]
    parts = [F.filter(F.split(c, " "), lambda w: w != "") for c in ("s", "g", "t", "h")]
    df = spark.createDataFrame(cases, "s string, g string, t string, h string, want string").withColumn("got", names.relation(*parts))
    assert [(r.s, r.h, r.got) for r in df.collect() if r.got != r.want] == []
    swapped = df.withColumn("back", names.relation(parts[2], parts[3], parts[0], parts[1]))
    assert swapped.where("NOT back <=> got").count() == 0
    assert df.select(names.union_level(F.col("got")).alias("u")).distinct().count() == 5
