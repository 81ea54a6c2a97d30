"""What the third round's findings showed: joins that must not broadcast what explode makes, ties, whole jobs."""

import re

import pytest
from pyspark.sql import functions as F

from rostrum.operators import evidence, phrases
from rostrum.plans import calendar, results, stewardship


def broadcasts(df, node="Generate"):
    """Subtrees of df's plan that are broadcast and hold a node."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    deep = [len(re.match(r"[\s:+\-|*]*", x).group()) for x in lines]
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if deep[j] <= deep[k]), len(lines))
            found += [x for x in lines[k + 1 : end] if node in x]
    return found


@pytest.fixture
def kept(monkeypatch):
    """All frames that the operators write."""
    frames = []

    def keep(module):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name: frames.append(df) or real(df, name))
        return frames

    return keep


def test_deletions_are_not_broadcast(spark, kept):
    frames = kept(stewardship)
    left = spark.createDataFrame([(k, 1, f"name{100_000 + k * 1001}") for k in range(30)], "l long, country int, ln string").withColumn("ln", F.concat("ln", F.lit("x")))
    right = left.toDF("r", "country", "rn")
    out = stewardship.unique_names(left, right)
    assert out.count() == 30
    for df in [*frames, out]:
        assert not broadcasts(df)


def test_words_are_not_broadcast(spark, tmp_path):
    """Names that hold a shorter one meet without a broadcast of their words."""
    spark.createDataFrame([([f"a{k}", "b"],) for k in range(5)] + [(["b"],)], "words array<string>").write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    out = evidence.fuller(names)
    assert sorted(r.more[0] for r in out.collect()) == [f"a{k}" for k in range(5)]
    assert not broadcasts(out)


@pytest.mark.parametrize("letters", [1_000_000, 0])
def test_runs_are_not_broadcast(spark, kept, monkeypatch, letters):
    """Phrases that look larger than the texts do not make the texts' runs the side that is sent."""
    frames = kept(phrases)
    monkeypatch.setattr(phrases, "SMALL", letters)
    texts = spark.createDataFrame([(1, ["red", "ring"]), (2, ["ring"])], "id long, t array<string>")
    known = spark.createDataFrame([("red ring", "redring")] + [(f"phrase {k}", "x" * 99) for k in range(200)], "phrase string, means string")
    out = phrases.terms(texts, "id", "t", known)
    assert {r.id: r.words for r in out.collect()} == {1: ["redring"], 2: ["ring"]}
    assert not [x for df in [*frames, out] for x in broadcasts(df)]


def orders(spark, path, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string, o_orderpriority string").withColumn("o_orderdate", F.col("day").cast("timestamp")).drop("day").write.parquet(str(path / "orders.parquet"))


def test_one_row_of_a_tie_is_the_best_place(spark, tmp_path):
    """Many rows of one person in one competition, the best of them neither first nor last."""
    orders(spark, tmp_path, [(k, 7, "F", float(k * 37 % 101), "1998-02-06", "5-LOW") for k in range(101)])
    assert [tuple(r) for r in results.one_row_per_equivalence(spark, str(tmp_path)).collect()] == [("199802-5", 7, 1)]


def test_identifiers_are_shared_by_many(spark, tmp_path):
    """Sixty identifiers: as many people to each as the table has, not two."""
    spark.createDataFrame([(k, f"s{k}", 1, 0.0) for k in range(300)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = calendar.id_conflicts(spark, str(tmp_path))
    assert got.where("one % 60 <> other % 60 OR CAST(value AS int) <> one % 60").isEmpty()
    assert got.count() > 300


def test_spread_keeps_no_row_a_side(spark):
    """One row a competition is shuffled, and no window sorts all sides."""
    from rostrum.plans import bouts

    plan = bouts.partition_spread(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_recommendations_shuffle_no_pairs(spark):
    """Competitions send lists: no aggregate by pair, no join that makes pairs."""
    plan = calendar.recommendations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[me#\d+L?, other#", plan)
    assert not re.search(r"Exchange hashpartitioning\(me#\d+L?, other#", plan)


def test_recommendations_of_odd_bouts(spark):
    """Bouts without a competition count for those who share another one; unknown people and countries are no match."""
    from rostrum.operators import acquaintances

    people = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 2), (5, None)], "id long, country int")
    rows = [(10, 1, 2), (10, 1, 2), (10, 3, 9), (11, 1, 3), (11, 4, 5), (None, 1, 4), (None, 2, 5), (None, 9, 1)]
    met = acquaintances.lists(spark.createDataFrame(rows, "competition long, a long, b long"), people, "competition")
    got = {}
    for r in sorted(acquaintances.closest(met, 3, 5, 10).collect(), key=lambda r: (r.me, r.rn)):
        got.setdefault(r.me, []).append((r.other, r.score))
    assert got == {1: [(2, 21), (3, 7), (4, 6)], 2: [(1, 21), (3, 1)], 3: [(1, 7), (2, 1), (4, 1)], 4: [(1, 6), (5, 6), (3, 1)], 5: [(4, 6), (1, 1), (3, 1)]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_read_by_batches(spark):
    """Texts go to Python by batches, without a table function's call a text, and none comes back beside its rows."""
    from rostrum.plans import readings

    plan = plan_of(readings.native_records(spark, "/root/testdata/sf0.001"))
    assert "UDTF" not in plan
    assert re.search(r"MapInArrow read\([^)]*\)[^,]*, \[competition#\d+L?, kind#", plan)


def test_parsed_as_scanned():
    """Random texts of marks, quotes, comments and words against one scan by a pattern."""
    import random

    from rostrum.sources import records

    def scanned(text):
        top, open_ = [], []
        open_.append(("", top))
        for m in records._TOKEN.finditer(text):
            quoted, mark, word = m.groups()
            if mark in records._CLOSES:
                open_.append((mark, []))
            elif mark:
                kind, values = open_.pop()
                if records._CLOSES.get(kind) != mark or not open_:
                    return f"{mark} at {m.start()} closes nothing"
                if kind == "{":
                    values = {k[0]: k[1] if len(k) == 2 else k[1:] for k in values if isinstance(k, list) and k and isinstance(k[0], str)}
                open_[-1][1].append(values)
            elif quoted is not None or word:
                open_[-1][1].append(word if quoted is None else quoted)
        return "a bracket is left open" if len(open_) > 1 else [r for r in top if isinstance(r, dict)]

    chance, right = random.Random(3), 0
    for _ in range(20_000):
        text = "".join(chance.choice(["{", "}", "[", "]", "(", ")", "[a ", "{[k 1]}", ' "x;\n[" ', '"', "\n;c \"}\n", ";", "\n", " ", "w", "é "]) for _ in range(chance.randrange(9)))
        try:
            got = records.parsed(text)
            right += bool(got)
        except ValueError as e:
            got = str(e)
        assert got == scanned(text), text
    assert right > 100


def test_names_are_scored_once_a_word(spark, tmp_path, monkeypatch):
    """Scores are made of the different words and written: no filter on them is worked out for every name's words."""
    from rostrum.plans import people

    frames = []
    real = people.written
    monkeypatch.setattr(people, "written", lambda df, name: frames.append((name, df)) or real(df, name))
    out = people.name_search(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in frames] == ["words", "scored"]
    assert "levenshtein" not in plan_of(out)


def test_null_keys_are_spread(spark):
    """Rows that have no key of a level are not all in one task's part."""
    from rostrum.operators import linking

    rows = spark.range(20_000).select(F.col("id").alias("fact"), F.when(F.col("id") % 10 == 0, F.col("id")).cast("string").alias("licence"))
    people = spark.range(0, 20_000, 20).select(F.col("id").cast("string").alias("licence"), F.col("id").alias("person"))
    aqe, size = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = linking.link_by_levels(rows, people, "person", {"licence": ["licence"]})
        largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert out.where("reason = 'linked'").count() == 1000 and out.where("reason = 'none'").count() == 19_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert largest < 4000


def test_columns_need_no_join(spark):
    """A page's columns come from one window over its cells; words are not read twice."""
    from rostrum.plans import readings

    plan = plan_of(readings.printed_rankings(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan
    assert plan.count("orders.parquet") == 2


def test_parts_grow_with_the_rows(spark):
    """Parts of a shuffle are as many as the rows need, not as many as the session has."""
    from rostrum.operators.storage import divided

    df = spark.range(10)
    assert divided(df, 10, "id").rdd.getNumPartitions() == 8
    assert divided(df, 101, "id", each=10).rdd.getNumPartitions() == 11


def test_overlaps_make_no_join_of_people(spark):
    """Pairs come from one window over a person's days; only fields are joined."""
    from rostrum.plans import bouts

    plan = plan_of(bouts.overlap_pairs(spark, "/root/testdata/sf0.001"))
    assert "RangeFrame" in plan
    assert not re.search(r"Join \[person", plan)


def test_readings_are_dealt_once(spark):
    """All windows of encounters work on the parts that were made for the table's size."""
    from rostrum.plans import people

    df = people.encounter_groups(spark, "/root/testdata/sf0.001")
    assert plan_of(df).count("REPARTITION_BY_NUM") == 1
    assert plan_of(df).count("Exchange hashpartitioning") == 1


def test_rollup_does_not_multiply_bouts(spark):
    """Only sums by season are expanded."""
    from rostrum.plans import bouts

    plan = plan_of(bouts.country_fencer_rollup(spark, "/root/testdata/sf0.001"))
    below = plan[plan.index("Expand") :]
    assert "HashAggregate" in below[: below.index("Exchange")]


def test_lists_sort_few_rivals(spark):
    """The three lists are sorted after all but five rivals of each balance are gone, and people are dealt once."""
    from rostrum.plans import bouts

    df = bouts.rivals_by_scope(spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in plan_of(df)
    assert plan_of(df).count("Exchange hashpartitioning") <= 2
