"""The kept index of names: searches against plain Python, refresh against rebuild, the folders that are read."""

import random

from rostrum.operators import search_index as S

PEOPLE = "id long, root long, name string, weight double"


def people(seed, n=300):
    rng = random.Random(seed)
    words = ["garcia", "garcés", "lopez", "ana", "anabel", "martin", "martinez", "pérez", "paz", "de", "wu", "ibarra", "quesada"]
    return [(i, i - i % 7 if i % 3 == 0 else i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))).title(), float(rng.randint(0, 9))) for i in range(n)]


def tables(spark, path):
    return {name: sorted(map(tuple, S._read(spark, path, name).collect())) for name in S.SCHEMAS}


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) < 2 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def plain(rows, text, k):
    fold = lambda t: t.lower().translate(str.maketrans("áéíóúñ", "aeioun")).split()
    words = list(dict.fromkeys(fold(text)))
    best = {}
    for i, root, name, weight in rows:
        tokens = fold(name)
        fit = [max([3 if t == w else 2 if len(w) >= 3 and t.startswith(w) else 1 if len(w) > 3 and within_one(w, t) else 0 for t in tokens], default=0) for w in words]
        if words and min(fit) > 0:
            best[root] = max(best.get(root, (-1,)), (sum(fit), weight, -i, min(fit) == 3))
    order = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:k]
    return [(rank, root, -b[2], b[0], b[1], b[3]) for rank, (root, b) in enumerate(order, 1)]


def test_searches(spark, tmp_path):
    rows = people(3)
    path = str(tmp_path / "index")
    S.build(spark.createDataFrame(rows, PEOPLE), path)
    texts = ["garcia", "garcai lopez", "gar", "ga", "ana", "anab", "martin", "martinz ana", "Pérez PAZ", "wu", "nobody", "", "quesda", "de"]
    got = S.search(spark, path, spark.createDataFrame(list(enumerate(texts)), "query int, text string"), 6).collect()
    for q, text in enumerate(texts):
        assert sorted((r["rank"], r.root, r.id, r.score, r.weight, r.whole) for r in got if r.query == q) == plain(rows, text, 6), text
    assert len(got) > 40


def test_only_the_buckets_of_a_query_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    S.build(spark.createDataFrame(people(3), PEOPLE), path)
    few = S._read(spark, path, "tokens", [3, 5])
    assert {f.split("bucket=")[1].split("/")[0] for f in few.inputFiles()} == {"3", "5"} or "PartitionFilters: [bucket" in few._jdf.queryExecution().toString()


def test_refresh_is_rebuild(spark, tmp_path):
    """Renamed, new, gone and reweighted people; tokens that come, go and empty their bucket; a refresh that is run twice; none changed."""
    rng = random.Random(5)
    before = people(3)
    after = []
    for i, root, name, weight in before:
        chance = rng.random()
        if chance < 0.1:
            continue
        if chance < 0.2:
            name = name.replace("Lopez", "Zuloaga").replace("Wu", "") + rng.choice(["", " Xu", " Quintana"])
        after.append((i, root + (chance > 0.9), name, weight + (0.8 < chance < 0.85)))
    after = [r if "Ibarra" not in r[2] else (*r[:2], r[2].replace("Ibarra", "Yáñez"), r[3]) for r in after] + [(1000 + i, 1000, "Nueva Persona", 1.0) for i in range(3)]
    changed = {r[0] for r in set(before) ^ set(after)}
    kept, rebuilt = str(tmp_path / "kept"), str(tmp_path / "rebuilt")
    S.build(spark.createDataFrame(before, PEOPLE), kept)
    S.build(spark.createDataFrame(after, PEOPLE), rebuilt)
    want = tables(spark, rebuilt)
    now, ids = spark.createDataFrame(after, PEOPLE), spark.createDataFrame([(i,) for i in changed], "id long")
    assert tables(spark, kept) != want
    for _ in range(2):
        S.refresh(now, ids, kept)
        assert tables(spark, kept) == want
    S.refresh(now, ids.limit(0), kept)
    assert tables(spark, kept) == want
