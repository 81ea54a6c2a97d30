"""The staged unification of people against a plain version, on planted, random and table rows."""

import datetime
import random
from collections import defaultdict

from rostrum.operators import evidence
from rostrum.plans.people import evidence_rows

PEOPLE = "id long, official string, licence string, words array<string>, gender string, birth date"
FACTS = "id long, competition string, weapon string, club string, year int, low int, high int"


def plain(people, facts):
    """{id: (root, stage)} by loops over all pairs."""
    root = {p[0]: p[0] for p in people}
    stage = dict.fromkeys(root)

    def profiles():
        out = {}
        for r in set(root.values()):
            mine = [p for p in people if root[p[0]] == r]
            seen = [f for f in facts if root.get(f[0]) == r]
            words = max((len(w), w) for w in (sorted({x for x in p[3] or [] if x}) for p in mine))[1]
            least = lambda i, rows=mine: min((x[i] for x in rows if x[i] is not None), default=None)
            out[r] = {
                "official": least(1), "licences": {p[2] for p in mine if p[2] is not None}, "words": tuple(words), "gender": least(4), "birth": least(5),
                "comps": {f[1] for f in seen}, "weapons": {f[2] for f in seen}, "clubs": {(f[3], f[4]) for f in seen if f[3] is not None and f[4] is not None},
                "first": least(4, seen), "last": max((f[4] for f in seen), default=None), "low": max((f[5] for f in seen if f[5] is not None), default=None), "high": least(6, seen),
            }
        return out

    shorter = lambda x, y: set(x["words"]) < set(y["words"])

    def licence(now):
        return [(a, b) for a, x in now.items() for b, y in now.items() if a < b and x["licences"] & y["licences"] and x["words"] and x["words"] == y["words"] and x["gender"] == y["gender"]]

    def birth(now):
        key = lambda x: (x["birth"], x["gender"])
        known = {a: x for a, x in now.items() if None not in key(x) and x["words"]}
        edges = [(a, b) for a, x in known.items() for b, y in known.items() if a < b and key(x) == key(y) and x["words"] == y["words"]]
        for a, x in known.items():
            more = {y["words"] for y in known.values() if key(x) == key(y) and shorter(x, y)}
            if len(more) == 1:
                edges += [(a, b) for b, y in known.items() if key(x) == key(y) and y["words"] in more]
        return edges

    def name(now):
        world = {a: x for a, x in now.items() if x["words"] and x["gender"] and x["official"]}
        home = {a: x for a, x in now.items() if x["words"] and x["gender"] and not x["official"] and x["licences"]}
        pairs = [(a, b) for a, x in world.items() for b, y in home.items() if x["gender"] == y["gender"] and (set(x["words"]) <= set(y["words"]) or shorter(y, x))]
        return [(a, b) for a, b in pairs if sum(p[0] == a for p in pairs) == 1 and sum(p[1] == b for p in pairs) == 1]

    def contradict(x, y):
        differ = any(x[c] and y[c] and x[c] != y[c] for c in ("gender", "official"))
        far = bool(x["birth"] and y["birth"]) and abs(x["birth"].year - y["birth"].year) > 1
        lows, highs = [v for v in (x["low"], y["low"]) if v is not None], [v for v in (x["high"], y["high"]) if v is not None]
        return differ or far or bool(lows and highs and max(lows) > min(highs))

    def by_results(now):
        edges = []
        for a, x in now.items():
            if x["official"] or x["licences"] or not x["words"]:
                continue
            candidates = {b: y for b, y in now.items() if shorter(x, y)}

            def speaks(y, x=x):
                club = any(c == d and abs(i - j) <= 1 for c, i in x["clubs"] for d, j in y["clubs"])
                career = club and x["first"] >= y["first"] - 1 and x["last"] <= y["last"] + 1
                return club and career and x["weapons"] & y["weapons"] and not contradict(x, y)

            def shares(y, x=x):
                return any(c == d and abs(i - j) <= 1 for c, i in x["clubs"] for d, j in y["clubs"])

            spoken = [b for b, y in candidates.items() if speaks(y) and not x["comps"] & y["comps"]]
            if len(spoken) != 1:
                continue

            def ruled_out(y, x=x, one=now[spoken[0]]):
                near = [d for d, j in y["clubs"] if any(abs(i - j) <= 1 for _, i in x["clubs"])]
                return contradict(x, y) or bool(near) and not set(near) & {c for c, _ in x["clubs"]} or shorter(y, one)

            if all(ruled_out(y) for b, y in candidates.items() if b != spoken[0]):
                edges.append((a, spoken[0]))
        return edges

    for title, edges in (("licence", licence), ("birth", birth), ("name", name), ("results", by_results)):
        now = profiles()
        group = {a: {a} for a in now}
        for a, b in edges(now):
            both = group[a] | group[b]
            for c in both:
                group[c] = both
        for a in now:
            values = lambda c, a=a: {now[b][c] for b in group[a]} - {None}
            years = {d.year for d in values("birth")}
            if len(values("gender")) <= 1 and len(values("official")) <= 1 and (not years or max(years) - min(years) <= 1):
                to = min(group[a])
                if to != a:
                    for i in root:
                        if root[i] == a:
                            root[i], stage[i] = to, title
    return {i: (root[i], stage[i]) for i in root}


def found(spark, people, facts):
    got = evidence.united(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(facts, FACTS))
    assert got.columns == ["id", "root", "stage"]
    return {r.id: (r.root, r.stage) for r in got.collect()}


def test_planted(spark):
    day = datetime.date(1990, 5, 4)
    people = [
        (1, "W1", None, ["ruiz", "ana", "maria"], "F", None), (2, None, "L1", ["ruiz", "ana"], "F", None), (3, None, "L1", ["ana", "ruiz"], "F", None),
        (4, None, None, ["ruiz"], "F", None), (5, None, "L2", ["ruiz", "eva"], "F", None),
        (6, None, None, ["sol", "luz"], "F", day), (7, None, None, ["luz"], "F", day), (8, None, None, ["luz"], "M", day),
        (9, "W9", None, ["mar", "leo"], "M", day), (10, None, "L9", ["mar", "leo"], "M", datetime.date(1994, 1, 1)),
        (11, None, "L4", ["gil", "pau"], "M", None), (12, None, "L5", ["gil", "teo"], "M", None), (13, None, None, ["gil"], None, None),
        (14, None, None, None, None, None), (15, None, None, [], "F", day), (16, None, None, ["", None], "F", day),
    ]
    facts = [
        (2, "c1", "ESPADA", "AT", 2010, None, None), (3, "c2", "ESPADA", "AT", 2012, None, None), (4, "c3", "ESPADA", "AT", 2011, None, None), (5, "c3", "ESPADA", "BB", 2011, None, None),
        (11, "c4", "SABLE", "AT", 2010, None, None), (12, "c5", "SABLE", "AT", 2010, None, None), (13, "c6", "SABLE", "AT", 2010, None, None), (99, "c6", None, None, None, None, None), (14, None, None, None, None, None, None),
    ]
    got = found(spark, people, facts)
    assert got == plain(people, facts)
    assert {k for k, v in got.items() if v[0] == 1} == {1, 2, 3, 4} and got[4] == (1, "results") and got[3] == (1, "name")
    assert got[7] == (6, "birth") and got[8] == (8, None)
    assert got[10] == (10, None), "four years apart"
    assert got[13] == (13, None), "two of one club and weapon"
    assert found(spark, [], []) == {} and set(found(spark, people, []).values()) >= {(1, "name"), (6, "birth")}


def test_random(spark):
    stages = set()
    for seed in (5,):
        rng = random.Random(seed)
        pick = lambda *values: rng.choice(values)
        people = [
            (k, f"W{k}" if rng.random() < 0.25 else None, f"L{rng.randrange(12)}" if rng.random() < 0.35 else None, rng.sample(["hot", f"s{rng.randrange(9)}", pick("ana", "eva"), pick("x", "y", "z")], rng.randrange(1, 4)),
             pick("F", "F", "M", None), datetime.date(pick(1990, 1991, 1995), 1, 1) if rng.random() < 0.3 else None)
            for k in range(70)
        ] + [(k, None, "L99", ["only", "pair"], None, None) for k in (70, 71)]
        facts = [(rng.randrange(75), f"c{rng.randrange(60)}", pick("ESPADA", "SABLE"), pick("AT", "BB", "CC", None), rng.randrange(2008, 2014), pick(None, None, 1985), pick(None, None, 1999)) for _ in range(140)]
        got = found(spark, people, facts)
        assert got == plain(people, facts)
        stages |= {s for _, s in got.values()}
    assert stages == {None, "licence", "birth", "name", "results"}


def test_tables(spark):
    """The query's own rows: every stage unites some, and all as the plain version does."""
    people, facts = evidence_rows(spark, "/root/testdata/sf0.001")
    got = {r.id: (r.root, r.stage) for r in evidence.united(people, facts).collect()}
    assert got == plain([tuple(r) for r in people.collect()], [tuple(r) for r in facts.collect()])
    count = defaultdict(int)
    for _, s in got.values():
        count[s] += 1
    assert {"birth", "name"} <= set(count)  # cards of one licence are united by their names once more
