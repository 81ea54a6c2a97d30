"""Events: components, chains, greedy chains of sources, weekend blocks, links by containment, bouts of several pages, fused copies; each against plain Python."""

import datetime
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rostrum.functions.text import edition_base
from rostrum.operators import clusters, event_links, joins
from rostrum.operators.fusion import fused

DAY0 = datetime.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + datetime.timedelta(days=n)


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    """Random graphs, a long chain, a hub, loops, repeated and null edges."""
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 - i) for i in range(1, 90)] + [(7, 7), (9999, 9999), (3, 4), (4, 3)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in clusters.components(spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")).collect()}
    want = Union({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    assert got == {i: want.root(i) for i in want.up}
    assert clusters.components(spark.createDataFrame([], "a long, b long")).collect() == []


def editions(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randint(0, 60)
        stop = None if start is None or rng.random() < 0.1 else start + rng.choice([-2, 0, 0, 1, 2, 5])
        source = rng.choice(["fie", "rfee_pdf", "skermo_rfee", "engarde"])
        cats = rng.choice([[], ["M17"], ["M20"], ["M17", "M20"], ["M17", "M20", "ABS"]])
        out.append((f"e{i:04}", source, rng.choice(["2023-2024", "2024-2025"]), rng.choice(["cup", "open", "trofeo"]), rng.choice(["x", "y", None]), day(start), day(stop), rng.choice([None] * 12 + ["ev1", "ev2", "ev3"]), cats))
    return out


def grouped(rows):
    """The three steps one edition after another, the least edition as the root."""
    national = {"rfee_pdf", "skermo_rfee", "engarde"}
    of, by_event, by_key = Union([r[0] for r in rows]), {}, defaultdict(list)
    for r in sorted(rows):
        if r[7]:
            k = ("national" if r[1] in national else r[1], r[7])
            of.join(by_event.setdefault(k, r[0]), r[0])
        if r[5]:
            by_key[r[1], r[2], r[3], r[4] or ""].append(r)
    for group in by_key.values():
        before = began = upto = None
        for r in sorted(group, key=lambda r: (r[5], r[0])):
            if before and (r[5] - upto).days <= 4 and (r[5] - began).days <= 16:
                of.join(before, r[0])
            else:
                began, upto = r[5], r[5]
            upto, before = max(upto, r[5], r[6] or r[5]), r[0]
    groups = {}
    for r in sorted(rows):
        if r[1] in national and r[5]:
            g = groups.setdefault(of.root(r[0]), {"key": r[2:4], "start": r[5], "stop": r[5], "sources": set(), "cats": set()})
            g["start"], g["stop"] = min(g["start"], r[5]), max(g["stop"], r[5], r[6] or r[5])
            g["sources"].add(r[1])
            g["cats"] |= set(r[8])
    by_name = defaultdict(list)
    for root, g in groups.items():
        if g["cats"]:
            by_name[g["key"]].append((g["start"], root, g))
    for named in by_name.values():
        chains = []
        for start, root, g in sorted(named, key=lambda x: x[:2]):
            for first, c in chains:
                if (start - c["stop"]).days <= 4 and (start - c["start"]).days <= 16 and not c["sources"] & g["sources"] and (g["cats"] <= c["cats"] or c["cats"] <= g["cats"]):
                    of.join(first, root)
                    c["stop"] = max(c["stop"], g["stop"])
                    c["sources"] |= g["sources"]
                    c["cats"] |= g["cats"]
                    break
            else:
                chains.append((root, {**g, "sources": set(g["sources"]), "cats": set(g["cats"])}))
    return {i: of.root(i) for i in of.up}


def test_editions_to_events(spark):
    family = F.when(F.col("source") == "fie", "fie").otherwise("national")
    joined = 0
    for seed in (1, 2):
        rows = editions(seed, 90 if seed == 1 else 400)
        df = spark.createDataFrame(rows, "edition string, source string, season string, name string, place string, start date, stop date, event string, categories array<string>").repartition(4)
        got = {r.edition: r.event for r in clusters.event_groups(df, family, F.col("source") != "fie").collect()}
        want = grouped(rows)
        assert got == want
        sources = defaultdict(set)
        for r in rows:
            sources[want[r[0]]].add(r[1])
        joined += sum(len(s) > 1 for s in sources.values())
    assert joined > 3


def test_weekend_blocks(spark):
    rng = random.Random(6)
    rows = [(f"e{i:03}", s := rng.randint(0, 40), s + rng.choice([0, 0, 1, 1, 2, 3, 4, 6])) for i in range(120)]
    # A longer event between two ranges that meet on its day keeps them apart.
    rows += [("f0", 700, 701), ("f1", 700, 706), ("f2", 701, 702), ("f3", 701, 701)]
    events = [(i, day(s), day(t)) for i, s, t in rows] + [("none", None, None), ("early", day(300), day(290)), ("open", day(310), None)]
    blocks, of = [], {}
    for i, s, t in sorted(((i, s, max(t or s, s)) for i, s, t in events if s), key=lambda r: (r[1], r[2], r[0])):
        b = blocks[-1] if blocks else None
        monday = s - datetime.timedelta(days=s.weekday())
        if b and s <= b["to"] and monday == b["from"] - datetime.timedelta(days=b["from"].weekday()) and (max(t, b["to"]) - b["from"]).days + 1 <= 4:
            b["to"] = max(b["to"], t)
        else:
            blocks.append(b := {"from": s, "to": t, "key": f"{s}_{i}"})
        of[i] = b
    df = clusters.weekend_blocks(spark.createDataFrame(events, "id string, a date, b date").repartition(3), "id", "a", "b")
    got = {r.id: (r.block_start, r.block_stop, r.block) for r in df.collect()}
    assert got.pop("none") == (None, None, None)
    assert got == {i: (b["from"], b["to"], b["key"]) for i, b in of.items()}


def test_free_time_says_honest_weeks(spark):
    starts = {7: "1 semana libre", 8: "1 semana libre", 9: "9 días libres", 12: "12 días libres", 13: "2 semanas libres", 15: "2 semanas libres", 16: "16 días libres", 20: "3 semanas libres", 6: None}
    rows = []
    for k, free in enumerate(starts):
        first = datetime.date(2024, k + 1, 1)
        rows += [(f"a{k}", first, first, first), (f"b{k}", first + datetime.timedelta(days=free + 1), first + datetime.timedelta(days=free + 1), first)]
    got = {r.days: r.says for r in clusters.free_time(spark.createDataFrame(rows, "block string, block_start date, block_stop date, first_stop date")).collect()}
    assert got == {k: v for k, v in starts.items() if v}


def test_containment(spark):
    rng = random.Random(9)
    keys = ["common", *"abcdefgh"]
    make = lambda n: [(i, rng.choice("xyz"), s := rng.randint(0, 40), s + rng.randint(0, 3), rng.sample(keys, rng.randint(0, 4)) + ["common"] * (rng.random() < 0.7)) for i in range(n)]
    small, large = make(150), make(300)
    frame = lambda rows, p: spark.createDataFrame([(i, c, day(s), day(t), k) for i, c, s, t, k in rows], f"{p} long, city string, {p}0 date, {p}1 date, k{p} array<string>")
    got = joins.contained(frame(small, "s"), frame(large, "m"), ["city"], ("s0", "s1"), ("m0", "m1"), 4, "s", "ks", "km")
    want = Counter((a, b) for a, c, s, t, k in small for b, d, u, v, m in large if k and c == d and s <= v and u <= t and set(k) <= set(m))
    assert Counter((r.s, r.m) for r in got.collect()) == want and len(want) > 50


def test_links_ties_and_decisions(spark):
    columns = "id string, city string, country string, start date, stop date, loose array<string>, exact array<string>"
    two, three = ["e/f", "s/m"], ["e/f", "s/m", "f/m"]
    exact = lambda keys, f: [f"{k}/{f}" for k in keys]
    main = [
        ("m1", "roma", "ITA", day(0), day(2), three, exact(three, "I")), ("m2", "roma", "ITA", day(1), day(2), two, exact(two, "E")), ("m3", "paris", None, day(5), day(6), two, exact(two, "I")),
        ("m4", "paris", "FRA", day(5), day(7), two, exact(two, "I")), ("m5", "baku", "AZE", day(9), day(9), two, exact(two, "I")), ("m6", "baku", "AZE", day(9), day(9), two, exact(two, "I")), ("m7", "", "X", day(1), day(1), two, two),
    ]
    second = [
        ("alone", "roma", "ITA", day(0), day(0), two, exact(two, "I")), ("format", "roma", None, day(1), day(3), two, exact(two, "E")), ("days", "paris", "FRA", day(5), day(7), two, exact(two, "I")),
        ("several", "baku", None, day(9), day(10), two, exact(two, "I")), ("abroad", "roma", "FRA", day(0), day(2), two, exact(two, "I")), ("more", "paris", None, day(5), day(5), three, exact(three, "I")), ("late", "roma", "ITA", day(8), day(9), two, two),
        ("kept_apart", "roma", "ITA", day(0), day(0), two, exact(two, "I")), ("by_hand", "oslo", None, day(30), day(30), two, two), ("gone", "roma", "ITA", day(0), day(0), two, two), ("none", "roma", "ITA", day(0), day(0), [], []), ("blank", "", "X", day(1), day(1), two, two),
    ]
    decisions = [("m1", "kept_apart", "RECHAZADO"), ("m3", "by_hand", "CONFIRMADO"), ("no_such", "gone", "CONFIRMADO"), ("m1", "late", "PROPUESTO")]
    frames = [spark.createDataFrame(r, columns) for r in (main, second)]
    got = event_links.linked_events(*frames, spark.createDataFrame(decisions, "main string, secondary string, status string"), 4)
    assert sorted((r.secondary, r.main, r.status, r.rule) for r in got.collect()) == [
        ("alone", "m1", "link", "contained"), ("by_hand", "m3", "link", "by_hand"), ("days", "m4", "link", "exact_days"), ("format", "m2", "link", "exact_format"), ("several", "m5", "doubt", "several"), ("several", "m6", "doubt", "several"),
    ]


def test_bouts_of_pages(spark):
    rows = [
        ("t16", "a", "b", 5, 3, "p1"), ("t16", "b", "a", 3, 5, "p2"), ("t16", "c", "d", 5, 1, "p1"), ("t16", "c", "d", 5, 2, "p1"), ("t16", "d", "c", 1, 5, "p3"), ("t8", "a", "b", 5, 3, "p1"),
        ("t8", "x", "x", 5, 3, "p1"), ("t8", "x", None, 5, 3, "p1"), ("t8", None, "y", 5, 3, "p2"), ("t8", "e", "f", None, None, "p1"), ("t8", "f", "e", None, None, "p2"), ("t8", "g", "h", None, 1, "p1"), ("t8", "g", "h", 0, 1, "p1"),
    ]
    df = spark.createDataFrame(rows, "round string, a string, b string, x int, y int, page string")
    got = {(r.round, r.a, r.b): (r.x, r.y, r.copies, r.pages, r.state) for r in event_links.merged_bouts(df, ["round"], "a", "b", "x", "y", "page").collect()}
    assert got == {
        ("t16", "a", "b"): (5, 3, 2, 2, "imported"), ("t16", "c", "d"): (None, None, 3, 2, "conflict"), ("t8", "a", "b"): (5, 3, 1, 1, "imported"), ("t8", "x", "x"): (None, None, 1, 1, "same_person"),
        ("t8", "x", None): (None, None, 1, 1, "no_participant"), ("t8", "y", None): (None, None, 1, 1, "no_participant"), ("t8", "e", "f"): (None, None, 2, 2, "imported"), ("t8", "g", "h"): (None, None, 2, 1, "conflict"),
    }


def test_fusion(spark):
    """The greedy assignment of copies, one row after another, gives what the nth copy does."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice("mn"), rng.choice(["fie", "efc", "skermo", "engarde"]), rng.choice([None, 0, 3, 3, 5]), rng.choice([None, 0, 4, 9]), rng.choice([None, 20, 30])) for i in range(260)]
    out, groups = [], defaultdict(list)
    for fact, who, dim, source, place, bouts, field in rows:
        new = {"fact": fact, "place": place, "bouts": bouts, "field": field, "sources": [source], "withdrawn": False}
        old = next((g for g in groups[who, dim] if source not in g["sources"]), None) if who else None
        if old is None:
            groups[who, dim].append(new)
            out.append((who, dim, new))
            continue
        had, has = (old["place"] or 0) > 0, (place or 0) > 0
        wins = (has and not had) or (has == had and (bouts or 0) > (old["bouts"] or 0))
        against = had and has and old["place"] != place
        base, other = (new, old) if wins else (old, new)
        old["place"] = None if against else base["place"] if (base["place"] or 0) > 0 else other["place"] if (other["place"] or 0) > 0 else None
        old["fact"] = base["fact"]
        old["bouts"] = max((b for b in (old["bouts"], bouts) if b is not None), default=None)
        old["field"] = max((b for b in (old["field"], field) if b is not None), default=None)
        old["sources"].append(source)
        old["withdrawn"] |= against
    df = spark.createDataFrame(rows, "fact long, who string, dim string, source string, place int, bouts int, participants int").repartition(3)
    got = sorted(repr((r.who, r.dim, r.fact, r.place, r.bouts, r.participants, r.sources, r.withdrawn)) for r in fused(df, ["who", "dim"], "source", "fact").collect())
    assert got == sorted(repr((w, d, g["fact"], g["place"], g["bouts"], g["field"], ",".join(g["sources"]), g["withdrawn"])) for w, d, g in out)


def test_edition_names(spark):
    cases = {
        "TNR Espada Masculina Sabadell": "tnr sabadell", "TNR Espada Femenina Sabadell 2024": "tnr sabadell", "Championnats du Monde Grands Vétérans": "championnat monde veterans", "Championnat du monde Vétérans 60-69": "championnat monde veterans",
        "Vétérans 70+ World": "veterans world", "Campeonato de España M-15": "campeonato espana m15", "Campeonato de España Sub 15": "campeonato espana m15", "Coupe U20 Épée Dames": "coupe m20", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.b for r in df.select("n", edition_base(F.col("n")).alias("b")).collect()} == cases
