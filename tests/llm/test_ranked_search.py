"""Ranked search against brute force, and by its bounds."""

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rostrum.llm import ranked_search
from rostrum.llm.queries import op11_ranked_search

from .conftest import odd_texts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, queries, k=50):
    """(query, rank, doc_id, score) with exact whole numbers."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, text in queries:
        found = []
        for (d, c), size in zip(counted, sizes):
            m = 100 - 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(q, rank, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df, name="item_id"):
    return sorted(((r[name], r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query(spark, pairs):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert rows(op11_ranked_search(spark, "/root/testdata/sf0.001")) == brute(pairs, items)


QUESTIONS = [(1, "w1 w2 w3 the"), (2, "fox FOX river"), (3, None), (4, ""), (5, "nosuchterm"), (6, "École ẞ 日本語のテキスト、これは。日本語のテキスト、これは。"), (7, "a"), (1, "w1 w2 w3 the"), (None, "quick w7")]


@pytest.mark.parametrize("docs_a_shard,lot,k", [(1, 1, 3), (5, 2, 50), (1 << 14, 256, 50), (40, 256, 2)])
def test_odd_rows(spark, odd, monkeypatch, docs_a_shard, lot, k):
    """Shards of one document, of a few and of all; queries in lots; repeated and null queries."""
    monkeypatch.setattr(ranked_search, "LOT", lot)
    questions = spark.createDataFrame([(i, t, 9, "x") for i, t in QUESTIONS], "item_id long, text string, score int, terms string")
    assert rows(ranked_search.search(odd, questions, k=k, most_docs=docs_a_shard)) == brute(odd_texts(), QUESTIONS, k)


def test_empty_tables(spark, odd, empty):
    questions = spark.createDataFrame(QUESTIONS, "item_id long, text string")
    assert ranked_search.search(empty, questions).collect() == []
    assert ranked_search.search(odd, questions.limit(0)).collect() == []


def shard_of(texts):
    builder = ranked_search.ShardBuilder()
    for i in range(0, len(texts), 300):
        part = texts[i : i + 300]
        builder.add(pa.array([3 * (i + k) for k in range(len(part))]), pa.array(part))
    return ranked_search.Shard(builder.batch(0, len(texts), builder.tokens).to_pandas())


def test_bounds_prune_and_ties_stay():
    """Few nodes are opened where one range stands out; equal scores in other ranges are found by doc_id."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 400, 30)) for _ in range(4000)]
    texts[3000] = "needle needle needle " + texts[3000]
    shard = shard_of(texts)
    weights = {"needle": 9000, "t1": 10}
    got = shard.best(weights, 1, 0)
    assert got[0][1] == 9000 and shard.opened < 10
    tied = shard_of(["x"] * 700 + ["y"] * 5 + ["x"] * 700)
    best = sorted(tied.best({"x": 7}, 50, 0))
    assert {d for _, d in best} == {3 * i for i in range(50)} and len({s for s, _ in best}) == 1
    above = tied.best({"x": 7}, 50, best[0][0] + 1)
    assert above == []


def test_trees_hold_maxima():
    """Stored trees, and those that short lists are given when read, have each range's greatest impact."""
    rng = np.random.default_rng(4)
    shard = shard_of([" ".join(["often"] * int(rng.integers(0, 5)) + ["seldom"] * (k % 500 == 7) + ["x"] * int(rng.integers(1, 60))) for k in range(3000)])
    for name in ("often", "seldom"):
        t = shard.number[name]
        mine = shard.term == t
        for level, best in enumerate(shard.levels, 1):
            of = shard.doc[mine] // ranked_search.FAN**level
            assert best[t].tolist() == [max(shard.impact[mine][of == n], default=0) for n in range(best.shape[1])]


def test_terms_are_the_patterns():
    texts = [t or "" for _, t in odd_texts()] + ["", "ab", "", "AB cd", "é", "—x", "9", ""]
    array = pa.array(["not read", *texts]).slice(1)
    found, lengths = ranked_search.split_terms(array)
    assert found.to_pylist() == [x for t in texts for x in terms(t)]
    assert lengths.tolist() == [len(terms(t)) for t in texts]
