"""Exact, line, near-duplicate and repeated-string removal against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rostrum.llm import exact, line_dedup, minhash, repeats
from rostrum.llm.components import components

from .conftest import odd_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def low(i):
    """Null below any other doc_id."""
    return -(1 << 63) if i is None else i


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def exact_brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(FOLD)].append(i)
    for i, t in docs:
        key = (t or "").translate(FOLD)
        keep = max(groups[key], key=low)
        yield i, keep, len(groups[key]), i == keep, sha(key)


def test_exact(small, pairs):
    same(exact.duplicates(small).collect(), exact_brute(pairs))


def test_exact_odd(odd, empty):
    got = exact.duplicates(odd.repartition(5), bits=1)
    same(got.collect(), exact_brute(odd_texts()))
    assert exact.duplicates(empty).count() == 0
    kept = exact.without_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r[3] for r in exact_brute(odd_texts()))


def test_runs_merge_over_batches():
    """Entries of one key that several batches hold, and equal digests that verification tells apart."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = sorted((int(rng.integers(2)), int(rng.integers(2)), bytes([int(rng.integers(4))]) * 32, int(rng.integers(2)), int(rng.integers(2)), int(rng.integers(1, 5)), int(rng.integers(-9, 9))) for _ in range(500))
    want = defaultdict(lambda: [0, -99])
    for *key, n, top in rows:
        want[tuple(key)][0] += n
        want[tuple(key)][1] = max(want[tuple(key)][1], top)
    for size in (1, 7, 500):
        sent = pa.schema([f.with_nullable(f.name != "n") for f in exact.RUN])  # a constant column comes as one that holds no nulls
        batches = [pa.RecordBatch.from_pylist([dict(zip(exact.RUN.names, r)) for r in rows[at : at + size]], schema=sent) for at in range(0, 500, size)]
        got = [tuple(r.values()) for b in exact.merged(iter(batches)) for r in b.to_pylist()]
        assert got == sorted((*k, *v) for k, v in want.items())


def lines_brute(docs, shortest=20, least=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(low(i))
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= shortest and len(holders[key(x)]) >= least and max(holders[key(x)]) != low(i))]
        yield i, len(lines), len(lines) - len(keep), sha("\n".join(keep))


def test_lines(small, pairs):
    same(line_dedup.drop_common_lines(small).collect(), lines_brute(pairs))


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_odd(odd, empty, batches):
    same(line_dedup.drop_common_lines(odd, batches=batches).collect(), lines_brute(odd_texts()))
    assert line_dedup.drop_common_lines(empty, batches=batches).count() == 0


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_brute(docs, size, percent):
    """Rows with one doc_id are one document."""
    sets = [shingles(t, size) for _, t in docs]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(low(docs[k][0])), find(low(docs[j][0]))
                parent[max(a, b)] = min(a, b)
    for (i, _), s in zip(docs, sets):
        c = find(low(i))
        yield i, len(s), None if c == low(None) else c, c == low(i)


@pytest.mark.parametrize("how", [(3, 85), (5, 80)])
def test_near(small, pairs, how):
    same(minhash.near_duplicates(small, *how).collect(), near_brute(pairs, *how))


@pytest.mark.parametrize("keep", [1024, 40])
def test_near_in_small_tiles(small, pairs, keep):
    """Also where most sets are longer than their sketches, so that the full sets decide."""
    same(minhash.near_duplicates(small, 3, 85, keep=keep, tile=3).collect(), near_brute(pairs, 3, 85))


@pytest.mark.parametrize("keep", [1024, 64])
def test_near_family_without_its_base(spark, keep):
    """Many variants of one text that are linked in clusters of their own, around none in common: those apart from a centre meet all others."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for cluster in range(25):
        own = list(base)
        for at in rng.choice(150, 12, replace=False):
            own[at] = f"c{cluster}at{at}"
        for k in range(4):
            text = list(own)
            text[int(rng.integers(150))] = f"v{cluster}k{k}"
            rows.append((len(rows) * 7 % 101, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(minhash.near_duplicates(docs, 3, 85, keep=keep, tile=16).collect(), near_brute(rows, 3, 85))


def test_near_odd(odd, empty):
    same(minhash.near_duplicates(odd, 3, 85).collect(), near_brute(odd_texts(), 3, 85))
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each(odd).columns == odd.columns


def test_near_at_the_threshold(spark):
    """Sets of 17 of 20 in common are linked, of 16 of 19 (84.2 %) are not; chains of links hold together."""
    rows = []
    for g in range(60):
        words = [f"g{g}n{i}" for i in range(20)]
        base = [f"{w}" for w in words]
        a = " ".join(base)  # 18 shingles
        b = " ".join([*base[:19], "x"])  # 17 in common of 19
        c = " ".join([*base[:18], "y", "z"])  # 16 of 20 with a, 16 of 20 with b
        rows += [(g * 10 + 2, a), (g * 10 + 1, b), (g * 10, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(minhash.near_duplicates(docs, 3, 85).collect(), near_brute(rows, 3, 85))


def test_near_of_ids_with_several_texts(spark):
    """Every text of a null or repeated doc_id has its own near copies; an id of many texts, an empty one among them, is one document."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(24)]
    near = [t + " end" for t in texts]
    rows = [(None, t) for t in texts[:6]] + [(10 + k, t) for k, t in enumerate(near[:6])]  # null ids
    rows += [(7, t) for t in texts[6:12]] + [(70 + k, t) for k, t in enumerate(near[6:12])]  # a repeated id
    rows += [(20 + k, t) for k, t in enumerate(texts[12:17])] + [(200, t) for t in texts[12:17]]  # an id whose texts are others' nodes
    rows += [(30, texts[17]), (300, texts[17]), (300, ""), (300, None)]
    rows += [(40, texts[18]), (41, texts[19])]  # no links
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(minhash.near_duplicates(docs, 3, 85).collect(), near_brute(rows, 3, 85))


def test_overlaps():
    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    b = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(7)]
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.overlaps(a, b, width=16).tolist() == want


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in parent:
        assert got.get(i, i) == find(i)


def repeats_brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    for (i, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        end = 0
        for k in range(len(t) - length + 1):
            if seen[hash(t[k : k + length])] > 1:
                gone[max(k, end) : k + length] = True
                end = k + length
        kept = np.frombuffer(t, dtype=np.uint8)[~gone[: len(t)]].tobytes()
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(t) else 0
        yield i, len(t), len(t) - len(kept), spans, sha(kept)


def test_repeats(small, pairs):
    same(repeats.remove_repeats(small).collect(), repeats_brute(pairs, 400))


def test_repeats_leave_nothing_behind(spark, small, pairs):
    """The bytes that stay are those of the digest, and neither tables nor intermediate files outlive the call."""
    import os

    from rostrum.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before, tables = set(os.listdir(folder)), {t.name for t in spark.catalog.listTables()}
    got = repeats.remove_repeats(small, with_bytes=True)
    assert len(set(os.listdir(folder)) - before) == 1 and {t.name for t in spark.catalog.listTables()} == tables
    assert all(sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got.collect())


@pytest.mark.parametrize("length", [400, 64])
def test_repeats_odd(odd, empty, length):
    same(repeats.remove_repeats(odd, length).collect(), repeats_brute(odd_texts(), length))
    assert repeats.remove_repeats(empty, length).count() == 0


def shared_brute(docs, words):
    texts = [(t or "").encode().split() for _, t in docs]
    rows_of = defaultdict(set)
    for row, t in enumerate(texts):
        for k in range(len(t) - words + 1):
            rows_of[hash(tuple(t[k : k + words]))].add(row)
    for (i, _), t in zip(docs, texts):
        gone = {j for k in range(len(t) - words + 1) if len(rows_of[hash(tuple(t[k : k + words]))]) > 1 for j in range(k, k + words)}
        yield i, len(gone)


@pytest.mark.parametrize("words", [51, 16])
def test_shared_words(small, pairs, odd, words):
    for docs, texts in ((small, pairs), (odd, odd_texts())):
        same(repeats.remove_repeats(docs, words=words).select("doc_id", "n_shared_words").collect(), shared_brute(texts, words))


def test_op5_catches_short_passages(spark, tmp_path):
    """Passages of over 50 words are told also where they are shorter than 400 bytes, whatever blanks part them; 50 words and a text's own repetitions are not."""
    from rostrum.llm.queries import op5_repeats

    def prose(seed, n):
        rng = np.random.default_rng(seed)
        return [LOWER[a] + LOWER[b] + LOWER[c] for a, b, c in rng.integers(0, 26, (n, 3))]

    texts = []
    for n in (50, 51, 60, 99):
        passage = prose(n, n)
        texts += [" ".join(prose(1000 + n, 70) + passage + prose(2000 + n, 90)), " ".join(prose(3000 + n, 20)) + "\n" + "  ".join(passage), " ".join(prose(4000 + n, 300))]
    texts.append(" ".join(prose(7, 60) * 2))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_removed, r.n_shared_words) for r in op5_repeats(spark, str(tmp_path)).collect())
    assert got == [(i, 0, [0, 51, 60, 99][i // 3] if i < 12 and i % 3 < 2 else 0) for i in range(13)]


def test_repeats_of_long_texts(spark):
    """Anchors are sought segment by segment: repeats across the segments' ends, and of bytes outside ASCII, are found all the same."""
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.integers(0x100, 0x180, n)) for n in (40_000, 9_000)]
    shared = [texts[0][k - 300 : k + 300] for k in (repeats.SEGMENT // 2, repeats.SEGMENT)]
    pairs = list(enumerate([*texts, shared[0] + texts[1][:500], "x" * 399 + shared[1], "ab" * 40_000]))
    same(repeats.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect(), repeats_brute(pairs, 400))


def test_op5_moves_and_holds_less(spark, monkeypatch, small):
    """Fewer than one block a hundred bytes, few texts beside those that share something are moved, and the blocks of all rows are gone before texts are written."""
    import os

    from rostrum.llm.common import Scratch, shared_dir

    text = bytes(np.random.default_rng(3).integers(0, 256, 100_000, dtype=np.uint8))
    assert 0 < len(repeats.anchors(text, 400)) < len(text) / 100
    docs = spark.range(2000).selectExpr("id AS d", "id * 7 AS x", "'a' AS text")
    kept = {r.d for r in repeats.among(docs, docs.where("d < 20").select("d", "x")).collect()}
    assert {*range(20)} <= kept and len(kept) < 100

    folder, write, there = shared_dir(spark).removeprefix("file:"), Scratch.bucketed, []
    before = set(os.listdir(folder))
    monkeypatch.setattr(Scratch, "bucketed", lambda *a, **b: (there.extend(set(os.listdir(folder)) - before), write(*a, **b))[1])
    repeats.remove_repeats(small, words=51)
    assert there and not any(n.startswith(("scanned", "anchors", "word_anchors")) for n in there)
