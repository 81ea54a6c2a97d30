"""Spelling variants against brute force over all pairs of words."""

import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest

from rostrum.llm import spelling
from rostrum.llm.queries import op12_spelling

from .conftest import odd_texts


def brute(docs, times=10):
    """The contract by deletions of one code point: near words share one, or one is the other's."""
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    by = defaultdict(set)
    for w in words:
        if len(w) < 200:
            by[w].add(w)
            for i in range(len(w)):
                by[w[:i] + w[i + 1 :], i].add(w)
                by[w[:i] + w[i + 1 :]].add(w)
    close = defaultdict(set)
    for key, group in by.items():
        for a in group:
            for b in group:
                if a != b and (isinstance(key, tuple) or abs(len(a) - len(b)) == 1):
                    close[a].add(b)
    form = {}
    for w, n in words.items():
        if close[w]:
            best = min(close[w], key=lambda x: (-words[x], x))
            if words[best] >= times * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_query(spark, pairs):
    got = rows(op12_spelling(spark, "/root/testdata/sf0.001"))
    assert got == brute(pairs)
    assert any(r[1] for r in got)


def planted():
    """Families of one edit, chains of forms, repeated letters, accents, ties, hot words."""
    rng = random.Random(8)
    docs, doc = [], 0

    def add(word, n):
        nonlocal doc
        for _ in range(n):
            docs.append((doc * 7 + 1, word))
            doc += 1

    for word, n in (("aaaaaaa", 900), ("aaaaaaaa", 60), ("aaaaaaaaa", 4), ("aaaabaaa", 3), ("abababab", 40), ("babababa", 3), ("ababababa", 2), ("ÉCOLEétude", 30), ("Écoleetude", 3), ("ÿÀÖØöøÿ", 5), ("ÿÀÖØöøÿx", 50)):
        add(word, n)
    base = "qwertyuiop"
    add(base, 300)
    for i in range(len(base)):
        add(base[:i] + rng.choice("zxcvbnm") + base[i + 1 :], rng.randint(2, 40))
        add(base[:i] + base[i + 1 :], rng.randint(2, 40))
        add(base[:i] + "k" + base[i:], rng.randint(2, 40))
    for _ in range(60):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        add(word, rng.randint(2, 60))
    long = "".join(rng.choice("abcd") for _ in range(120))
    add(long, 3)
    add(long[:70] + "z" + long[70:], 40)
    docs.append((5, "x" * 20_000 + " " + "x" * 20_000 + " " + "x" * 20_001 + "!" + "x" * 20_001))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("group", [1, 4, 256])
def test_planted_words(spark, group, monkeypatch):
    """Groups that are dealt out to the last code point, in part, or not at all."""
    monkeypatch.setattr(spelling, "GROUP", group)
    docs = planted()
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    want = brute(docs)
    # Brute force leaves the very long runs out.
    assert [r for r in got if len(r[0]) < 200] == [r for r in want if len(r[0]) < 200]
    assert {(len(w), n_near) for w, _, _, _, n_near, _ in got if len(w) >= 19_000} >= {(20_000, 1), (20_001, 1)}
    assert any(r[2] not in (r[0], r[1]) for r in got)


def test_odd_rows(spark, odd, empty):
    assert rows(spelling.variants(odd)) == brute(odd_texts())
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, times=1)


def test_groups_find_each_edit_once():
    """Every edit within the piece, at its ends and in runs of one letter; the bound holds off words of two edits."""
    words = sorted({"abcdefgh", "abcdexgh", "abcdefg", "abcdeefgh", "abcdefggh", "abcdxygh", "abcdefxgh", "abcdeyxgh", "abcdzzzz"})
    eight = [w for w in words if len(w) in (8, 9) and w.startswith("abcd")]
    got = sorted((a, b) for a, _, b, _ in spelling.near_in_group(4, 8, 8, [(w, 1) for w in eight]))
    assert got == sorted((a, b) for a in eight for b in eight if len(a) == 8 and (len(b) == 9 or b > a) and spelling.one_edit(a, b))
    assert ("abcdefgh", "abcdeefgh") in got and ("abcdefgh", "abcdexgh") in got
