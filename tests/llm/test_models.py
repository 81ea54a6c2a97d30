"""Quality scores, personal data and the pipeline."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rostrum.llm import pii, quality

from .conftest import SMALL, odd_texts
from .test_dedup import exact_brute, near_brute, sha

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def base_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True, "ip": lambda m=m: all(len(p) < 2000 and int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if fits():
                out.append((kind, *m.span()))
    return out


def spans_of(docs, texts):
    """Base figures by brute force; the spans of the method hold them all."""
    got = pii.find(docs).collect()
    want = []
    for i, t in texts:
        spans = base_brute(t or "")
        n = Counter(k for k, _, _ in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append({f"{k}:{a}:{b}" for k, a, b in base_brute(t or "")})
    for r in got:
        assert any(s <= set(filter(None, r.spans.split(","))) for s in by_id[r.doc_id])
    return got


def test_base_spans(small, pairs):
    spans_of(small, pairs)


def test_base_spans_odd(odd, empty):
    spans_of(odd, odd_texts())
    assert pii.find(empty).count() == 0 and pii.masked(empty).columns == empty.columns


def test_context_discovers(spark):
    """Identifiers that no base pattern knows are found from what stands before them; the same shapes elsewhere are not."""
    rows = [(i, f"Please note mail to: user{i}@site{i % 7}.org and thanks") for i in range(30)]
    rows += [(100 + i, f"Please note mail to: person{i}@localhost and thanks") for i in range(5)]
    rows += [(200 + i, f"A decorator named like{i}@thing stands here") for i in range(5)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].startswith("email:21:") for i in range(5)) and not any(got[200 + i] for i in range(5))


def test_context_discovers_in_hops(spark):
    """Patterns that reach the support with accepted instances alone find further ones, five hops from the seeds."""
    hops = ["mail to:", "reach them via", "contact goes through", "their box is", "messages land at", "answers come from"]
    rows = [(i, f"Please note {hops[0]} user{i}@site{i % 7}.org and thanks") for i in range(30)]
    for h, words in enumerate(hops):
        rows += [(1000 * (h + 1) + i, f"Please note {words} person{h}{i}@localhost and thanks") for i in range(5)]
        if h:
            rows += [(1000 * (h + 1) + 100 + i, f"Please note {words} person{h - 1}{i}@localhost and thanks") for i in range(5)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(s.startswith("email:") for s in got.values()), sorted(i for i, s in got.items() if not s)


@pytest.mark.parametrize("before, seed, other, kind", [
    ("please write mail to: ", "user{i}@site{i}.org", "bob{i} [at] site", "email"),
    ("please call my phone ", "+34 600 123 4{i:02d}", "555 123 4{i:03d}", "phone"),
    ("please charge card number ", "4111 1111 1111 1111", "4111 1111 1111 {i}112", "card"),
    ('{"text":"' + "x" * 100 + '","phone":"', "+346001234{i:02d}", "5551234{i:03d}", "phone"),
    ("http://a.b/" + "c" * 100 + "?to=1&mail=", "user{i}@site{i}.org", "person{i}@localhost", "email"),
])
def test_context_discovers_within_tokens_and_over_blanks(spark, before, seed, other, kind):
    rows = [(i, f"{before}{seed.format(i=i)}\" and more") for i in range(30)]
    if kind == "card":
        rows = [(i, f"{before}{n}\" and more") for i, n in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "3714 496353 98431"] * 6)]
    rows += [(100 + i, f"{before}{other.format(i=i)}\" and more") for i in range(1, 6)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(1, 6):
        assert got[100 + i] == f"{kind}:{len(before)}:{len(before) + len(other.format(i=i))}"


def test_candidates_in_long_runs():
    """Time in proportion to the text, whatever it is made of."""
    for part in ("1.", "a@", "1 ", "1:", "(+1", "a", "@", "12345 ", "a[at]"):
        began = time.time()
        list(pii.candidates(part * (200_000 // len(part)) + "a", np.zeros(0, dtype=np.int64)))
        assert time.time() - began < 10, part


def test_mask():
    assert pii.mask("ab cd ef", "email:3:5") == "ab [EMAIL] ef"
    assert pii.mask("abcdefgh", "email:1:4,phone:2:6") == "a[EMAIL]gh"


def test_quality(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.score(docs, *quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    unseen = [(r.quality, got[r.doc_id].score) for r in labels.where("quality IS NOT NULL").collect() if r.doc_id in got and got[r.doc_id].held_out]
    right = np.mean([(s >= 0.5) == (y == 1) for y, s in unseen])
    assert len(unseen) > 50 and right > 0.93, (len(unseen), right)


def test_vectors_and_pooling_against_brute_force(spark, small, pairs):
    """Word vectors as sums over all neighbours, pooling word by word, whatever stands beside a text and however long it is."""
    texts = [t for _, t in pairs] + [" ".join(t for _, t in pairs)]
    vectors = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    places, signs = quality.form_vectors()
    index = np.zeros((quality.FORMS, quality.SIZE))
    for f in range(quality.FORMS):
        index[f, places[f]] = signs[f]
    tokens, total = quality.Tokens(remembered=50), np.zeros((quality.BUCKETS + quality.FORMS, quality.SIZE))
    for t in texts:
        codes = [int(c) for c in tokens.of(t)]
        for a, b in [*zip(codes, codes[1:]), *zip(codes[1:], codes)]:
            total[a // quality.FORMS] += index[b % quality.FORMS]
            total[quality.BUCKETS + a % quality.FORMS] += index[b % quality.FORMS]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, want, atol=1e-6)
    own = quality.pooled(texts, quality.Tokens(), vectors)
    for t, got in zip(texts, own):
        codes = tokens.of(t)
        v = np.array([[*want[c // quality.FORMS], *want[quality.BUCKETS + c % quality.FORMS]] for c in codes]).reshape(len(codes), 2 * quality.SIZE)
        if not len(codes):
            assert not got.any()
            continue
        alike = np.array([[a[:48] @ b[:48], a[48:] @ b[48:]] for a, b in zip(v, v[1:])]).reshape(-1, 2) if len(v) > 1 else np.zeros((1, 2))
        assert np.allclose(got, [*v.mean(0), *v.std(0), *alike.mean(0), *alike.std(0)], atol=2e-3)
    assert len(quality.Tokens().of(texts[-1])) > quality.BLOCK
    for k in range(0, len(texts), 17):
        assert (quality.pooled(texts[k : k + 1], quality.Tokens(), vectors)[0] == own[k]).all()


def test_temperature():
    """The temperature has the least loss of all on rows that were not fitted on."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = quality.Network(6)
    net.fit(x[:300], y[:300])

    def loss():
        p = np.clip(net.probabilities(x[300:]), 1e-6, 1 - 1e-6)
        return -(y[300:] * np.log(p) + (1 - y[300:]) * np.log(1 - p)).mean()

    before = loss()
    net.calibrate(x[300:], y[300:])
    best, found = loss(), net.temperature
    assert best < before and found > 1
    for other in np.linspace(0.3, 7.9, 80):
        net.temperature = other
        assert loss() >= best - 1e-3


def test_quality_of_odd_rows(spark, odd, empty):
    again = spark.createDataFrame([(11, f"text number {k} of one id") for k in range(50)], "doc_id long, text string")
    few = spark.createDataFrame([(11, 1), (6, 0)], "doc_id long, quality int")
    assert quality.train(odd.select("doc_id", "text").union(again), few)[1].middle.shape == (quality.FEATURES,)
    labels = spark.createDataFrame([(11, 1), (11, 1), (6, 0), (10, 0), (15, 1), (None, 1), (7, None), (29, 0), (12, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.score(odd, *model).where("score BETWEEN 0 AND 1").count() == len(odd_texts())
    assert quality.score(empty, *model).count() == 0 and quality.accepted(empty, *model).count() == 0
    assert {r.score for r in quality.score(odd, *quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(odd, *quality.train(empty, labels)).count() == len(odd_texts())


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    good = stages["quality"](spark, docs, SMALL)
    assert good.columns == columns
    scores = quality.score(docs, *quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = stages["exact"](spark, good, SMALL)
    assert one.columns == columns
    kept = {r[0] for r in exact_brute(rows) if r[3]}
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept)
    rows = [(i, t) for i, t in rows if i in kept]
    near = stages["near"](spark, one, SMALL)
    kept = {r[0] for r in near_brute(rows, 5, 80) if r[3]}
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(kept)
    masked = stages["private"](spark, near, SMALL)
    assert masked.columns == columns and masked.count() == len(kept)
    for r in masked.collect():
        assert not base_brute(r.text or "") and r.n_chars == len(r.text or "")
    packed = stages["packing"](spark, masked, SMALL).collect()
    assert {r.doc_id for r in packed} == kept and all(r.length & (r.length - 1) == 0 for r in packed)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, small, stage):
    docs = spark.createDataFrame([], small.schema)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, SMALL).count() == 0


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage, each against brute force on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    odd = odd.withColumnsRenamed({"id": "gone_id", "key": "row_spans", "sha": "gone_sha", "row": "row_key"})
    texts = odd_texts()
    model = quality.train(odd, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = stages["quality"](spark, odd, SMALL)
    assert good.columns == odd.columns and good.count() == quality.score(odd, *model).where("predicted = 1").count()
    one = stages["exact"](spark, odd, SMALL)
    kept = [(r[0], t) for r, (_, t) in zip(exact_brute(texts), texts) if r[3]]
    assert one.columns == odd.columns and sorted(map(repr, ((r.doc_id, r.text) for r in one.collect()))) == sorted(map(repr, kept))
    near = stages["near"](spark, odd, SMALL)
    kept = [(r[0], t) for r, (_, t) in zip(near_brute(texts, 5, 80), texts) if r[3]]
    assert near.columns == odd.columns and sorted(map(repr, ((r.doc_id, r.text) for r in near.collect()))) == sorted(map(repr, kept))
    private = stages["private"](spark, odd, SMALL)
    assert private.columns == odd.columns and private.count() == len(texts) and private.where("text IS NULL").count() == sum(t is None for _, t in texts)
    for r in private.where("text IS NOT NULL").collect():
        assert r.n_chars == len(r.text)
    packed = stages["packing"](spark, odd, SMALL)
    assert packed.where("start = 0").count() == len(texts) and packed.where("doc_id IS NULL AND start = 0").count() == 3
