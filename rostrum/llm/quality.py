"""A quality classifier on random-indexing word vectors.

Every word has a bucket, a form (its case, digits and punctuation with its first
letters), and every form a fixed sparse random vector. One pass over all texts adds
to each bucket and to each form the random vectors of the forms beside it; the sums,
made unit length, are the vectors of words and forms. A document is pooled from
them alone: mean and spread of its words' and forms' vectors, and mean and spread of
how alike neighbours are. A two-layer network in numpy learns labels from these, and
one temperature, fitted on labelled rows that the network has not seen, makes its
outputs probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import rows

BUCKETS, FORMS, SIZE = 8192, 4096, 48
FEATURES = 4 * SIZE + 4
SHAPE = [(re.compile("[0-9]+"), "9"), (re.compile("[^\\W\\d_]+"), "a")]
#: Words that are pooled at once.
BLOCK = 1 << 15


def form_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each form's six components that are not 0, the same everywhere."""
    rng = np.random.default_rng(20240501)
    places = np.array([rng.choice(SIZE, 6, replace=False) for _ in range(FORMS)])
    return places, rng.choice([-1, 1], (FORMS, 6))


class Tokens:
    """Codes of words: bucket and form in one number. Remembered up to a bound; the older half goes first."""

    def __init__(self, remembered: int = 220_000):
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.remembered = remembered

    def code(self, word: str) -> int:
        got = self.older.get(word)
        if got is None:
            case = "A" if len(word) > 1 and word.isupper() else "Aa" if word[:1].isupper() else "a"
            shape = "a"
            if not word.isalpha():
                shape = word
                for pattern, by in SHAPE:
                    shape = pattern.sub(by, shape)
            got = xxhash.xxh32_intdigest(word) % BUCKETS * FORMS + xxhash.xxh32_intdigest(f"{case}\t{shape}\t{word[:2].lower()}") % FORMS
        if len(word) <= 64:  # longer ones are worked out each time, so that memory is bounded
            if len(self.seen) >= self.remembered:
                self.older, self.seen = self.seen, {}
            self.seen[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """The codes of a text's words."""
        get, words = self.seen.get, text.split()
        codes = list(map(get, words))
        if None in codes:
            codes = [self.code(w) if c is None else c for c, w in zip(codes, words)]
        return np.array(codes, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all words and forms of a corpus: one array of fixed size a task, added up in a tree among executors.

    The sums are whole numbers, so their order does not matter.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (places, signs) = Tokens(), form_vectors()
        total = np.zeros((BUCKETS + FORMS) * SIZE, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            """Rows of words and forms times neighbouring forms, counted first: pairs repeat."""
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            row, form = pair // FORMS, pair % FORMS
            for at in range(0, len(pair), 1 << 17):
                part = slice(at, at + (1 << 17))
                where = row[part, None] * SIZE + places[form[part]]
                low, high = int(where.min()), int(where.max()) + 1
                total[low:high] += np.bincount(where.ravel() - low, (signs[form[part]] * n[part, None]).ravel(), high - low).astype(np.int64)

        for batch in batches:
            for (text,) in rows(batch, "text"):
                codes = tokens.of(text)
                if len(codes) > 1:
                    word, form = codes // FORMS, codes % FORMS
                    for own in (word, form + BUCKETS):
                        held += [own[1:] * FORMS + form[:-1], own[:-1] * FORMS + form[1:]]
                    size += 4 * len(codes)
                if size > 1_000_000:
                    add()
                    held.clear()
                    size = 0
        if held:
            add()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["sums"])

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, "sums binary")
    arrays = sums.rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    total = arrays.treeAggregate(np.zeros((BUCKETS + FORMS) * SIZE, np.int64), lambda a, b: a + b, lambda a, b: a + b, depth=3)
    total = total.reshape(-1, SIZE).astype(np.float64)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _sums(codes: np.ndarray, starts: np.ndarray, vectors: np.ndarray, before: int | None) -> np.ndarray:
    """Sums over each run of codes: vectors, their squares, likeness of neighbours and its squares; `before` is the code ahead of the first."""
    v = np.hstack([vectors[codes // FORMS], vectors[BUCKETS + codes % FORMS]])
    near = np.zeros((len(codes), 2), dtype=np.float32)
    beside = v[1:] * v[:-1]
    near[1:, 0], near[1:, 1] = beside[:, :SIZE].sum(1), beside[:, SIZE:].sum(1)
    near[starts] = 0
    if before is not None:
        near[0] = vectors[codes[0] // FORMS] @ vectors[before // FORMS], vectors[BUCKETS + codes[0] % FORMS] @ vectors[BUCKETS + before % FORMS]
    return np.hstack([np.add.reduceat(part, starts, axis=0) for part in (v, v * v, near, near * near)])


def pooled(texts: list[str], tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """The features of texts, all 0 without words. What a text gets does not depend on the texts beside it."""
    codes = [tokens.of(t) for t in texts]
    out = np.zeros((len(texts), 4 * SIZE + 4))
    held: list[int] = []

    def flush() -> None:
        if held:
            out[held] = _sums(np.concatenate([codes[i] for i in held]), np.cumsum([0, *(len(codes[i]) for i in held[:-1])]), vectors, None)
            held.clear()

    size = 0
    for i, own in enumerate(codes):
        if len(own) > BLOCK:
            for at in range(0, len(own), BLOCK):
                out[i] += _sums(own[at : at + BLOCK], np.array([0]), vectors, int(own[at - 1]) if at else None)[0]
        elif len(own):
            if size + len(own) > BLOCK:
                flush()
                size = 0
            held.append(i)
            size += len(own)
    flush()
    n = np.maximum([len(c) for c in codes], 1)[:, None]
    pairs = np.maximum(n - 1, 1)
    mean, square = out[:, : 2 * SIZE] / n, out[:, 2 * SIZE : 4 * SIZE] / n
    likeness, its_square = out[:, 4 * SIZE : 4 * SIZE + 2] / pairs, out[:, 4 * SIZE + 2 :] / pairs
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), likeness, np.sqrt(np.maximum(its_square - likeness * likeness, 0))]).astype(np.float32)


class Network:
    """Two layers, trained by Adam on the logistic loss, with a temperature."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w1 = rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden))
        self.b1, self.w2, self.b2 = np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)
        self.middle, self.scale, self.temperature, self.rng = np.zeros(inputs), np.ones(inputs), 1.0, rng

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.einsum("ij,jk->ik", (x - self.middle) / self.scale, self.w1) + self.b1, 0)
        return np.einsum("ij,j->i", hidden, self.w2) + self.b2  # each row by itself: what stands beside it changes no bit

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 60, steps: int = 1200, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> None:
        """At least so many passes over the rows, and more of them over few rows, up to so many steps."""
        passes = max(passes, steps // -(-len(x) // batch))
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.middle) / self.scale
        names = ("w1", "b1", "w2", "b2")
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for k in range(passes):
            order = self.rng.permutation(len(z))
            for at in range(0, len(z), batch):
                i = order[at : at + batch]
                h = np.maximum(z[i] @ self.w1 + self.b1, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40)))
                d = (p - y[i]) / len(i)
                back = np.outer(d, self.w2) * (h > 0)
                step += 1
                for j, g in enumerate((z[i].T @ back + decay * self.w1, back.sum(0), h.T @ d + decay * self.w2, np.array([d.sum()]))):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    move = rate * (1 - k / passes) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, names[j], getattr(self, names[j]) - move)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least loss on unseen rows."""
        if len(y) == 0:
            return
        raw = self.logits(x)

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(raw / t, -40, 40))), 1e-6, 1 - 1e-6)
            return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)


def held_out(doc_id: str) -> Column:
    """Whether labels of this row may not be learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, vectors: np.ndarray | None = None) -> tuple[np.ndarray, Network]:
    """Word vectors over all docs, and a network fitted on at most `most` labelled rows, taken by hash of doc_id.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from. A third of
    the sample sets the temperature. Null labels and null doc_ids count as none; of
    repeated labels of one row the lowest counts, of several texts of one doc_id the
    one whose features hash lowest. Null and empty texts have no words; texts of any
    length are pooled whole. Without labels, or with one kind of label, every score
    is the share of label 1 (0.5 with none). Other columns are ignored.
    """
    vectors = word_vectors(docs) if vectors is None else vectors
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y")).where(~held_out("doc_id"))
    # A top-k by hash on labels alone: at most `most` small rows, so the broadcast below has that bound.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found = list(rows(batch, "doc_id", "y", "text"))
            if found:
                x = pooled([t for _, _, t in found], tokens, held.value)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.int64()), pa.array([y for _, y, _ in found], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows_of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    got = rows_of.select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(of, "doc_id long, y int, x binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x", "y")).alias("one")).select("doc_id", "one.x", "one.y").toPandas().sort_values("doc_id")
    net = Network(FEATURES)
    if got.y.nunique() < 2:
        share = float(got.y.mean()) if len(got) else 0.5
        net.w2[:], net.b2[:] = 0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return vectors, net
    x, y = np.stack([np.frombuffer(b, dtype=np.float32) for b in got.x]).astype(np.float64), got.y.to_numpy(dtype=np.float64)
    aside = np.array([zlib.crc32(b"t%d" % i) % 3 == 0 for i in got.doc_id])
    if len(set(y[~aside])) < 2 or not aside.any():
        aside[:] = False
    net.fit(x[~aside], y[~aside])
    net.calibrate(x[aside], y[aside])
    return vectors, net


def score(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from the text alone.

    Null and empty texts score as the network sees no words; equal texts have equal
    scores, repeated rows come back each, and a score at the threshold counts as 1;
    very long texts are pooled block by block; null doc_ids are not held out; an
    empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        vectors, net = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                p = net.probabilities(pooled([t for (t,) in rows(batch, "text")], tokens, vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.7) -> DataFrame:
    """docs, all columns and any names, without the rows that score() predicts as 0; null and empty texts, ties, repeated rows and very long texts as there."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        vectors, net = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = pooled([t or "" for (t,) in rows(batch, "text")], tokens, vectors)
                yield batch.filter(pa.array(net.probabilities(x) >= threshold))

    return docs.mapInArrow(of, docs.schema)
