"""Ranked lexical search: a hierarchical max tree per term, best-first branch and bound.

Documents are numbered within shards of bounded size as they are read. For each term
of a shard the index has the documents that hold it with their impact, the part of
the score that the weight of the term multiplies, and a tree over ranges of FAN,
FAN * FAN, ... documents with the greatest impact in each. The weighted maxima of a
query's terms, added up, bound every score of a range.

A search first takes the shard with the highest bound for each query; the k-th best
score there is a threshold for all others, and shards whose bound is below it are
not read. Within a shard, the range of the highest bound is opened next, down to the
documents, until the best one left is below the k-th score. Ranges of just that
score are opened, since a tie may hold a lesser doc_id.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, fresh, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Whether a byte of UTF-8 belongs to a term, and the byte with A-Z lower-cased.
IN_TERM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Children of a node; levels of nodes; documents and terms at which a shard is closed; queries that one task takes to a shard.
FAN, LEVELS, MOST_DOCS, MOST_TERMS, LOT = 16, 3, 1 << 14, 1 << 21, 256
TREE = [name for level in range(1, LEVELS + 1) for name in (f"nodes{level}", f"best{level}")]
SHARD = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("top", pa.int64()), ("docs", pa.binary()), ("impacts", pa.binary()), *[(t, pa.binary()) for t in TREE]])
SHARD_DDL = "shard long, term string, df long, top long, docs binary, impacts binary, " + ", ".join(f"{t} binary" for t in TREE)
FOUND = "q long, doc_id long, score long"


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by, in whole numbers: at most a million."""
    m = 100 - 50 + (50 * length.astype(np.int64) * n_docs) // max(all_terms, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def tree_of(docs: np.ndarray, impacts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, maxima) of each level, from ranges of FAN documents up to those whose children may be all of a shard."""
    out = []
    nodes, best = docs.astype(np.int32), impacts
    for _ in range(LEVELS):
        above = nodes // FAN
        first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        nodes, best = above[first], np.maximum.reduceat(best, first)
        out.append((nodes, best))
    return out


class ShardBuilder:
    """Gathers the terms of one shard's documents as UTF-8, a lot of texts at a time; batch() gives its rows."""

    def __init__(self) -> None:
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.terms: list[pa.Array] = []
        self.docs = self.tokens = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        terms, lengths = split_terms(texts)
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths)
        self.terms.append(terms)
        self.docs, self.tokens = self.docs + len(lengths), self.tokens + len(terms)

    def batch(self, shard: int, n_docs: int, all_terms: int) -> pa.RecordBatch:
        """A row without a term that names the documents, and one for each term; lists of up to FAN documents need no tree."""
        coded = pa.chunked_array(self.terms, pa.large_string()).combine_chunks()
        coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        lengths = np.concatenate(self.lengths)
        key = np.sort(coded.indices.to_numpy().astype(np.int64) * self.docs + np.repeat(np.arange(self.docs), lengths))
        first = firsts(key)
        tf = np.diff(np.append(first, len(key)))
        term, doc = np.divmod(key[first], self.docs)
        impacts = impact(tf, lengths[doc], n_docs, all_terms).astype("<i4")
        n = len(coded.dictionary)
        df = np.bincount(term, minlength=n)
        start = np.concatenate([[0], np.cumsum(df)])
        ids = pa.chunked_array(self.doc_ids, pa.int64())
        columns = [
            np.full(n + 1, shard), pa.concat_arrays([pa.array([None], pa.large_string()), coded.dictionary]).cast(pa.string()), np.append(self.docs, df), np.append(0, np.maximum.reduceat(impacts, start[:-1]) if n else start[:0]),
            after(ids.fill_null(0).to_numpy().astype("<i8"), doc.astype("<u2"), start), after(ids.is_valid().to_numpy().astype("u1"), impacts, start),
        ]
        deep = (df > FAN)[term]
        term, node, best = term[deep], doc[deep], impacts[deep]
        for _ in range(LEVELS):
            at = firsts(term * MOST_DOCS + node // FAN)
            term, node, best = term[at], node[at] // FAN, np.maximum.reduceat(best, at) if len(at) else best
            start = np.searchsorted(term, np.arange(n + 1))
            columns += [after(np.zeros(0, "u1"), node.astype("<u2"), start), after(np.zeros(0, "u1"), best.astype("<i4"), start)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, SHARD)], schema=SHARD)


def firsts(key: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def after(head: np.ndarray, values: np.ndarray, start: np.ndarray) -> pa.Array:
    """A binary array of head and then values from each start to the next."""
    data = head.tobytes() + values.tobytes()
    offsets = np.append(0, head.nbytes + start * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts one after another, and how many each text has. Bytes decide: those of ASCII letters, digits and of all further characters are terms'."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    inside = IN_TERM[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    at = edges[:-1][edges[:-1] < len(data)]
    new[at] = inside[at]
    count = np.concatenate([[0], np.cumsum(new)])
    kept = LOWERED[data[inside]]
    starts = np.flatnonzero(new[inside])
    bounds = np.append(starts, len(kept)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
    return terms, np.diff(count[edges])


def lots_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_ids and texts, at most `most` and about 4 MB at a time, a longer text alone."""
    for batch in batches:
        doc_ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + most, int(np.searchsorted(ends, before + (4 << 20), "right"))))
            yield doc_ids.slice(at, stop - at), texts.slice(at, stop - at)
            at = stop


def build(docs: DataFrame, scratch: Scratch, most_docs: int = MOST_DOCS) -> tuple[DataFrame, int]:
    """(index, N): a row for each term of each shard, and one with the shard's doc_ids where term is null; N documents hold a term."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in lots_of(batches, MOST_DOCS):
            lengths = split_terms(texts)[1]
            yield pa.RecordBatch.from_pydict({"n": [int((lengths > 0).sum())], "terms": [int(lengths.sum())]})

    n_docs, all_terms = text.mapInArrow(sizes, "n long, terms long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, ShardBuilder()
        for doc_ids, texts in lots_of(batches, most_docs):
            if shard.docs and (shard.docs + len(texts) > most_docs or shard.tokens >= MOST_TERMS):
                yield shard.batch(number, n_docs, all_terms)
                number, shard = number + 1, ShardBuilder()
            shard.add(doc_ids, texts)
        if shard.docs:
            yield shard.batch(number, n_docs, all_terms)

    return scratch.stored(text.mapInArrow(of, SHARD_DDL), "index"), n_docs


class Shard:
    """A shard with the terms that some queries ask for."""

    def __init__(self, index: pd.DataFrame):
        names = index[index["term"].isna()].iloc[0]
        self.doc_ids = np.frombuffer(names["docs"], "<i8")
        self.named = np.frombuffer(names["impacts"], "u1")
        lists = index[index["term"].notna()]
        self.number = {t: k for k, t in enumerate(lists["term"])}
        docs = [np.frombuffer(d, "<u2").astype(np.int32) for d in lists["docs"]]
        impacts = [np.frombuffer(f, "<i4") for f in lists["impacts"]]
        sizes, span = [], len(self.doc_ids)
        for _ in range(LEVELS):
            span = -(-span // FAN)
            sizes.append(span)
        #: The greatest impact of each term in each node, level by level; few terms of a query make few rows of it.
        self.levels = [np.zeros((len(docs), size), dtype=np.int64) for size in sizes]
        kept = zip(*[lists[t] for t in TREE])
        for k, (d, f, tree) in enumerate(zip(docs, impacts, kept)):
            levels = [(np.frombuffer(tree[i], "<u2"), np.frombuffer(tree[i + 1], "<i4")) for i in range(0, len(TREE), 2)] if tree[0] else tree_of(d, f)
            for level, (nodes, best) in zip(self.levels, levels):
                level[k, nodes] = best
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        order = np.argsort(doc // FAN, kind="stable")
        self.doc, self.impact = doc[order], (np.concatenate(impacts) if impacts else doc)[order].astype(np.int64)
        self.term = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[order]
        self.leaf = np.searchsorted(self.doc // FAN, np.arange(sizes[0] + 1))
        self.opened = 0

    def best(self, weights: dict[str, int], k: int, least: int) -> list[tuple[int, int | None]]:
        """The k best (score, doc_id) of scores of at least `least` and over 0; equal scores by ascending doc_id, null last."""
        mine = [(self.number[t], w) for t, w in weights.items() if t in self.number]
        if not mine:
            return []
        at, w = np.array([m[0] for m in mine]), np.array([m[1] for m in mine], dtype=np.int64)
        weight = np.zeros(len(self.number), dtype=np.int64)
        weight[at] = w
        least = max(least, 1)
        kept: list[tuple[int, bool, int]] = []
        top = len(self.levels) - 1
        bounds = w @ self.levels[top][at]
        heap = [(-int(b), top, node) for node, b in enumerate(bounds) if b >= least]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= least:
            _, level, node = heapq.heappop(heap)
            self.opened += 1
            if level:
                first = node * FAN
                for child, b in enumerate((w @ self.levels[level - 1][at, first : first + FAN]).tolist(), first):
                    if b >= least:
                        heapq.heappush(heap, (-b, level - 1, child))
                continue
            a, b = self.leaf[node], self.leaf[node + 1]
            # Sums stay below 2 ** 53, so that doubles hold them exactly.
            scores = np.bincount(self.doc[a:b] - node * FAN, self.impact[a:b] * weight[self.term[a:b]], FAN).astype(np.int64)
            for d in np.flatnonzero(scores >= least).tolist():
                doc = node * FAN + d
                heapq.heappush(kept, (int(scores[d]), bool(self.named[doc]), -int(self.doc_ids[doc])))
                if len(kept) > k:
                    heapq.heappop(kept)
            if len(kept) == k:
                least = max(least, kept[0][0])
        return [(s, -d if named else None) for s, named, d in kept]


def search(docs: DataFrame, queries: DataFrame, text: str = "text", k: int = 50, most_docs: int = MOST_DOCS) -> DataFrame:
    """The columns of queries but for their text, with rank, doc_id and score: the k best documents of every query.

    Each row of queries is one of its own, also where rows repeat; those without
    terms, or none that a document has, find nothing. Documents with null or empty
    texts are never found; a null doc_id comes after any other of its score; repeated
    rows are found each. A very long text fills a shard of its own at the most. Empty
    tables give no rows; other columns of docs are ignored.
    """
    q, terms, rank = fresh(queries, "q", "terms", "rank")
    with Scratch() as scratch:
        index, n_docs = build(docs, scratch, most_docs)
        asked = scratch.stored(queries.withColumn(q, F.monotonically_increasing_id()), "queries")
        lots = asked.count() // LOT + 1
        lowered = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
        wanted = asked.select(F.col(q).alias("q"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
        # From here on the index is what the queries ask of it, and the shards' names.
        index = scratch.stored(index.join(wanted.select("term", F.lit(True).alias("asked")).distinct(), "term", "left").where("term IS NULL OR asked").select(*SHARD.names), "asked")
        held = index.where("term IS NOT NULL")
        df = held.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
        wanted = scratch.stored(wanted.join(df, "term").select("q", "term", weight.alias("w")).where("w > 0"), "wanted")
        bounds = scratch.stored(held.select("shard", "term", "top").join(wanted, "term").groupBy("q", "shard").agg(F.sum(F.col("top") * F.col("w")).alias("bound")), "bounds")
        first = bounds.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))).where("n = 1").select("q", "shard", F.lit(1).cast("long").alias("least"))
        found = scratch.stored(searched(index, wanted, first, k, lots), "first")
        least = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = bounds.join(first.select("q", "shard"), ["q", "shard"], "left_anti").join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(1)).cast("long")).where("bound >= least").select("q", "shard", "least")
        found = found.union(searched(index, wanted, rest, k, lots))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = ranks.select(F.col("q").alias(q), F.col("rank").alias(rank), "doc_id", "score")
        kept = [c for c in queries.columns if c.lower() not in {text.lower(), "rank", "doc_id", "score"}]
        return stored(asked.select(q, *kept).join(out, q).select(*kept, F.col(rank).cast("int").alias("rank"), "doc_id", "score"), "ranked")


def searched(index: DataFrame, wanted: DataFrame, pairs: DataFrame, k: int, lots: int) -> DataFrame:
    """(q, doc_id, score): the k best of each (q, shard), not below its `least`. A shard meets LOT queries or so at a time."""

    def of(key: tuple, index: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(index):
            return pd.DataFrame({"q": [], "doc_id": [], "score": []})
        shard = Shard(index)
        out = []
        for row in pairs.itertuples():
            out += [(row.q, d, s) for s, d in shard.best(dict(zip(row.terms, map(int, row.ws))), k, int(row.least))]
        return pd.DataFrame({"q": pd.array([x[0] for x in out], dtype="Int64"), "doc_id": pd.array([x[1] for x in out], dtype="Int64"), "score": pd.array([x[2] for x in out], dtype="Int64")})

    lot: Column = F.pmod(F.xxhash64("q"), F.lit(lots)).alias("lot")
    needed = pairs.join(wanted, "q").select("shard", lot, "term").distinct()
    lists = index.where("term IS NOT NULL").join(needed, ["shard", "term"])
    names = index.where("term IS NULL").join(needed.select("shard", "lot").distinct(), "shard")
    columns = ["shard", "lot", "term", "docs", "impacts", *TREE]
    whole = lists.select(*columns).union(names.select(*columns))
    asked = pairs.join(wanted.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("t")), "q").select("shard", lot, "q", "least", F.col("t.term").alias("terms"), F.col("t.w").alias("ws"))
    return whole.groupBy("shard", "lot").cogroup(asked.groupBy("shard", "lot")).applyInPandas(of, FOUND)


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
d AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM d, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
