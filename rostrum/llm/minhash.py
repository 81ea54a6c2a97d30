"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set of word shingles is hashed once; the k least values are its
sketch. Equal sets are one node from the start, so copies never meet each other.

1. Short sketches of all nodes go into inverted lists. The lists' lengths tell how
   many of its values a node shares with anyone; fewer than a link must share, and
   the node is alone. Most of a corpus ends here.
2. Long sketches of the others go into inverted lists again, by value and by the
   size classes of both partners. A node enters with the rarest values it must
   share with a partner of that size, and with no others: whoever holds too many
   values of its own enters none, and a common passage fills no list.
3. Each list pairs its members with its most central one alone: a group's links
   are as many as its documents. Only members that no link joins to the centre's
   component then meet the group's others, in pairs of tiles of bounded size.
4. Overlaps of two sketches estimate their union's similarity: what lies more than
   six standard deviations below the threshold is dropped, sketches that hold the
   whole sets decide, and the rest is verified on the full sets of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import UNNAMED, Scratch, chunks, fresh, named, rows, stored
from rostrum.llm.components import components

#: Ratio of the sizes at which classes of sets begin.
CLASS = 1.07
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int, remembered: int = 400_000):
        self.size, self.remembered = size, remembered
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) or 1
        if len(self.words) >= self.remembered:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = h
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on bytes both mean ASCII alone
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], dtype=np.uint64)
        get, new = self.words.get, self._hash
        h = np.array([get(w) or new(w) for w in words], dtype=np.uint64)
        n = len(h) - self.size + 1
        with np.errstate(over="ignore"):
            out = h[:n].copy()
            for k in range(1, self.size):
                out = out * MIX[0] + h[k : k + n]
            for shift, by in ((31, MIX[1]), (29, MIX[2])):
                out = (out ^ (out >> np.uint64(shift))) * by
            out ^= out >> np.uint64(32)
        return np.unique(out)


@lru_cache(maxsize=2)
def shingler(size: int) -> Shingler:
    """One per worker and size."""
    return Shingler(size)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


SKETCH = pa.schema([("doc_id", pa.int64()), ("d", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("sketch", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, shingle: int, keep: int) -> DataFrame:
    """doc_id, d (never null), x (hash of the text), n (set size), digest of the set, and its least `keep` values as signed numbers, in their unsigned order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(shingle)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, d, x, text in rows(batch, "doc_id", "d", "x", "text"):
                    s = shingles(text)
                    yield doc_id, d, x, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), s[:keep].view(np.int64)

        yield from chunks(each(), SKETCH, 512)

    return named(docs).mapInArrow(of, "doc_id long, d long, x long, n long, digest string, sketch array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of 0-1 matrices of bounded width."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    values, which = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    counts = np.bincount(which, minlength=len(values))
    column = np.cumsum(counts > 1) - 1
    column[counts < 2] = -1
    column = column[which]
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(a) + len(b), width), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out


def tolerance(percent: int, keep: int) -> int:
    """Common values among the `keep` least of a union that linked sets have at least: six and a half standard deviations below the mean."""
    p = percent / 100
    return max(1, int(keep * (p - 6.5 * (p * (1 - p) / keep) ** 0.5)))


def common_values(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def judged(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int, keep: int) -> int:
    """0 for no link, 2 for a link, 1 where only the full sets can tell; a and b are the least `keep` values of sets of na and nb."""
    if min(na, nb) * 100 < max(na, nb) * percent:
        return 0
    if na <= keep and nb <= keep:
        both = common_values(a, b)
        return 2 * (100 * both >= percent * (na + nb - both))
    least = np.union1d(a, b)[:keep]
    top = least[-1]
    return int(common_values(a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]) >= tolerance(percent, keep))


def sets_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column of lists, without copies."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends, ends[1:])]


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
PAIR_DDL = "a long, b long, sure boolean"


def against_hubs(pairs: DataFrame, payload: DataFrame, percent: int, keep: int, shingle: int | None = None, share: int = 512) -> DataFrame:
    """The pairs of nodes (a, b) that may be links, and whether they surely are.

    payload has node and either n and sketch or, with `shingle`, text. A hub a is sent once for every `share` of its partners, ahead of them, so
    that a task reads its rows one after another and holds one hub at a time.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    what = [c for c in payload.columns if c != "node"]
    first = hubs.join(payload.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), *what)
    others = pairs.join(hubs, "a").join(payload.withColumnRenamed("node", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "b", *what)
    parts = 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(others).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shingler(shingle) if shingle else None
        hub, n_hub = np.zeros(0, np.uint64), 0

        def each() -> Iterator[tuple]:
            nonlocal hub, n_hub
            for batch in batches:
                sets = sets_of(batch.column("sketch")) if whole is None else None
                for k, (a, role, b, given) in enumerate(rows(batch, "a", "role", "b", "n" if whole is None else "text")):
                    if sets is None:
                        own = whole(given)
                        n = len(own)
                    else:
                        n, own = given, sets[k]
                    if role == 0:
                        hub, n_hub = own, n
                    elif got := judged(hub, n_hub, own, n, percent, max(n, n_hub) if whole is not None else keep):
                        yield a, b, got == 2

        yield from chunks(each(), PAIR)

    return dealt.mapInArrow(work, PAIR_DDL)


def between_tiles(members: DataFrame, sketched: DataFrame, percent: int, keep: int, tile: int) -> DataFrame:
    """The pairs that may be links, between members (a, node, alone) of one group a: those alone against all others.

    Members that hang together with the centre need not meet each other. Each goes
    to as many pairs of tiles as there are tiles of those alone; sure links come
    back as one row per document and pair of tiles.
    """
    sizes = members.groupBy("a").agg(F.ceil(F.count_if("alone") / tile).cast("int").alias("rt"), F.ceil(F.count_if(~F.col("alone")) / tile).cast("int").alias("mt")).where("rt > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("alone"), F.col("rt")).otherwise(F.col("mt"))).cast("int")
    placed = members.join(sizes, "a").withColumn("t", own)

    def tiles(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    among = F.transform(tiles("rt"), lambda u: F.struct(F.lit(0).alias("kind"), F.least("t", u).alias("lo"), F.greatest("t", u).alias("hi")))
    across = F.transform(tiles("mt"), lambda u: F.struct(F.lit(1).alias("kind"), F.col("t").alias("lo"), u.alias("hi")))
    back = F.transform(tiles("rt"), lambda u: F.struct(F.lit(1).alias("kind"), u.alias("lo"), F.col("t").alias("hi")))
    sent = placed.select("a", "node", "alone", "t", F.explode(F.when(F.col("alone"), F.concat(among, across)).otherwise(back)).alias("p")).select("a", "p.*", "node", "alone", "t")
    sent = sent.join(sketched, "node")
    low = tolerance(percent, keep) / keep

    def work(group: pa.Table) -> pa.Table:
        kind, first, second = (group.column(c)[0].as_py() for c in ("kind", "lo", "hi"))
        ids, sizes_of = (group.column(c).to_numpy() for c in ("node", "n"))
        tiles_of, alone = group.column("t").to_numpy(), group.column("alone").to_numpy(zero_copy_only=False)
        sets = sets_of(group.column("sketch"))
        left = np.flatnonzero((tiles_of == first) & alone)
        right = np.flatnonzero(~alone) if kind else left if first == second else np.flatnonzero(tiles_of == second)
        if not len(left) or not len(right):
            return PAIR.empty_table()
        na, nb = sizes_of[left][:, None], sizes_of[right]
        both = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
        fits = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
        full = (na <= keep) & (nb <= keep)
        i, j = np.nonzero(fits & full & (100 * both >= percent * (na + nb - both)))
        root = local_components(len(ids), left[i], right[j])
        hit = np.flatnonzero(root != np.arange(len(ids)))
        i, j = np.nonzero(fits & ~full & (both >= low * np.minimum(keep, np.maximum(na, nb))))
        i, j = left[i], right[j]
        other = i < j if first == second and not kind else i != j
        a, b = np.concatenate([root[hit], i[other]]), np.concatenate([hit, j[other]])
        return pa.table([ids[a], ids[b], np.arange(len(a)) < len(hit)], schema=PAIR)

    sent = sent.repartition(2 * int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "kind", "lo", "hi")
    return sent.groupBy("a", "kind", "lo", "hi").applyInArrow(work, PAIR_DDL)


def candidate_groups(sketched: DataFrame, percent: int, keep: int, scratch: Scratch) -> DataFrame:
    """(a, b): members b of the lists that a is the centre of, for nodes (node, n, sketch as an array)."""
    ratio, p = math.log(CLASS), percent / 100
    entries = sketched.select("node", F.explode("sketch").alias("value"))
    lengths = scratch.stored(entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    shared = entries.join(lengths, "value").groupBy("node").agg(F.sum("length").alias("weight"), F.array_sort(F.collect_list(F.struct("length", "value"))).alias("v")).join(sketched.select("node", "n"), "node")
    own = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    m = F.least("n", F.lit(keep))
    reach = F.sequence((F.floor(F.log(F.col("n") * p) / ratio) - 1).cast("int"), (F.floor(F.log(F.col("n") / p) / ratio) + 1).cast("int"))

    def needed(c):
        """Values that this set shares with a linked one of class c, at least: sizes there begin at the bound below or above it."""
        smallest = F.greatest(F.floor(F.exp(c * ratio)) - 1, F.ceil(F.col("n") * percent / 100), F.lit(1))
        exact = F.ceil((F.col("n") + smallest) * percent / (100 + percent))
        return F.when((F.col("n") > keep) | (F.exp((c + 1) * ratio) + 1 > keep), F.least(exact, F.lit(tolerance(percent, keep)))).otherwise(exact)

    def keys(c):
        own_values = m - F.size("v")
        return F.transform(F.slice("v", F.lit(1), F.greatest(m - needed(c) + 1 - own_values, F.lit(0)).cast("int")), lambda s: F.xxhash64(s["value"], F.least(c, "own"), F.greatest(c, "own")))

    lists = scratch.stored(shared.withColumn("own", own).select("node", "weight", F.explode(F.flatten(F.transform(reach, keys))).alias("key")), "lists")
    centres = lists.groupBy("key").agg(F.count("*").alias("length"), F.max(F.struct("weight", F.bitwise_not("node").alias("i"))).alias("top")).where("length > 1").select("key", F.bitwise_not("top.i").alias("a"))
    centres = scratch.stored(centres, "centres")
    return lists.join(centres, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, short: int = 64, keep: int = 1024, tile: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Texts are linked when 100 * intersection >= percent * union of their sets of
    `shingle`-word shingles, A-Z lower-cased; fewer words make one shingle; a text
    without words has an empty set and no links. component_id is the least doc_id
    that links reach. Rows with one doc_id are one document: its texts are linked.
    Null doc_ids likewise (their component_id is null, unless another document is
    linked to them). Very long texts are whole sets, held by one task one or two at
    a time. Of nodes that are as central the first is taken. An empty table gives no
    rows; other columns are ignored.

    Links between sets of up to `short` shingles are certain; of larger ones a link
    is missed where a sample of `short` or `keep` values lies 6.5 standard
    deviations off, about one in 10^9 at the threshold and fewer above it.
    """
    with Scratch() as scratch:
        everything = scratch.stored(sketches(docs, shingle, short), "sketches")
        full = everything.where("n > 0")
        # A node is a set, numbered once it is written; its id is the least of those that have it, with a hash of that one's text.
        least = full.groupBy("digest", "n").agg(F.min(F.struct("d", "x")).alias("least"), F.any_value("sketch").alias("sketch"))
        nodes = scratch.stored(least.select(F.monotonically_increasing_id().alias("node"), "digest", "n", F.col("least.d").alias("id"), F.col("least.x").alias("x"), "sketch"), "nodes")
        entries = nodes.select("node", F.explode("sketch").alias("value"))
        # Counts are written before they are joined: a value that a third of all sets hold then is a skewed join, which Spark splits.
        lengths = scratch.stored(entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1").select("value"), "shared")
        shared = entries.join(lengths, "value", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
        must = F.least(F.ceil(F.col("n") * percent / 100), F.lit(tolerance(percent, short)))
        active = scratch.stored(nodes.select("node", "n", F.col("id").alias("d"), "x").join(shared, "node").where(F.col("shared") >= must).select("node", "d", "x"), "active")
        # Merged whatever the size, so that the plan is the same on any corpus.
        texts = scratch.stored(named(docs).select("d", "x", "text").join(active.hint("merge"), ["d", "x"]).dropDuplicates(["node"]).select("node", "text"), "texts")
        longer = scratch.stored(sketches(texts.select(F.col("node").alias("doc_id"), "text"), shingle, keep).select(F.col("d").alias("node"), "n", "sketch"), "longer")
        groups = scratch.stored(candidate_groups(longer, percent, keep, scratch), "groups")
        own = nodes.select("node", "id")

        def verified(maybe: DataFrame, name: str) -> DataFrame:
            """Ids (a, b) of the links among pairs of nodes that may be ones: the full sets tell where sketches could not."""
            maybe = scratch.stored(maybe, name)
            unsure, links = maybe.where("NOT sure").select("a", "b"), maybe.where("sure").select("a", "b")
            if not unsure.isEmpty():
                links = links.union(scratch.stored(against_hubs(unsure, texts, percent, keep, shingle), f"{name}-full").select("a", "b"))
            return links.join(own.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(own.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b").select("ia", "ib")

        ids = everything.join(nodes.select("digest", "n", "id"), ["digest", "n"], "left").withColumn("id", F.coalesce("id", "d"))
        # One document's several texts, empty ones included, hold together: each node of it is joined to its least.
        several = ids.groupBy("d").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most").select("d", "a")
        links = verified(against_hubs(groups, longer, percent, keep), "links").union(ids.select("d", "id").distinct().join(several, "d").where("id <> a").select("a", "id")).toDF("a", "b")
        links = scratch.stored(links, "edges")
        labels = scratch.stored(components(links), "labels")

        # Members that are not in their centre's component, and the groups that have any.
        within = scratch.stored(own.join(labels, "id").select("node", "component"), "within")
        one, other = (within.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("a", "b"))
        apart = groups.join(one, "a", "left").join(other, "b", "left").withColumn("alone", F.coalesce(F.col("a_in") != F.col("b_in"), F.lit(True)))
        apart = scratch.stored(apart.select("a", F.col("b").alias("node"), "alone"), "members")
        if not apart.where("alone").isEmpty():
            more = verified(between_tiles(apart, longer, percent, keep, tile), "more")
            labels = scratch.stored(components(links.union(more)), "labels")
        out = ids.select("doc_id", "d", "n", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != UNNAMED, F.col("component")).alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))
        return stored(out, "near")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns and any names, without the rows that near_duplicates() does not keep.

    Of a component the rows of its least doc_id stay, repeated ones all; empty and
    null texts have no copies and stay; null doc_ids are one document below any
    other; very long texts are compared whole; an empty table gives none.
    """
    (mark,) = fresh(docs, "gone_id")
    gone = near_duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(mark)), "left_anti")
