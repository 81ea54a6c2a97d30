"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are rounded to 8 bits, and the length e of what rounding loses is
kept. The product of two rounded vectors differs from their cosine by at most
e1 + e2 + e1 * e2, so a tile product in small integers tells which pairs may reach
the threshold; only those are computed in double precision. A product may stop
after some components: the lengths of what is left, multiplied, are no less than
what the others add.

Equal vectors are one node. Each vector is dealt to one tile and written there
once; pairs of tiles are read where they lie and not shuffled, so that disk grows
with the vectors and not with the pairs. A pair of tiles is one task's work of
fixed size; it gives back, per vector, its number of links and the least vector of
its local component, so that a tile of copies costs as many rows as it has vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import UNNAMED, Scratch, stored
from rostrum.llm.components import components
from rostrum.llm.minhash import local_components


def quantised(unit: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scale and rounding error (length, rounded up) of unit vectors or their beginnings; scale: one for all."""
    scale = np.broadcast_to(np.abs(unit).max(axis=1) / 127 if scale is None else scale, len(unit))
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, error


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that squares stay in range."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def depth(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    """How many components a product should have, by what 256 x 256 pairs cost; pairs that are linked do not depend on it."""
    size = a.shape[1]
    x, y = (v[:: len(v) // 256 + 1] for v in (a, b))

    def cost(k: int) -> float:
        most = x[:, :k] @ y[:, :k].T + np.linalg.norm(x[:, k:], axis=1)[:, None] * np.linalg.norm(y[:, k:], axis=1)
        return k + 25 + 8000 * np.mean(most >= threshold - 0.02)  # in some 0.025 ns a pair

    return min(range(size, 0, -max(8, size // 16)), key=cost)


def blocks(unit: np.ndarray, k: int, size: int, kind: type) -> tuple[np.ndarray, list[tuple[np.ndarray, float, float]]]:
    """Rows by their largest component, and in that order, for each `size` of them: k integers a row and the length of the rest, rounded up; one scale; the largest error."""
    order = np.argsort(np.abs(unit).max(axis=1), kind="stable")
    out = []
    for at in range(0, len(order), size):
        part = unit[order[at : at + size]]
        scale = np.abs(part).max() / 127
        q, _, error = quantised(part[:, :k], scale)
        rest = np.ceil(np.linalg.norm(part[:, k:], axis=1) / scale * (1 + 1e-9))
        out.append((np.concatenate([q, rest[:, None]], axis=1, dtype=kind, casting="unsafe"), scale, error.max()))
    return order, out


def linked(a: np.ndarray, b: np.ndarray, threshold: float, above: bool = False, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows i of a and j of b with cosine >= threshold (unit vectors), and how many pairs needed full precision, some pairs at a time; above: a and b are one, i < j alone."""
    wide, size = 4 * block, a.shape[1]
    largest_first = np.argsort(-np.square(a).mean(axis=0), kind="stable")
    a = np.take(a, largest_first, axis=1)  # rows in one piece, as indexing would not leave them
    b = a if above else np.take(b, largest_first, axis=1)
    k = depth(a, b, threshold)
    kind = np.float32 if (127.5 * math.sqrt(size) + 1) ** 2 < 1 << 24 else np.float64  # sums of small integers, held exactly
    from_row, left = blocks(a, k, block, kind)
    from_column, right = blocks(b, k, wide, kind)
    products, marks, held = np.empty(block * wide, kind), np.zeros(block * wide + 8, bool), max(1, (1 << 18) // size)
    first, second = np.empty((held, size)), np.empty((held, size))
    for m, (q, scale, error) in enumerate(left):
        for n, (r, other, lost) in enumerate(right):
            if above and (n + 1) * wide <= m * block:
                continue
            shape, cells = (len(q), len(r)), len(q) * len(r)
            product = np.matmul(q, r.T, out=products[:cells].reshape(shape))
            most = threshold - (error + lost + error * lost) - 1e-9
            floor = kind(most / (scale * other) * (1 - 1e-6)) if most > 0 else -np.inf
            np.greater_equal(product, floor, out=marks[:cells].reshape(shape))
            marks[cells : cells + 8] = False
            eight = np.flatnonzero(marks[: -(-cells // 8) * 8].view(np.int64) != 0)  # few are marked: eight are looked at in one step
            at = (eight[:, None] * 8 + np.arange(8)).ravel()
            at = at[marks[at]]
            ii, jj = at // len(r) + m * block, at % len(r) + n * wide
            if above:
                ii, jj = ii[ii < jj], jj[ii < jj]
            i, j = from_row[ii], from_column[jj]
            if above:
                i, j = np.minimum(i, j), np.maximum(i, j)
            for x, y in ((i[c : c + held], j[c : c + held]) for c in range(0, len(i), held)):
                np.take(a, x, axis=0, out=first[: len(x)], mode="clip")
                np.take(b, y, axis=0, out=second[: len(x)], mode="clip")
                hit = np.einsum("ij,ij->i", first[: len(x)], second[: len(x)]) >= threshold
                yield x[hit], y[hit], len(x)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, above: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """All pairs of linked() at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0), *linked(a, b, threshold, above)]
    return np.concatenate([x for x, _, _ in found]), np.concatenate([y for _, y, _ in found]), sum(n for _, _, n in found)


def summed_up(n: int, copies: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, int]], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links and least reachable index of n nodes by pairs of which at most about `most` are held at once."""
    links, label, held, pairs = np.zeros(n, np.int64), np.arange(n), [], 0

    def add() -> None:
        nonlocal links, label, pairs
        i, j = (np.concatenate(c) for c in zip(*held))
        links += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
        x, y = label[i], label[j]
        if (x != y).any():
            label = local_components(n, x[x != y], y[x != y])[label]
        held.clear()
        pairs = 0

    for i, j, _ in found:
        held.append((i, j))
        pairs += len(i)
        if pairs >= most or len(held) >= 4096:
            add()
    if held:
        add()
    return links, label


def as_bytes(vectors: pa.ListArray, kind: np.dtype) -> pa.Array:
    """Components as bytes, -0 as 0; null for a vector that is null, empty, zero, or holds null or non-finite components."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
    ends = np.concatenate([[0], pc.list_value_length(vectors).fill_null(0).to_numpy().cumsum(dtype=np.int64)])
    odd, other = (np.concatenate([[0], np.cumsum(c)])[ends] for c in (~np.isfinite(x), x != 0))
    good = (np.diff(odd) == 0) & (np.diff(other) > 0)
    bits = pa.array(good).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(good), [bits, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])


FOUND = pa.schema([("a", pa.int64()), ("h", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])


TILE = "t int, size int, id binary, h binary, m binary, v binary"


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What came of one tile (t, d, m, h, g, v) as a row for each size of vectors: equal ones once, with the least d and their number; numbers of 64 bits in one piece, vectors likewise."""
    held = [x for batch in batches for x in once(iter([batch]))]
    if held:
        for batch in once(iter(pa.Table.from_batches(held).combine_chunks().to_batches())):
            t, h = (batch.column(c).to_numpy() for c in ("t", "h"))
            size = np.array([len(x) for x in batch.column("v").to_pylist()])
            order = np.lexsort((h, batch.column("d").to_numpy(), size, t))
            cuts = np.flatnonzero(np.diff(t[order]) | np.diff(size[order])) + 1
            for of in np.split(order, cuts):
                part = batch.take(pa.array(of))
                row = [part.column(c).to_numpy().tobytes() for c in ("d", "h", "m")] + [b"".join(part.column("v").to_pylist())]
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip((int(t[of[0]]), int(size[of[0]]), *row), kinds)], names=["t", "size", "id", "h", "m", "v"])


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows (t, d, m, h, g, v) with one h and g one: the least d, and m summed up."""
    for batch in batches:
        if batch.num_rows:
            d, m, h, g = (batch.column(c).to_numpy() for c in ("d", "m", "h", "g"))
            order = np.lexsort((d, g, h))
            first = np.flatnonzero(np.r_[True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)])
            kept = batch.take(pa.array(order[first]))
            yield kept.set_column(kept.schema.get_field_index("m"), "m", pa.array(np.add.reduceat(m[order], first)))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing; vectors link only with others of their size. n_links
    counts rows. Rows with one vec_id are one node of the components; a null
    vec_id is one node below any other and its component_id is null. An empty
    table gives no rows; other columns are ignored.
    """
    double = dict(vectors.dtypes)["embedding"] != "array<float>"
    kind = np.dtype("<f8" if double else "<f4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = pc.max(pc.list_value_length(batch.column("embedding"))).as_py() or 1
            step = max(1, (1 << 27) // (longest * kind.itemsize))
            for at in range(0, batch.num_rows, step):
                ids, held = (batch.column(c).slice(at, step) for c in ("vec_id", "embedding"))
                yield pa.RecordBatch.from_arrays([ids, ids.fill_null(UNNAMED), as_bytes(held, kind)], names=["vec_id", "d", "v"])

    valid = F.col("v").isNotNull()
    packed = vectors.select("vec_id", F.col("embedding").cast("array<double>" if double else "array<float>")).mapInArrow(pack, "vec_id long, d long, v binary")
    packed = packed.withColumns({"h": F.when(valid, F.xxhash64("v")), "g": F.when(valid, F.xxhash64(F.lit(8), "v"))})

    def of_pair(one: int, other: int, size: int, *held: pa.Buffer) -> pa.RecordBatch:
        sides = 1 if one == other else 2
        ids, marks, copies = (np.concatenate([np.frombuffer(x, np.int64) for x in held[c : c + sides]]) for c in (0, 2, 4))
        unit = [units(np.frombuffer(x, kind).reshape(-1, size // kind.itemsize)) for x in held[6 : 6 + sides]]
        order = np.lexsort((marks, ids))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, second = linked(unit[0], unit[-1], threshold, above=sides == 1), len(unit[0]) * (sides - 1)
        del unit, held
        links, label = summed_up(len(ids), copies[order], ((place[i], place[j + second], k) for i, j, k in found))
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([ids[order][hit], marks[order][hit], links[hit], ids[order][label[hit]]], schema=FOUND)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other, size = (batch.column(c)[k].as_py() for c in ("t", "other_t", "size"))
                yield of_pair(one, other, size, *(batch.column(c)[k].as_buffer() for c in ("id", "other_id", "h", "other_h", "m", "other_m", "v", "other_v")))

    with Scratch() as scratch:
        packed = scratch.stored(packed, "vectors")
        known = packed.where(valid)
        # The number of vectors and of their bytes is all that the driver learns: tiles of 12 MB at most or so, smaller ones to give all cores work.
        number, held = known.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
        spark = vectors.sparkSession
        dealt = max(1, math.ceil(held / (3 << 22)), min(math.ceil(number / tile), math.ceil(math.sqrt(16 * spark.sparkContext.defaultParallelism))))
        sent = known.select(F.pmod("h", F.lit(dealt)).cast("int").alias("t"), "d", F.lit(1).cast("long").alias("m"), "h", "g", "v")
        sent = sent.mapInArrow(once, sent.schema).repartitionById(dealt, "t").mapInArrow(tiles, TILE)
        one = scratch.checkpointed(sent)
        slim = scratch.stored(packed.select("vec_id", "d", "h", "g"), "rows")
        scratch.drop(packed)
        # Each pair of tiles is a task that reads both; the sizes are compared by a difference, since an equality would shuffle the tiles.
        other = one.select([F.col(c).alias(f"other_{c}") for c in one.columns]).hint("shuffle_replicate_nl")
        pairs = one.join(other, (F.col("t") <= F.col("other_t")) & (F.col("size") - F.col("other_size") == 0))
        found = scratch.stored(pairs.mapInArrow(work, "a long, h long, links long, b long"), "found")
        scratch.drop(one)
        good = slim.where("h IS NOT NULL")
        nodes = scratch.stored(good.groupBy("h", "g").agg(F.min("d").alias("id"), F.count("*").alias("m")), "nodes")
        # A vec_id that several vectors have holds them together through its own node.
        same = good.join(nodes, ["h", "g"]).where("d <> id").select(F.col("d").alias("a"), F.col("id").alias("b")).distinct()
        labels = components(found.select("a", "b").union(same))
        links = found.groupBy(F.col("a").alias("id"), "h").agg(F.sum("links").alias("links"))
        per = scratch.stored(nodes.join(links, ["id", "h"], "left").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "per")
        out = good.join(per, ["h", "g"]).unionByName(slim.where("h IS NULL").withColumn("n_links", F.lit(0).cast("long")))
        out = out.join(labels.withColumnRenamed("id", "d"), "d", "left")
        component = F.coalesce("component", "d")
        return stored(out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.when(component != UNNAMED, component).alias("component_id"), (F.col("d") == component).alias("kept")), "near-vectors")
