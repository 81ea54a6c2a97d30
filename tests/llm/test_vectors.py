"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from rostrum.llm.embedding_dedup import linked_pairs, near_vectors, quantised, units

from .conftest import SMALL


def brute(rows, threshold=0.9):
    def good(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    unit = [np.array(v, float) / np.abs(v).max() if good(v) else None for _, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    low = [-(1 << 63) if i is None else i for i, _ in rows]
    label, links = {i: i for i in low}, [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(low[a]), find(low[b])
                label[max(x, y)] = min(x, y)
    return [(i, n, None if find(k) == -(1 << 63) else find(k), find(k) == k) for (i, _), k, n in zip(rows, low, links)]


@pytest.mark.parametrize("tile", [4096, 60])
def test_vectors(spark, tile):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = near_vectors(table, tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.2]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [0.0] * 8), (53, [1.0, None] + [0.0] * 6), (54, [float("nan")] * 8), (55, [float("inf")] + [1.0] * 7), (56, [1.0]), (57, [2.0]), (58, [-3.0]), (None, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (3, [-x for x in rows[3][1]]), (60, [1e-30] * 8), (61, [1e30] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id int, v string")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for tile in (4096, 7):
        assert sorted(map(repr, map(tuple, near_vectors(table, tile=tile).collect()))) == sorted(map(repr, brute(rows)))
    assert near_vectors(table.limit(0)).count() == 0


def test_error_bounds():
    rng = np.random.default_rng(5)
    v = units(rng.normal(size=(200, 64)))
    q, scale, error = quantised(v)
    product = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(product - v @ v.T) <= error[:, None] + error + error[:, None] * error).all()
    i, j, tried = linked_pairs(v, v, 0.3)
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*map(list, map(np.ndarray.tolist, np.nonzero(v @ v.T >= 0.3))))}
    assert tried < len(v) ** 2 / 10
