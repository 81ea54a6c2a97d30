"""What the findings of round 4 were about."""

import numpy as np
import pyarrow as pa
import pytest

from rostrum.llm import embedding_dedup
from rostrum.llm.embedding_dedup import linked, near_vectors, once, summed_up, tiles, units

SMALL = "/root/testdata/sf0.001"


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_vectors_are_shuffled_once(spark):
    """However many tiles there are, what is shuffled follows the vectors."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    before = shuffled(spark)
    rows = near_vectors(table, tile=10).count()
    assert rows == 500
    assert shuffled(spark) - before < 4 * rows * 64 * 4


def clustered(rng, n: int, size: int = 64) -> np.ndarray:
    """Vectors of which a third lies about a few centres, at cosines on both sides of 0.9."""
    v = rng.normal(size=(n, size))
    for k in range(0, n // 3):
        v[k] = v[n - 1 - k % 4] + v[k] * rng.choice([0.01, 0.2, 0.33, 0.4])
    return units(v[rng.permutation(n)])


@pytest.mark.parametrize("size", [5, 64, 1100])
@pytest.mark.parametrize("kept", [1, 3, 5])
def test_a_product_that_stops_early_loses_no_pair(monkeypatch, size, kept):
    """All pairs of rows that do not fill their blocks, whatever components the product has."""
    monkeypatch.setattr(embedding_dedup, "depth", lambda *_: kept)
    rng = np.random.default_rng(6)
    a, b = clustered(rng, 301, size), clustered(rng, 155, size)
    b[:50] = a[:50]
    for x, y, above in ((a, b, False), (a, a, True)):
        found = [(i, j) for ii, jj, _ in linked(x, y, 0.9, above, block=16) for i, j in zip(ii.tolist(), jj.tolist())]
        i, j = np.nonzero(np.triu(x @ y.T >= 0.9, 1) if above else x @ y.T >= 0.9)
        assert sorted(found) == sorted(zip(i.tolist(), j.tolist()))


def test_sums_of_pairs_a_few_at_a_time():
    rng = np.random.default_rng(7)
    unit = clustered(rng, 200)
    copies = rng.integers(1, 4, 200)
    near = (unit @ unit.T >= 0.9) & ~np.eye(200, dtype=bool)
    least = np.arange(200)
    for _ in range(200):
        least = np.minimum(least, np.where(near, least, 200).min(axis=1))
    links, label = summed_up(200, copies, linked(unit, unit, 0.9, above=True, block=8), most=3)
    assert (links == near @ copies).all()
    assert (label == least).all()


def test_a_tile_holds_equal_vectors_once():
    """Copies in one batch, and of several batches and sizes."""
    def batch(rows):
        return pa.RecordBatch.from_pydict({"t": pa.array([2] * len(rows), pa.int32()), "d": [r[0] for r in rows], "m": [r[1] for r in rows], "h": [r[2] for r in rows], "g": [r[3] for r in rows], "v": [r[4] for r in rows]})

    one, other, long = b"\1" * 8, b"\2" * 8, b"\3" * 16
    batches = [batch([(9, 1, 5, 1, one), (4, 2, 5, 1, one), (7, 1, 5, 2, other)]), batch([]), batch([(3, 1, 5, 1, one), (1, 1, 6, 1, long)])]
    assert [b.num_rows for b in once(iter(batches))] == [2, 2]
    got = {}
    for b in tiles(iter(batches)):
        for r in b.to_pylist():
            got[r["size"]] = ([np.frombuffer(r[c], np.int64).tolist() for c in ("id", "h", "m")], r["v"], r["t"])
    assert got == {8: ([[3, 7], [5, 5], [4, 1]], one + other, 2), 16: ([[1], [6], [1]], long, 2)}
    assert list(tiles(iter([]))) == list(tiles(iter([batch([])]))) == []


def test_vectors_as_bytes():
    """Odd vectors anywhere in a slice of a column."""
    nan, inf = float("nan"), float("inf")
    odd = [[9.0], None, [], [0.0, -0.0], [1.0, None], [nan, 1.0], [1.0, inf], [-inf], [-0.0, 2.0], None, [3.0], [0.0]]
    for kind, of in (("<f4", pa.float32()), ("<f8", pa.float64())):
        got = embedding_dedup.as_bytes(pa.array(odd, pa.list_(of)).slice(1), np.dtype(kind))
        assert got.null_count == 9
        assert got.to_pylist() == [None] * 7 + [np.array([0, 2], kind).tobytes(), None, np.array([3], kind).tobytes(), None]
    assert embedding_dedup.as_bytes(pa.array([None, None], pa.list_(pa.float32())), np.dtype("<f4")).to_pylist() == [None, None]
