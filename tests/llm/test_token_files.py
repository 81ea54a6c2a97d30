"""Files of token ids: Elias-Fano codes, round trips, ids as the library gives them."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rostrum.llm import token_files
from rostrum.llm.queries import op13_token_files, vocabulary

from .conftest import odd_texts
from .test_tokens import noise

WORDS = "word_bpe_49k.json"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30), st.integers(0, 2**64 - 1)), max_size=900))
def test_codes_come_back(values):
    values.sort()
    code = token_files.EliasFano.of(np.array(values, dtype=np.uint64))
    back, size = token_files.EliasFano.from_bytes(memoryview(code.to_bytes() + b"more"))
    assert size == len(code.to_bytes())
    assert back.values().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_codes_are_small():
    values = np.sort(np.random.default_rng(3).integers(0, 2**31, 100_000).astype(np.uint64))
    code = token_files.EliasFano.of(values)
    assert len(code.to_bytes()) * 8 < len(values) * (2.2 + np.log2(2**31 / len(values)))
    assert [code.select(i) for i in range(0, 100_000, 997)] == values[::997].tolist()
    with pytest.raises(ValueError):
        token_files.EliasFano.of(np.array([2, 1]))


def test_ids_are_the_librarys(pairs):
    texts = [t for _, t in pairs] + [t or "" for _, t in odd_texts()] + noise()
    library = Tokenizer.from_file(vocabulary(WORDS))
    own = token_files.WordIds(vocabulary(WORDS), remembered=2000)
    assert own.proven and own.width == 2
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 64):
        got = [x for i in range(0, len(texts), size) for x in own.encode(texts[i : i + size])]
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == want
        assert len(own.seen) <= 2000


def test_a_vocabulary_without_proof_goes_to_the_library():
    own = token_files.WordIds(vocabulary(WORDS))
    own.proven = False
    assert np.frombuffer(own.encode(["a plain text"])[0], "<u2").tolist() == Tokenizer.from_file(vocabulary(WORDS)).encode("a plain text", add_special_tokens=False).ids


def test_files_of_odd_rows(spark, odd, tmp_path, monkeypatch):
    """Every row in ascending order, null doc_ids first, gapless; single documents by select; files that no manifest names are not read."""
    path = str(tmp_path / "ids")
    token_files.write_ids(odd, path, vocabulary(WORDS))
    (tmp_path / "ids" / "lost.ids").write_bytes(b"left by a lost task")
    rows = sorted(token_files.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(vocabulary(WORDS))
    want = sorted((i is not None, i or 0, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in odd_texts())
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in rows) == want
    named = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert named == sorted(named)
    at = 0
    for k, r in enumerate(rows):
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += len(r.ids)
        doc_id, ids = token_files.document(path, k)
        assert doc_id == r.doc_id and ids.tolist() == r.ids
    for k in (-1, len(rows)):
        with pytest.raises(IndexError):
            token_files.document(path, k)


def test_small_files_in_one_task(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_IDS", 10)
    monkeypatch.setattr(token_files.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    import pyarrow as pa

    docs = [(-(2**63), 4), (-1, 25), (0, 3), (0, 3), (2**63 - 1, 9)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "ids": [np.arange(n, dtype="<u2").tobytes() for _, n in docs]})
    writer = token_files.Writer(str(tmp_path / "x"), 2)
    writer.commit([writer.write(iter([batch])), None])
    files = token_files.manifest(str(tmp_path / "x"))
    assert [(f.docs_before, f.ids_before) for f in files] == [(0, 0), (1, 4), (2, 29), (4, 35)]
    assert [(d, ids.tolist()) for d, ids in (token_files.document(str(tmp_path / "x"), k) for k in range(5))] == [(d, list(range(n))) for d, n in docs]
    cut = (tmp_path / "x" / files[1].name).read_bytes()[:-3]
    with pytest.raises(ValueError):
        token_files.TokenFile(memoryview(cut))
    writer.abort([token_files.Written(0, [(f.name, 1, 1) for f in files])])
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["manifest"]


def test_an_empty_table(spark, empty, tmp_path):
    token_files.write_ids(empty, str(tmp_path / "none"), vocabulary(WORDS))
    assert token_files.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_query(spark, pairs):
    got = op13_token_files(spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(vocabulary(WORDS))
    at, want = 0, []
    for i, t in sorted(pairs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == want
