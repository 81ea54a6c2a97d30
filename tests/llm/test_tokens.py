"""Token counts, packing and byte-pair encoding against the libraries on whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rostrum.llm import bpe, packing, token_counts
from rostrum.llm.queries import vocabulary

from .conftest import odd_texts


def noise(n=400):
    """Texts of mixed alphabets, spaces and specials."""
    rng = random.Random(11)
    bits = ["a", "B", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ñ", "Ü", "ß", "İ", "日", "한", "😀", "́", " ", "​", "▁", "<s>", "<|endoftext|>", "<|startoftext|>", "<|", "1", "23", "!!", "...", "_", "-", "\x7f", "\x00", " ", "ﬁ", "Ǆ", "Σ", "ς", "ΑΣ", "\r", "€", "…", "“", "ł", "Ł", "ŉ", "ſ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def every(pairs):
    return [t for _, t in pairs] + [t or "" for _, t in odd_texts()] + noise()


def test_counts_are_the_librarys(every):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    own = token_counts.counter(vocabulary("piece_bpe_32k.model"))
    assert own.splits and len(own.whole) > 25_000
    assert [own.count(t)[0] for t in every] == [len(library.encode(t)) for t in every]
    for piece in random.Random(3).sample(sorted(own.whole - {" "}), 500):
        before = library.encode("\n", out_type=str) if piece[0] != " " else []
        text = piece[1:] if piece[0] == " " else "\n" + piece
        assert len(library.encode(text)) == len(before) + 1


def test_counts_of_odd_rows(spark, odd, empty):
    got = token_counts.count_tokens(odd, vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == len(odd_texts())
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count_tokens(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_memory_is_bounded():
    own = token_counts.WholeTokenCounter(vocabulary("piece_bpe_32k.model"), remembered=5)
    texts = [f"qzx{i}jkv wqp{i}" for i in range(50)]
    assert [own.count(t)[0] for t in texts] == [len(own.model.encode(t)) for t in texts]
    assert own.merged <= 5


def test_fast_encoder_is_the_library(every):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    own = packing.encoder(vocabulary("byte_bpe_50k.json"))
    for t in every:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_packing(spark, odd, empty):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {i: t or "" for i, t in odd_texts() if i is not None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        assert [i for r in pieces for i in r.ids] == ids and pieces[0].start == 0
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.length & (r.length - 1) == 0 and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for pieces in by_sequence.values():
        assert len(pieces) == 1 and pieces[0].offset == 0
    assert packing.pack(odd, vocabulary("byte_bpe_50k.json")).where("doc_id IS NULL").count() > 2
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_cuts():
    for n in range(1, 3000):
        pieces = list(packing.cuts(n, 1024))
        assert sum(size for _, size in pieces) == n and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:]))


def test_forced_boundaries_give_the_librarys_ids(every):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    own = bpe.encoder(vocabulary("word_bpe_49k.json"))
    assert own.known
    for t in every:
        ids = library.encode(t, add_special_tokens=False).ids
        n, joined, decoded = own.encode(t)
        assert (n, joined) == (len(ids), " ".join(map(str, ids))), t[:80]
        assert decoded == library.decode(ids, skip_special_tokens=False), t[:80]
        assert own.decode(ids) == decoded


def test_long_fragments_merge_alike():
    own = bpe.encoder(vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 64)))
        parts = [*word[:-1], word[-1] + own.end]
        assert own.merge(word, True) == own._merge_long(parts)


def test_encoding_of_odd_rows(odd, empty):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = bpe.encode_decode(odd, vocabulary("word_bpe_49k.json")).collect()
    want = []
    for doc_id, t in odd_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.encode_decode(empty, vocabulary("word_bpe_49k.json")).count() == 0
