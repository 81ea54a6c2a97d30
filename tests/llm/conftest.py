"""Documents for the operators' tests: a small table as it is, and one of odd rows."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, d long, x long, n long, h string, key string, row string, sha string, value long, lines string, spans string, score double, size int"


def odd_texts():
    """(doc_id, text): nulls, empty and very long texts, repeated rows, ties, unusual characters."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    near = passage.split()
    near[60] = "other"
    long = " ".join(rng.choice(words) for _ in range(40_000))
    base = "The quick brown fox jumps over the lazy dog near the river bank\n"
    out = [
        (1, None), (2, ""), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "\n\n"), (6, "a"), (7, "A"), (8, "one two"), (9, "ONE two"), (10, "x" * 3000),
        (11, passage), (12, passage.upper()), (13, " ".join(near)), (14, passage), (14, passage), (15, long), (16, long + " end"), (None, "a row without a name"), (None, None), (None, passage),
        (17, base * 3), (18, base + "Else\n" + base.upper()), (19, "  " + base + "more"), (20, "ÉCOLE école ÉCOLE naïve ẞ ß İ ı ﬁ ǅ é é    x 　y"), (21, "日本語のテキスト、これは。" * 30),
        (22, "😀👩‍👩‍👧‍👦 \U0001f1ea\U0001f1f8 ﻿​ zero"), (23, "<|endoftext|> mid <|startoftext|>x<s></s><unk> ▁▁ <0x0A>"), (24, "tab\tend  two   three    \n  lead"), (25, "\x00\x01 nul"), (26, "don't I'll WE'RE 'tis 12345 3.14 1,000"),
        (27, "a@b.co, x@y@z.org 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +34 600-123-456 4111-1111-1111-1112"), (28, "@" * 500 + "a" * 500 + "@a." + "." * 300), (29, "1" * 2000 + " " + "1." * 1500 + "+1" * 900), (30, passage[:450] + " tail " + passage[:450]),
        (2**62, "huge id"), (-5, passage + " extra words at the end"), (-5, "another text of one id"),
    ]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", None, 7, 7, 7, 7, "h", "k", "r", "s", 1, "l", "s", 0.5, 3) for i, t in odd_texts()]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def small(spark):
    """The whole small table of documents."""
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(small):
    """(doc_id, text) of small, null as empty."""
    return [(r.doc_id, r.text or "") for r in small.select("doc_id", "text").collect()]
