"""Packing by power-of-two decomposition.

Each document, with an end token, is cut into pieces whose lengths are powers of
two: as many full pieces as fit, then one piece per set bit of the rest. A piece
is a whole sequence of its own length, so no sequence crosses documents and none
is padded; sequences of one length form a bucket that a trainer reads alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import chunks, rows, texts

SHARDS = 1024
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteEncoder:
    """Token ids of a byte-level vocabulary file.

    The fast encoder merges by rank, which equals the file's merge order exactly
    when every merge makes the next id; that is checked here. Where it does not
    hold, and for any text on which the fast encoder gives up, the library that
    the file is written for encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        if plain and simple and all(a < b for a, b in zip(made, made[1:])) and len(made) + 256 == len(vocab):
            import public_tokenizers
            import tiktoken

            shown = byte_letters()
            back = {c: b for b, c in enumerate(shown)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN,
                mergeable_ranks={bytes(back[c] for c in t): i for t, i in vocab.items()},
                special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
            )

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers, special strings as their tokens."""
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode(text, allowed_special="all"), dtype="<u4")
            except BaseException as failed:  # the native splitter panics on some very long runs, with an exception of its own outside Exception
                if type(failed).__name__ != "PanicException":
                    raise
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    out, more = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + more))
            more += 1
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cuts(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones first, then the set bits of the rest, long to short."""
    at = 0
    while n - at >= most:
        yield at, most
        at += most
    size = most
    while size > 1:
        size //= 2
        if n - at >= size:
            yield at, size
            at += size


def pack(docs: DataFrame, vocabulary: str, most: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket; with_ids adds the ids.

    bucket is the sequence's length; sequence_id is unique and numbered within
    (bucket, shard), so no task ever holds a whole bucket. Null and empty texts
    give the end token alone; null doc_ids and rows with one doc_id, equal or not,
    are packed one by one, in the order of their pieces where they tie; a very long
    text is encoded whole, by one task; an empty table gives no rows; other columns
    are ignored.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    schema = pa.schema([*FIELDS, ("ids", pa.list_(pa.int32()))] if with_ids else FIELDS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in rows(batch, "doc_id", "text"):
                    ids = np.append(model.encode(text), np.uint32(end_id)).astype("<u4")
                    for start, length in cuts(len(ids), most):
                        part = ids[start : start + length]
                        row = (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids))
                        yield (*row, part.astype("int32")) if with_ids else row

        yield from chunks(each(), schema)

    pieces = texts(docs).mapInArrow(of, COLUMNS + (", ids array<int>" if with_ids else ""))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SHARDS)))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
    levels = most.bit_length()
    number = (F.row_number().over(order).cast("long") - 1) * SHARDS + F.col("shard")
    return pieces.withColumns({"sequence_id": number * levels + F.round(F.log2("length")).cast("long"), "offset": F.lit(0).cast("long"), "bucket": F.col("length")}).drop("shard")


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences (from pack(with_ids=True)) as Parquet, a folder per length."""
    packed.write.partitionBy("bucket").parquet(path)
