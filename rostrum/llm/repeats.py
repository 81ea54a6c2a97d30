"""Removal of long byte strings that occur more than once.

A byte goes when a window of `length` bytes that covers it also starts anywhere
else. Windows are told apart exactly, without a list of all of them:

1. The first part of every window holds an anchor, the least hash of its 16-byte
   strings, so two equal windows have the same anchor at the same place. Around an anchor,
   windows form a block of neighbouring starts; all of them share the block's
   core, and all lie in its hull.
2. Blocks whose core occurs nowhere else hold no repeated window. Blocks whose
   hull occurs elsewhere hold repeated windows only. The others are cut into
   narrower blocks, down to single windows, where core and hull are the window.
   One block per hull stays as a partner while its core has undecided company.

Spark counts cores and hulls after summing them up in each task, so a passage
that a third of all documents share is one row per task; texts are read where
their blocks are cut. Equal texts are one text: cores are counted over all rows by
64 bits of a text's SHA-256, and of the blocks that then remain only those of one row a
text stay, so blocks of all rows are moved once. A core's hash has 64 bits: a collision
costs a look at more blocks. What is removed is decided by hulls, whose hashes have 128.

README.md says why the merging of Burrows-Wheeler transforms is not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, lists, named as named_texts, rows, stored
from rostrum.llm.passages import BLOCK, Blocks, Words, blocks_of, columns, cut_up, hashes, narrower, placed, shared_words, slid, word_widths

GRAM = 16
#: Windows whose anchors are sought at once: places among them and in the widest block have 16 bits.
SEGMENT = 1 << 15
#: Words of 64 bits in the bitmap of texts that are read again: 2 MB, however many texts there are.
BITS = 1 << 18


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from every place on."""
    x = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    h = x[8:] * np.uint64(0x9E3779B97F4A7C15)
    h ^= x[:-8]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, length: int) -> np.ndarray:
    """The places of the least hash (16 bits of it), leftmost of equals, in the first part of each window."""
    n, reach = len(text), widths(length)[0]
    out: list[np.ndarray] = []
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, n - length + 1, SEGMENT):
        starts = min(SEGMENT, n - length + 1 - at)
        h = grams(data[at : at + starts + reach + GRAM - 2])
        least = ((h >> np.uint64(48)).astype(np.uint32) << np.uint32(16)) | np.arange(len(h), dtype=np.uint32)
        place = slid(least, reach)[:starts] & np.uint32(0xFFFF)
        out.append(place[np.r_[True, place[1:] != place[:-1]]].astype(np.int64) + at)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def widths(length: int) -> list[int]:
    """Widths of blocks, each dividing the one before: from all places of an anchor in two thirds of a window down to 1."""
    most = min(length * 2 // 3, length - GRAM + 1, SEGMENT)
    out = [1]
    while out[-1] * 4 <= most:
        out.append(out[-1] * 4)
    return list(dict.fromkeys([most // out[-1] * out[-1], *out[::-1]]))


def blocks(text: bytes, tops: np.ndarray, width: int, length: int) -> Blocks:
    """Blocks of the windows that start at top - width + 1 to top; no hull where the text ends before it, no block without windows."""
    n = len(text)
    tops = tops[(tops >= 0) & (tops - width + 1 <= n - length)]
    low, high = tops - width + 1, tops + length
    return tops, *hashes(memoryview(text), (tops, low + length), (low, high), (low >= 0) & (high <= n))


def among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts whose (d, x) may be in ids, by a bitmap that all executors get, so that few others are moved by the join that follows."""
    at, bit = F.pmod(F.xxhash64("d", "x"), F.lit(BITS)).alias("at"), F.pmod(F.shiftright(F.xxhash64("d", "x"), 32), F.lit(64)).cast("int").alias("bit")
    bitmap = ids.select(at, bit).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return texts.select("*", at, bit).join(F.broadcast(bitmap), "at").where(F.getbit("bits", "bit") == 1).drop("at", "bit", "bits")


def remove_repeats(docs: DataFrame, length: int = 400, with_bytes: bool = False, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row (with_bytes: kept, the bytes that stay; words: n_shared_words, see passages.py).

    n_shared_words counts the words in passages of at least `words` words that another
    row has too, also where these are fewer than `length` bytes; they are not removed.

    Texts are UTF-8 bytes; null is the empty text; windows never cross rows and are
    judged on the input. A text of at least `length` bytes that another row equals
    loses everything, each of several copies alike. Rows with one doc_id, null or
    not, are rows of their own. Strings are taken for equal by 128-bit hashes of
    their bytes. Very long texts are hashed segment by segment. An empty table gives
    no rows; other columns are ignored.
    """
    steps = widths(length)
    texts_of = named_texts(docs)
    heads_schema = pa.schema([("doc_id", pa.int64()), ("d", pa.int64()), ("x", pa.int64()), ("r", pa.int64()), ("sha", pa.string()), ("t", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64())])
    first = word_widths(words)[0] if words else 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: list[tuple] = []
            by_byte: list[Blocks] = []
            by_word: list[Blocks] = []
            for doc_id, d, x, r, text in rows(batch, "doc_id", "d", "x", "r", "text"):
                data = text.encode()
                by_byte.append(blocks(data, anchors(data, length), steps[0], length))
                told = Words(text) if words else None
                if told:
                    by_word.append(told.blocks(told.anchors(words, first), first, words))
                sha = hashlib.sha256(data)
                heads.append((doc_id, d, x, r, sha.hexdigest(), int.from_bytes(sha.digest()[:8], signed=True), len(data), told.n if told else 0))
            if heads:
                lists_of = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()), pa.StructArray.from_arrays(columns(found), names=[n for n, _ in BLOCK])) for found in (by_byte, by_word or [(np.zeros(0, np.int64), np.zeros(0, np.int64), [])] * len(heads))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(zip(*heads), heads_schema)), *lists_of], names=[*heads_schema.names, "blocks", "word_blocks"])

    def cut(batches: Iterator[pa.RecordBatch], width: int, narrow: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from blocks_of(batch, [blocks(text.encode(), tops, narrow, length) for text, tops in narrower(batch, width, narrow)])

    result = pa.schema([("d", pa.int64()), ("x", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_bytes else [])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat, ends = lists(batch.column(batch.schema.get_field_index("spans")))
            lows, highs = (flat.field(n).to_numpy() for n in ("low", "high"))
            for k, (d, x, text) in enumerate(rows(batch, "d", "x", "text")):
                data, low, high = text.encode(), lows[ends[k] : ends[k + 1]], highs[ends[k] : ends[k + 1]]
                order = np.argsort(low)
                low, high = low[order], np.maximum.accumulate(high[order])
                apart = low[1:] > high[:-1]
                low, high = low[np.r_[True, apart]].tolist(), high[np.r_[apart, True]].tolist()
                kept = b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)]))
                out.append((d, x, len(data) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), result)], names=result.names)

    with Scratch() as scratch:
        found = "array<struct<top:int,core:long,hull:binary>>"
        # r tells rows apart; it is written with them.
        scanned = texts_of.withColumn("r", F.monotonically_increasing_id()).mapInArrow(scan, f"doc_id long, d long, x long, r long, sha string, t long, n_bytes long, n_words long, blocks {found}, word_blocks {found}")
        scanned = scratch.stored(scanned, "scanned")
        heads = scratch.stored(scanned.select("doc_id", "d", "x", "r", "sha", "n_bytes", "n_words"), "heads")
        classes = heads.groupBy("sha", "n_bytes", "n_words").agg(F.count("*").alias("copies"), F.min(F.struct("d", "x", "r")).alias("one"))
        classes = scratch.stored(classes.select("sha", "n_bytes", "n_words", "copies", F.col("one.d").alias("d"), F.col("one.x").alias("x"), F.col("one.r").alias("r")), "classes")
        # Of a core, bytes count places, also those of one text, words count texts.
        every = scanned.select(F.lit(False).alias("of_words"), "r", "d", "x", "t", F.inline("blocks")).withColumn("place", F.xxhash64("t", "top")).drop("t")
        if words:
            every = every.unionByName(scanned.select(F.lit(True).alias("of_words"), "r", "d", "x", F.col("t").alias("place"), F.inline("word_blocks")))
        # Counts are written before they are joined: a core that a third of all texts hold then is a skewed join, which Spark splits.
        more = scratch.stored(every.groupBy("of_words", "core").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least != most").select("of_words", "core"), "cores")
        first_blocks = every.drop("place").join(more.hint("shuffle_hash"), ["of_words", "core"], "left_semi").join(classes.select("r"), "r", "left_semi")
        first_blocks = scratch.stored(first_blocks.select("of_words", "d", "x", "top", "core", "hull"), "blocks0")
        scratch.drop(scanned, more)
        ids = scratch.stored(first_blocks.select("d", "x").distinct(), "ids")
        # In buckets by (d, x), so that no narrowing step moves a text again.
        texts = scratch.bucketed(among(texts_of.select("d", "x", "text"), ids).join(ids, ["d", "x"], "left_semi").dropDuplicates(["d", "x"]), "repeat_texts", ["d", "x"])
        level = first_blocks.where("NOT of_words").drop("of_words")
        if words:
            with Scratch() as brief:
                shared = shared_words(brief, classes, texts, first_blocks.where("of_words").drop("of_words"), words)
            scratch.held.append(shared)

        decided = []
        for k, width in enumerate(steps):
            place = placed()
            hulls = level.where("hull IS NOT NULL").groupBy("hull").agg(F.count("*").alias("hulls"), F.min(place).alias("lead")).where("hulls > 1")
            hulls = scratch.stored(hulls.select("hull", "lead"), f"hulls{k}")
            known = level.join(hulls.hint("shuffle_hash"), "hull", "left").withColumn("sure", F.col("lead").isNotNull())
            known = scratch.stored(known.select("d", "x", "top", "core", "sure", (F.col("lead") == place).alias("leads")), f"known{k}")
            scratch.drop(first_blocks, level, hulls)
            decided.append(known.where("sure").select("d", "x", F.greatest(F.col("top") - width + 1, F.lit(0)).alias("low"), (F.col("top") + length).alias("high")))
            if width == 1:
                break
            company = known.groupBy("core").agg(F.count("*").alias("cores"), F.count_if(~F.col("sure")).alias("unsure")).where("cores > 1 AND unsure > 0")
            company = scratch.stored(company.select("core"), f"company{k}")
            going = known.where("NOT sure OR leads").join(company.hint("shuffle_hash"), "core", "left_semi")
            narrow = steps[k + 1]
            level = scratch.stored(cut_up(texts, going, partial(cut, width=width, narrow=narrow)), f"blocks{k + 1}")
            scratch.drop(company)

        spans = reduce(DataFrame.unionByName, decided).groupBy("d", "x").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        removed = texts.join(spans.hint("shuffle_hash"), ["d", "x"]).select("d", "x", "text", "spans").mapInArrow(apply, "d long, x long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else ""))
        per = classes.join(scratch.stored(removed, "removed"), ["d", "x"], "left").drop("d", "x", "r", "n_words")
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
        per = per.select(
            "sha", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
        ).where("n_removed > 0")
        out = heads.drop("r", "n_words").join(scratch.stored(per, "per"), "sha", "left")
        if with_bytes:
            text = texts_of.select("d", "x", F.encode("text", "utf-8").alias("whole")).dropDuplicates(["d", "x"])
            out = out.join(text, ["d", "x"]).withColumn("kept", F.coalesce("kept", "whole"))
        if words:
            out = out.join(shared, "sha", "left").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0)).cast("long"))
        out = out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_bytes else []), *(["n_shared_words"] if words else []))
        return stored(out, "unrepeated")
