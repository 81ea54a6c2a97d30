"""Words in passages that different documents share, exactly, without a list of all windows.

A passage is `words` words in a row, told apart by their bytes whatever blanks part
them. The steps are those of repeats.py on words: windows with one anchor (the least
hash of the 16 bytes from a word on, within the first part) form a block; blocks whose
core no other text has hold no shared window, blocks whose hull another text has hold
shared windows only, the others are cut down to single windows. Two blocks per hull, of
different texts, stay as partners while their core has undecided company.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, lists, stored

SEGMENT = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
BLOCK = (("top", pa.int32()), ("core", pa.int64()), ("hull", pa.binary()))
#: Blocks of one text: tops, hashes of cores, hashes of hulls.
Blocks = tuple[np.ndarray, np.ndarray, list[bytes | None]]


def slid(least: np.ndarray, reach: int) -> np.ndarray:
    """The minimum of every `reach` neighbours."""
    size = 1
    while size * 2 <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: size - reach], least[reach - size :]) if size < reach else least


class Words:
    """A text's words, joined by one blank each; slices of them are bytes."""

    def __init__(self, text: str) -> None:
        self.data = b" ".join(text.encode().split())  # bytes split at [\x20\x09-\x0D]+ alone
        ends = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 32) + 1
        self.starts = np.concatenate([[0], ends, [len(self.data) + 1]]) if self.data else np.zeros(1, np.int64)
        self.n = len(self.starts) - 1

    def anchors(self, words: int, reach: int) -> np.ndarray:
        """The words of the least hash, leftmost of equals, among the first `reach` of each window."""
        if self.n < words:
            return np.zeros(0, np.int64)
        # Sixteen bytes from a word on are nine words at most, so they lie in each window that has the word among its first `reach`.
        padded = self.data + bytes(16)
        at8 = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = []
        for low in range(0, self.n - words + 1, SEGMENT):
            many = min(SEGMENT, self.n - words + 1 - low)
            at = self.starts[low : low + many + reach - 1]
            with np.errstate(over="ignore"):
                h = (at8[at] ^ (at8[at + 8] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            least = slid(((h ^ (h >> np.uint64(29))) & ~PLACE) | np.arange(len(h), dtype=np.uint64), reach)
            place = (least & PLACE).astype(np.int64)
            out.append(place[np.r_[True, place[1:] != place[:-1]]] + low)
        return np.unique(np.concatenate(out))

    def blocks(self, tops: np.ndarray, width: int, words: int) -> Blocks:
        """Blocks of the windows from top - width + 1 to top; no hull where the text ends before it, no block without windows."""
        tops = tops[(tops >= 0) & (tops - width + 1 <= self.n - words)]
        low, high, at = tops - width + 1, tops + words, self.starts
        hulls = at[np.maximum(low, 0)], at[np.minimum(high, self.n)] - 1
        return tops, *hashes(memoryview(self.data), (at[tops], at[low + words] - 1), hulls, (low >= 0) & (high <= self.n))


def hashes(data: memoryview, cores: tuple[np.ndarray, np.ndarray], hulls: tuple[np.ndarray, np.ndarray], whole: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """64-bit hashes of the cores and 128-bit ones of the hulls that are whole; both are slices of data, from and to."""
    core = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(*(c.tolist() for c in cores))]
    hull = [xxhash.xxh3_128_digest(data[a:b]) if w else None for a, b, w in zip(*(h.tolist() for h in hulls), whole.tolist())]
    return np.array(core, np.uint64).view(np.int64), hull


def columns(found: list[Blocks]) -> list[pa.Array]:
    """top, core and hull of the blocks of several texts."""
    numbers = [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1)]
    return [pa.array(c, t) for c, (_, t) in zip((*numbers, list(chain.from_iterable(f[2] for f in found))), BLOCK)]


def blocks_of(batch: pa.RecordBatch, found: list[Blocks]) -> Iterator[pa.RecordBatch]:
    """d, x, top, core and hull of the blocks found in each text of a batch."""
    many = [len(f[0]) for f in found]
    if sum(many):
        ids = [pa.array(np.repeat(batch.column(batch.schema.get_field_index(n)).to_numpy(), many)) for n in ("d", "x")]
        yield pa.RecordBatch.from_arrays([*ids, *columns(found)], names=["d", "x", *(n for n, _ in BLOCK)])


def narrower(batch: pa.RecordBatch, width: int, narrow: int) -> Iterator[tuple[str, np.ndarray]]:
    """text of each row of a batch, and the tops of the blocks of width narrow that its blocks of the given width are cut into."""
    flat, ends = lists(batch.column(batch.schema.get_field_index("tops")))
    tops = flat.to_numpy().astype(np.int64)
    texts = batch.column(batch.schema.get_field_index("text"))
    for k in range(batch.num_rows):
        yield texts[k].as_py(), np.unique(tops[ends[k] : ends[k + 1], None] - np.arange(0, width, narrow))


def cut_up(texts: DataFrame, level: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What cut makes of the texts of a level's blocks; it gets d, x, text and tops. Texts stay where they are and are not sorted."""
    per_text = level.groupBy("d", "x").agg(F.collect_list("top").alias("tops"))
    return texts.join(per_text.hint("shuffle_hash"), ["d", "x"]).select("d", "x", "text", "tops").mapInArrow(cut, "d long, x long, top int, core long, hull binary")


def several() -> Column:
    """Whether the rows of a group are of more than one text."""
    return (F.min("d") != F.max("d")) | (F.min("x") != F.max("x"))


def placed() -> Column:
    """A block's text (44 bits of a hash) and place in one number, by which hulls are summed up in hash tables; in order of texts, so that the least and the last of several texts are of different ones."""
    return F.xxhash64("d", "x").bitwiseAND(F.lit(~int(PLACE))).bitwiseOR(F.col("top").cast("long").bitwiseAND(F.lit(int(PLACE))))


def word_widths(words: int) -> list[int]:
    """Widths of blocks in words: as many words of a window, from its first on, may be its anchor; each divides the one before."""
    if words < 16:
        raise ValueError("passages of 16 words at least")
    # An anchor's bytes are nine words at most, which lie in the window.
    first = min(words * 2 // 3, words - 8) // 8 * 8
    return [first, 8, 1] if first > 8 else [8, 1]


def shared_words(scratch: Scratch, classes: DataFrame, texts: DataFrame, level: DataFrame, words: int) -> DataFrame:
    """sha and n_shared_words: the words of a text that lie in `words` words in a row which another row has too.

    classes (sha, n_words, copies, d, x) has one row a text, texts (d, x, text) those of
    level, the blocks of the first width whose core another text has. Texts that share nothing are left out; all words
    of a text that several rows hold are shared. Words are maximal runs of bytes other
    than [\\x20\\x09-\\x0D], in their own case; a text's own repetitions do not count.
    Passages are taken for equal by 128-bit hashes.
    """
    steps = word_widths(words)

    def cut(batches: Iterator[pa.RecordBatch], width: int, narrow: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from blocks_of(batch, [Words(text).blocks(tops, narrow, words) for text, tops in narrower(batch, width, narrow)])

    decided = []
    for k, width in enumerate(steps):
        place = placed()
        hulls = level.where("hull IS NOT NULL").groupBy("hull").agg(several().alias("several"), F.min(place).alias("lead"), F.max(place).alias("last")).where("several").drop("several")
        hulls = scratch.stored(hulls, f"word_hulls{k}")
        known = level.join(hulls.hint("shuffle_hash"), "hull", "left").withColumn("sure", F.col("lead").isNotNull())
        known = scratch.stored(known.select("d", "x", "top", "core", "sure", ((F.col("lead") == place) | (F.col("last") == place)).alias("leads")), f"word_known{k}")
        scratch.drop(level, hulls)
        decided.append(known.where("sure").select("d", "x", (F.col("top") - width + 1).alias("low"), (F.col("top") + words).alias("high")))
        if width == 1:
            break
        company = known.groupBy("core").agg(several().alias("several"), F.count_if(~F.col("sure")).alias("unsure")).where("several AND unsure > 0")
        company = scratch.stored(company.select("core"), f"word_company{k}")
        going = known.where("NOT sure OR leads").join(company.hint("shuffle_hash"), "core", "left_semi")
        narrow = steps[k + 1]
        level = scratch.stored(cut_up(texts, going, partial(cut, width=width, narrow=narrow)), f"word_blocks{k + 1}")
        scratch.drop(company)

    spans = reduce(DataFrame.unionByName, decided).groupBy("d", "x").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.high - F.greatest(s.low, a.end))).alias("n"), F.greatest(a.end, s.high).alias("end")), lambda a: a.n)
    per = classes.join(spans.select("d", "x", covered.cast("long").alias("n")), ["d", "x"], "left")
    per = per.select("sha", F.when((F.col("copies") > 1) & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_shared_words"))
    return stored(per.where("n_shared_words > 0"), "shared_words")
