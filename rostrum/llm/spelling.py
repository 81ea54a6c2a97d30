"""Spelling variants: words of one edit, from positional q-gram indexes with a count filter.

One edit lies within one half of a word and leaves the other as it is. So words of s
and s + 1 code points meet in groups: those that agree, but for one half, in all the
rest. A group of more than GROUP words is dealt out by halves of that half, and so on
down to one code point, where a group has no more words than the alphabet allows; so
no group grows with the corpus, whatever words have in common.

A group has an inverted index of positional q-grams. A word merges the posting lists
of its grams with a heap: those of its own length and place, and of the next length
at the same place or one on. One edit destroys at most q grams, and the rest of the
two words, outside the piece, agrees; so a near word is met as often as the bound
that is left of the longer word's grams. Words above it are held against the word
itself.
"""

from __future__ import annotations

import heapq
import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, chunks, rows, stored

LEAST = 7
#: Code points of a gram.
Q = 2
#: Words of a group that is not dealt out further.
GROUP = 256
#: Different words that a task counts before it sends them on.
HELD = 200_000
RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("a", pa.string()), ("an", pa.int64()), ("b", pa.string()), ("bn", pa.int64())])


def misspelt(doc_id: int | None, run: str) -> str:
    """The run, or where 31 divides its crc32 with the doc_id (null as nothing), the run without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all words of at least LEAST code points with at least two occurrences."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held: Counter[str] = Counter()
            for batch in batches:
                for doc_id, text in rows(batch, "doc_id", "text"):
                    if text:
                        for run, n in Counter(RUNS.findall(text.lower() if text.isascii() else text.translate(LOWER))).items():
                            held[misspelt(doc_id, run)] += n
                        if len(held) > HELD:
                            yield from held.items()
                            held.clear()
            yield from held.items()

        yield from chunks(((w, n) for w, n in each() if len(w) >= LEAST), WORD)

    found = docs.select("doc_id", "text").mapInArrow(of, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point replaced or, if longer by one, inserted."""
    if a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def near_in_group(lo: int, hi: int, s: int, group: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs (a, its n, b, its n) of one edit within [lo, hi) of a, of s code points; the words of the group agree outside, and a word of s + 1 has its further code point inside."""
    postings: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    first = max(0, lo - Q + 1)
    for k, (word, _) in enumerate(group):
        for place in range(first, min(hi + len(word) - s, len(word) - Q + 1)):
            postings[word[place : place + Q], place, len(word)].append(k)
    # What a word of a size must share of the grams that touch the piece: all but q, of which those outside are shared by all.
    least = {size: min(hi + size - s, size - Q + 1) - first - Q for size in (s, s + 1)}
    everyone = [k for k, (word, _) in enumerate(group) if least[len(word)] < 1]
    for k, (word, n) in enumerate(group):
        if len(word) != s:
            continue
        lists = [everyone] if everyone else []
        for place in range(first, min(hi, s - Q + 1)):
            gram = word[place : place + Q]
            lists += [postings[at] for at in ((gram, place, s), (gram, place, s + 1), (gram, place + 1, s + 1)) if at in postings]
        for other, met in groupby(heapq.merge(*lists)):
            b, m = group[other]
            # Of two words of one size, the lesser finds the other.
            if (len(b) > s or other > k) and sum(1 for _ in met) >= least[len(b)] and one_edit(word, b):
                yield word, n, b, m


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one edit from rows that come sorted by hash, place and what lies outside of the place."""

    def each() -> Iterator[tuple]:
        stream = (r for batch in batches for r in rows(batch, "s", "lo", "hi", "outside", "word", "n"))
        for (s, lo, hi, _), group in groupby(stream, key=lambda r: r[:4]):
            yield from near_in_group(lo, hi, s, [(word, n) for *_, word, n in group])

    yield from chunks(each(), NEAR)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, an, b, bn): every pair of words that differ by exactly one code point, once."""
    size, s = F.char_length("word"), F.col("s")

    def dealt(rows: DataFrame) -> DataFrame:
        """word, n, s and two halves [lo, hi) of the piece [low, high), with the hash of the group."""
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("high").alias("hi")))
        out = rows.withColumn("half", F.explode(halves)).select("word", "n", "s", "half.lo", "half.hi")
        return out.withColumn("h", F.xxhash64("s", "lo", "hi", outside))

    outside = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", F.col("hi") + size - s + 1, size))
    whole = words.withColumn("s", F.explode(F.array(size, size - 1))).where(s >= LEAST).select("word", "n", F.col("s").cast("int").alias("s"), F.lit(0).alias("low"), F.col("s").cast("int").alias("high"))
    found: DataFrame | None = None
    while True:
        entries = dealt(whole)
        often = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
        met = scratch.stored(entries.join(often, "h"), "groups")
        hot = (F.col("m") > GROUP) & (F.col("hi") - F.col("lo") > 1)
        ready = met.where(~hot).withColumn("outside", outside).repartition("h").sortWithinPartitions("h", "s", "lo", "hi", "outside", "word")
        pairs = scratch.stored(ready.mapInArrow(near, "a string, an long, b string, bn long"), "near")
        found = pairs if found is None else found.union(pairs)
        whole = met.where(hot).select("word", "n", "s", F.col("lo").alias("low"), F.col("hi").alias("high"))
        if whole.isEmpty():
            return found.distinct()


def variants(docs: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus.

    Words are maximal runs of Latin letters, A-Z lower-cased, of at least 7 code points
    and two occurrences; a word's form is its commonest near word, of equal ones the
    least in code-point order, if that occurs `times` as often, or null. root follows
    forms to the last one; each form has ten times the occurrences of the one before,
    so pointers that double need five rounds at most.

    Null and empty texts have no words; a null doc_id is an empty one in the hash;
    repeated rows count each; a very long run is a word like any other; an empty table
    gives no rows; other columns are ignored.
    """
    if times < 2:
        raise ValueError("a form must be commoner than its word")
    with Scratch() as scratch:
        words = scratch.stored(word_counts(docs), "words")
        pairs = scratch.stored(near_words(words, scratch), "pairs")
        both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("n"), F.col("b").alias("form")).alias("other"))
        both = both.union(pairs.select("b", F.struct((-F.col("an")).alias("n"), F.col("a").alias("form"))))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("other"))
        found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("other.n") >= times * F.col("n"), F.struct(F.col("other.form").alias("form"), (-F.col("other.n")).alias("n"))).alias("f"))
        found = scratch.stored(found.select("word", "n", "n_near", "f.form", F.col("f.n").alias("form_n")), "forms")
        roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
        while True:
            above = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
            roots = scratch.stored(roots.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
            if roots.where("moved").isEmpty():
                break
            roots = roots.drop("moved")
        return stored(found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
