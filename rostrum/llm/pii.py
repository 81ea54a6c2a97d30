"""Personal data by patterns, widened by bootstrapped contextual extraction.

Fixed patterns find the base spans; they are the seeds. Each seed and each other
stretch of text with an identifier's shape, whatever it stands in and with inner
blanks or without, is an instance, and the one or two words before it are a lexical
pattern; what is glued to an instance is split into words at its delimiters. Spark scores the graph of patterns and instances in
rounds: a pattern's confidence in a kind is the share of all its occurrences in
the corpus, whatever follows, that known instances of that kind follow; an
instance's is the noisy-or over the patterns it occurs with. Accepted instances
become known: they strengthen patterns and bring further ones to the support, until
a round accepts nothing new. What the rounds accept is added to the base spans; base
spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import Scratch, fresh, rows, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: from inside one it would fail or succeed as the run did.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r" ?(?:@|\[at\]|\(at\)) ?", re.IGNORECASE)
SITE = re.compile(r"[\w.-]+")
COLONS = re.compile(r"(?<![\w:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![\w:])")
RUN = re.compile(r"[0-9](?:[().+-]{0,3}[0-9])*+")
GAP = re.compile(r"[ ().+-]{1,4}")
NOT_DIGIT = re.compile(r"[^0-9]")
BITS = 1 << 22


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @ outwards, so that long texts without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def shown(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shapes(token: str) -> list[str]:
    """The kinds that a token could be by its shape alone."""
    out = []
    digits = len(NOT_DIGIT.sub("", token))
    plain = len(re.sub(r"[0-9 ().+-]", "", token)) == 0
    if re.fullmatch(r"[\w.%+-]+ ?(@|\[at\]|\(at\)) ?[\w.-]+", token, re.IGNORECASE):
        out.append("email")
    if re.fullmatch(r"[0-9]{1,3}([.:-][0-9]{1,3}){3}", token) or re.fullmatch(r"[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{0,4}){3,7}", token):
        out.append("ip")
    if plain and 12 <= digits <= 19:
        out.append("card")
    if plain and 7 <= digits <= 15:
        out.append("phone")
    return out


def word_before(text: str, end: int) -> tuple[str, int]:
    """The word that ends before a place, as patterns see it, and where it starts: a token, or its last word with the delimiters after it where no blank is between."""
    glued = end > 0 and not text[end - 1].isspace()
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    if glued:
        while start > 0 and not text[start - 1].isalnum() and not text[start - 1].isspace():
            start -= 1
        while start > 0 and text[start - 1].isalnum():
            start -= 1
    else:
        while start > 0 and not text[start - 1].isspace():
            start -= 1
    return DIGIT.sub("0", text[start:end].lower()), start


def context_hash(one: str, two: str) -> tuple[int | None, int | None]:
    """Hashes of the one-word and two-word pattern, as signed 64-bit numbers; none at a text's start."""
    if not one:
        return None, None
    a = xxhash.xxh64_intdigest(one)
    return a - (1 << 63), xxhash.xxh64_intdigest(two + "\x1f" + one) - (1 << 63)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of an email's or a colon-separated address's shape, each email found from its mark outwards."""
    done = 0
    for mark in AT.finditer(text):
        start = mark.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        while start < mark.start() and text[start] == ".":
            start += 1
        site = SITE.match(text, mark.end())
        end = mark.end() + len(site[0].rstrip(".")) if site else 0
        done = mark.end()
        if start < mark.start() and end > mark.end():
            yield start, end
            done = end
    if text.count(":") > 2:
        yield from (m.span() for m in COLONS.finditer(text))


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and signs between delimiters; a run too short for an identifier goes on over blanks, as far as one can reach."""
    runs: list[tuple[int, int, int]] = []  # start, end, digits

    def joined() -> Iterator[tuple[int, int]]:
        for i, (start, end, digits) in enumerate(runs):
            if digits < 7 and not shapes(text[start:end]):
                for _, further, more in runs[i + 1 : i + 19]:
                    if (digits := digits + more) > 19:
                        break
                    end = further
            yield start, end

    at = 0
    while found := DIGIT.search(text, at):
        start, at = found.start(), RUN.match(text, found.start()).end()
        first = start
        while start > first - 2 and start > 0 and text[start - 1] in "(+":
            start -= 1
        if runs and not GAP.fullmatch(text, runs[-1][1], first):
            yield from joined()
            runs = []
        if (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or text[at : at + 1].isalnum() or text[at : at + 1] == "_":
            yield from joined()
            runs = []
        else:
            runs.append((start, at, len(NOT_DIGIT.sub("", text[first:at]))))
    yield from joined()


def candidates(text: str, taken: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, possible kinds) of the stretches with an identifier's shape that hold none of the places in taken, at most one from a start."""

    def free(a: int, b: int) -> bool:
        return not len(taken) or np.searchsorted(taken, a) == np.searchsorted(taken, b)

    named = []
    for a, b in addresses(text) if "@" in text or ":" in text or "]" in text or ")" in text else ():
        if free(a, b) and (kinds := shapes(text[a:b])):
            named.append((a, b))
            yield a, b, kinds
    if DIGIT.search(text) is None:
        return
    if named:
        taken = np.unique(np.concatenate([taken, *(np.arange(a, b) for a, b in named)]))
    for a, b in numbers(text):
        if b - a > 6 and (kinds := shapes(text[a:b])) and free(a, b):
            yield a, b, kinds


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple]:
    """(start, end, known kind or null, possible kinds, instance, one-word pattern, two-word pattern)."""
    taken = np.zeros(0, dtype=np.int64)
    if spans:
        taken = np.unique(np.concatenate([np.arange(a, b) for _, a, b in spans]))
    for kind, a, b in spans:
        one, at = word_before(text, a)
        two, _ = word_before(text, at)
        yield (a, b, kind, [kind], xxhash.xxh64_intdigest(text[a:b]) - (1 << 63), *context_hash(one, two))
    for start, end, kinds in candidates(text, taken):
        one, left = word_before(text, start)
        two, _ = word_before(text, left)
        yield (start, end, None, kinds, xxhash.xxh64_intdigest(text[start:end]) - (1 << 63), *context_hash(one, two))


OCCURRENCE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("kinds", pa.list_(pa.string())), ("instance", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
SCANNED = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("spans", pa.list_(pa.string())), ("found", pa.list_(OCCURRENCE))])
SCANNED_DDL = "doc_id long, row string, spans array<string>, found array<struct<start:int,stop:int,kind:string,kinds:array<string>,instance:long,one:long,two:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, row, text in rows(batch, "doc_id", "row", "text"):
            spans = base_spans(text)
            found = [dict(zip(("start", "stop", "kind", "kinds", "instance", "one", "two"), o)) for o in occurrences(text, spans)]
            out.append({"doc_id": doc_id, "row": row, "spans": [shown([s]) for s in spans], "found": found})
        yield pa.RecordBatch.from_pylist(out, schema=SCANNED)


def pattern_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern's words occur before any word at all, over all texts.

    A bitmap of 4 million bits, whatever the number of patterns, tells which
    contexts are worth counting; the join afterwards drops its false hits.
    """
    spark = texts.sparkSession
    slots = patterns.select(F.pmod("pattern", F.lit(BITS)).cast("int").alias("slot")).distinct()
    words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 32)")).alias("bits"))
    bitmap = np.zeros(BITS // 32, dtype=np.uint32)
    for word, bits in words.toLocalIterator():  # at most BITS / 32 rows
        bitmap[word] = bits
    held = spark.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        hashes: dict[str, int] = {}
        for batch in batches:
            seen: list[np.ndarray] = []
            for (text,) in rows(batch, "text"):
                tokens = text.lower().split()
                if DIGIT.search(text):
                    tokens = [DIGIT.sub("0", t) for t in tokens]
                if len(hashes) > 300_000:
                    hashes.clear()
                one = []
                for t in tokens[:-1]:
                    if (h := hashes.get(t)) is None:
                        h = xxhash.xxh64_intdigest(t)
                        if len(t) <= 64:  # longer ones are hashed each time, so that memory is bounded
                            hashes[t] = h
                    one.append(h)
                if not one:
                    continue
                single = (np.array(one, dtype=np.uint64) - np.uint64(1 << 63)).astype(np.uint64)
                slot = (single & np.uint64(BITS - 1)).astype(np.int64)
                hit = (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
                seen.append(single[hit])
                # Two words are only hashed where a pattern of two words could stand: after a marked second word.
                where = np.flatnonzero(hit)
                pairs = [xxhash.xxh64_intdigest((tokens[i - 1] if i else "") + "\x1f" + tokens[i]) for i in where]
                seen.append(np.array(pairs, dtype=np.uint64) - np.uint64(1 << 63))
            if seen:
                pattern, total = np.unique(np.concatenate(seen), return_counts=True)
                slot = (pattern & np.uint64(BITS - 1)).astype(np.int64)
                hit = (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(pattern[hit].view(np.int64)), pa.array(total[hit].astype(np.int64))], names=["pattern", "total"])

    counted = texts.select("text").mapInArrow(count, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return counted.join(patterns.select("pattern").distinct(), "pattern", "left_semi")


def discover(texts: DataFrame, found: DataFrame, support: int, confidence: float, scratch: Scratch) -> DataFrame | None:
    """(instance, kind) pairs that the rounds accept, or None when there are none.

    found has an occurrence a row. A pattern needs `support` different known
    instances of a kind; patterns and instances need `confidence`. Known instances
    only become more, so the rounds end: with the first that adds none.
    """
    graph = found.select("instance", "kind", "kinds", F.explode(F.array("one", "two")).alias("pattern")).where("pattern IS NOT NULL")
    candidates = graph.where("kind IS NULL").groupBy("pattern", "instance", "kinds").agg(F.count("*").alias("n"))
    seeds = graph.where("kind IS NOT NULL").groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    # Only patterns of candidates can discover anything; pairs are distinct before they are shuffled.
    candidates = scratch.stored(candidates, "candidates")
    seeds = scratch.stored(seeds.join(candidates.select("pattern").distinct(), "pattern", "left_semi"), "seeds")
    if seeds.groupBy("pattern", "kind").agg(F.count("*").alias("different")).where(F.col("different") >= support).isEmpty():
        return None
    # Whatever is accepted, a pattern never has more known instances of a kind than seeds and possible candidates of it.
    possible = seeds.select("pattern", "kind").unionAll(candidates.select("pattern", F.explode("kinds").alias("kind")))
    patterns = scratch.stored(possible.groupBy("pattern", "kind").agg(F.count("*").alias("different")).where(F.col("different") >= support).select("pattern").distinct(), "patterns")
    firsts = found.select("one", F.explode(F.array("one", "two")).alias("pattern")).join(patterns, "pattern", "left_semi").select(F.col("one").alias("pattern")).distinct()
    # Words glued to an instance never stand alone, so a pattern occurs at least as often as it precedes identifiers.
    glued = candidates.select("pattern", "n").unionByName(seeds.select("pattern", "n")).groupBy("pattern").agg(F.sum("n").alias("least"))
    counted = pattern_totals(texts, patterns.union(firsts).distinct())
    totals = patterns.join(glued, "pattern").join(counted, "pattern", "left").select("pattern", F.greatest("least", F.coalesce("total", F.lit(0))).alias("total"))
    totals = scratch.stored(totals, "totals")
    known, accepted = seeds, None
    while True:
        scored = known.groupBy("pattern", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("n")).where(F.col("different") >= support)
        scored = scored.join(totals, "pattern").select("pattern", "kind", F.least(F.col("n") / F.col("total"), F.lit(0.999)).alias("confidence")).where(F.col("confidence") >= confidence / 2)
        noisy = candidates.join(scored, "pattern").where(F.array_contains("kinds", F.col("kind"))).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = noisy.where(F.col("score") >= confidence).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        if accepted is not None:
            best = best.join(accepted.select("instance"), "instance", "left_anti").unionByName(accepted)
        best = scratch.stored(best, "accepted")
        grown = best.count() > (accepted.count() if accepted is not None else 0)
        accepted = best
        if not grown:
            return accepted
        known = scratch.stored(seeds.unionByName(candidates.join(accepted, "instance").select("pattern", "instance", "kind", "n")), "known")


def row_key():
    """Tells rows apart by doc_id and text, in a shape that joins nulls too."""
    return F.concat_ws(":", "doc_id", F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def find(docs: DataFrame, support: int = 3, confidence: float = 0.5, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row (with_text: text and row as well).

    The counts and base_sha256 are of the base spans; spans has all. Null and
    empty texts have no spans; repeated rows come back each; rows that share
    doc_id and text share their spans; null doc_ids are kept; texts and tokens of
    any length are read whole; of kinds that score alike the last by name is taken;
    an empty table gives no rows; other columns are ignored.
    """
    with Scratch() as scratch:
        return stored(_found(docs, support, confidence, with_text, scratch), "personal")


def _found(docs: DataFrame, support: int, confidence: float, with_text: bool, scratch: Scratch) -> DataFrame:
    named = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("row", row_key())
    scanned = scratch.stored(named.mapInArrow(_scan, SCANNED_DDL), "scanned")
    found = scanned.where(F.size("found") > 0).select("row", F.inline("found"))
    accepted = discover(named, found, support, confidence, scratch)
    out = scanned.select("doc_id", "row", "spans")
    if accepted is None:
        out = out.withColumn("more", F.array().cast("array<string>"))
    else:
        extra = found.where("kind IS NULL").join(accepted.withColumnRenamed("kind", "as_kind"), "instance")
        extra = extra.groupBy("row").agg(F.collect_set(F.concat_ws(":", "as_kind", "start", "stop")).alias("more"))
        out = out.join(extra, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    place = F.array(*map(F.lit, KINDS))

    def key(span):
        part = F.split(span, ":")
        return F.struct(F.array_position(place, part[0]).alias("k"), part[1].cast("int").alias("a"), part[2].cast("int").alias("b"), span.alias("s"))

    together = F.array_sort(F.transform(F.array_union("spans", "more"), key))
    kinds = F.transform("spans", lambda s: F.split(s, ":")[0])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    out = out.select("doc_id", *counts, F.sha2(F.array_join("spans", ","), 256).alias("base_sha256"), F.array_join(F.transform(together, lambda t: t["s"]), ",").alias("spans"), "row")
    return out if with_text else out.drop("row")


def mask(text: str, spans: str) -> str:
    """The text with each span as its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns and any names, with every found span of text masked.

    Null texts stay null, empty ones empty; repeated rows stay and are masked alike;
    null doc_ids and texts of any length as in find(); of overlapping spans the
    first names the mask; an empty table gives none.
    """
    key, mark = fresh(docs, "row_key", "row_spans")
    spans = find(docs, with_text=True, **how).select(F.col("row").alias(key), F.col("spans").alias(mark)).where(F.col(mark) != "").dropDuplicates([key])
    joined = docs.withColumn(key, row_key()).join(spans, key, "left").drop(key)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([mask(t, s) if t is not None and s else t for t, s in rows(batch, "text", mark)], type=batch.schema.field(at).type)
            columns = [new if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != mark]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != mark])

    return joined.mapInArrow(of, docs.schema)
