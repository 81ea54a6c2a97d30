"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand next to each other in no vocabulary string can
never end up in one token, so a word may be cut there for certain. The fragments
are encoded independently, remembered by their bytes, and concatenated.

The vocabulary's own merges run here on fragments; words come from the text by
the file's own pattern. Characters outside the ranges on which the pattern and
case tables of the two libraries are known to agree send the whole text to the
library that the file is written for, so results never depend on such tables.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rostrum.llm.common import chunks, rows, texts
from rostrum.llm.packing import byte_letters

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Latin letters, general punctuation and currency signs: old, stable parts of Unicode with plain case pairs.
SETTLED = regex.compile(r"[\t-\r\x20-\x7E\xA0-įĲ-ſ‐-‧‰-⁞₠-€]*")
#: A rank beyond any merge.
NEVER = 1 << 40


class ForcedBoundaryEncoder:
    """Encodes words by fragments; memory of words and fragments is bounded, the older half going first."""

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.text_of = {i: str(i) for i in self.names}
        self.letters = byte_letters()
        inside: set[str] = set()
        for token in self.vocab:
            bare = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            inside.update(bare[i : i + 2] for i in range(len(bare) - 1))
        #: Pairs of byte letters that some vocabulary string holds; any other pair forces a boundary.
        self.joined = frozenset(inside)
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(pre["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        known = kinds == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and spec["normalizer"]["normalizers"][1]["content"] == " " and pre["behavior"] == "Removed" and pre["invert"] and spec["decoder"] is None and spec["post_processor"] is None
        self.known = known and not model["dropout"] and not model["continuing_subword_prefix"] and not model["byte_fallback"] and not model["ignore_merges"] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.remembered = remembered
        self.seen: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[tuple[str, bool], list[int]] = {}

    def fragments(self, word: str) -> list[str]:
        """The word's byte letters, cut wherever no vocabulary string could cross."""
        shown = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        joined = self.joined
        cuts = [i for i, pair in enumerate(map(add, shown, shown[1:]), 1) if pair not in joined]
        return [shown[a:b] for a, b in zip([0, *cuts], [*cuts, len(shown)])]

    def merge(self, fragment: str, last: bool) -> list[int]:
        """The vocabulary's merges on one fragment, lowest rank and leftmost first."""
        parts = list(fragment)
        if last:
            parts[-1] += self.end
        if len(parts) > 64:
            return self._merge_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same with a heap, so that a very long fragment takes n log n steps."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p]

    def word(self, word: str) -> tuple[int, str, str]:
        """(tokens, their ids, their strings) of one word, the last two joined by spaces."""
        if (out := self.older.get(word)) is not None:
            self.seen[word] = out
            return out
        ids: list[int] = []
        cut = self.fragments(word)
        for k, fragment in enumerate(cut):
            key = (fragment, k == len(cut) - 1)
            if (got := self.parts.get(key)) is None:
                got = self.merge(*key)
                if len(cut) > 1 and len(fragment) <= 48:
                    if len(self.parts) >= self.remembered:
                        self.parts.clear()
                    self.parts[key] = got
            ids += got
        out = len(ids), " ".join([self.text_of[i] for i in ids]), " ".join([self.names[i] for i in ids])
        if len(word) <= 48:
            if len(self.seen) >= self.remembered:
                self.older, self.seen = self.seen, {}
            self.seen[word] = out
        return out

    def normal(self, text: str) -> str | None:
        """The text as the file's normaliser gives it, or None where only the library may say."""
        if not self.known or SETTLED.fullmatch(text) is None:
            return None
        return regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()

    def encode(self, text: str) -> tuple[int, str, str]:
        """(tokens, ids, decoded text); ids joined by one space."""
        found: list[tuple[int, str, str]] = []
        word = self.word
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.added:
                found.append((1, str(self.added[part]), part))
                continue
            if not part:
                continue
            normal = self.normal(part)
            if normal is None:
                ids = self.library.encode(text, add_special_tokens=False).ids
                return len(ids), " ".join(map(str, ids)), self.library.decode(ids, skip_special_tokens=False)
            seen = self.seen.get
            found += [seen(w) or word(w) for w in self.words.findall(normal)]
        return sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])

    def ids(self, text: str) -> list[int]:
        return [int(i) for i in self.encode(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids joined by spaces, as a file without a decoder asks for."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row; with_ids adds ids and the decoded text.

    No shuffle. Null and empty texts have no tokens and an empty decoded text;
    repeated rows and null doc_ids come back as they are; an empty table gives no
    rows; other columns are ignored. Long texts are handled word by word.
    """
    schema = pa.schema([*SCHEMA, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]) if with_ids else SCHEMA

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in rows(batch, "doc_id", "text"):
                    n, ids, decoded = model.encode(text)
                    row = doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    yield (*row, list(map(int, ids.split())), decoded) if with_ids else row

        yield from chunks(each(), schema, 512 if with_ids else 8192)

    return texts(docs).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
