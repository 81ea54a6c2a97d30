"""Token counts by the whole-token shortcut.

A byte-pair vocabulary splits most words of a text into one token each. Which of
its strings encode alone as a single token is proven offline, once before the tasks
start, by encoding each of them with the library; the tasks are sent the proof, one
bit per string. A pre-token equal to such a string then counts as one without any
merging, and only the rest goes through the library.

Pre-tokens end where no vocabulary string can cross: before a run of spaces and
around a newline. Both facts, and that the model leaves characters as they are,
are read from the model file; when one does not hold, whole texts are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rostrum.llm.common import chunks, rows, texts

SPACE = "▁"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_whole", pa.int64())])


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def keeps_characters(model: bytes) -> bool:
    """Whether the model only turns spaces into marks and adds one in front."""
    spec = dict(_fields(next((v for n, v in _fields(model) if n == 3), b"")))
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class WholeTokenCounter(dict):
    """Tokens by pre-token: proven whole tokens from the start, others as they come.

    The memory of other pre-tokens is bounded; it is emptied when full.
    """

    def __init__(self, path: str, remembered: int = 300_000, proof: bytes | None = None):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered, self.merged = remembered, 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.splits = keeps_characters(self.model.serialized_model_proto()) and not any(SPACE in p.lstrip(SPACE) or (len(p) > 1 and "\n" in p) for p in pieces)
        self.newline = len(self.model.encode("\n"))
        self.pattern = re.compile(r" +[^ \n]*|[^ \n]+|\n")
        if not self.splits:
            pieces = []
        alone = map(self._alone, pieces) if proof is None else np.unpackbits(np.frombuffer(proof, np.uint8), count=len(pieces)).astype(bool)
        marks = list(alone)
        #: One bit per string of the vocabulary: whether it encodes alone as one token.
        self.proof = np.packbits(np.array(marks, dtype=bool)).tobytes()
        self.whole: frozenset[str] = frozenset(p.replace(SPACE, " ") for p, yes in zip(pieces, marks) if yes)
        self.update(dict.fromkeys(self.whole, 1))
        self[" "] = self[" "] if " " in self else len(self.model.encode(" ")) - 1 or 1

    def _alone(self, piece: str) -> bool:
        """The proof: the library gives this string back as one token."""
        text = piece.replace(SPACE, " ")
        if text == " ":
            return self.model.encode("\n", out_type=str)[0] == SPACE
        return self._merge(text) == 1

    def _merge(self, token: str) -> int:
        if token[0] == " ":
            return len(self.model.encode(token[1:]))
        if token == "\n":
            return self.newline - 1
        return len(self.model.encode("\n" + token)) - self.newline

    def __missing__(self, token: str) -> int:
        n = self._merge(token)
        if len(token) <= 48:
            if self.merged >= self.remembered:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.setdefault(" ", 1)
                self.merged = 0
            self[token] = n
            self.merged += 1
        return n

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and how many pre-tokens were whole tokens."""
        if not text:
            return 0, 0
        if not self.splits:
            return len(self.model.encode(text)), 0
        found = self.pattern.findall(" " + text.replace(SPACE, " "))
        counts = [self[t] for t in found]
        return sum(counts), counts.count(1)


@lru_cache(maxsize=2)
def counter(path: str, proof: bytes | None = None) -> WholeTokenCounter:
    """One counter per process, model and proof."""
    return WholeTokenCounter(path, proof=proof)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_whole (pre-tokens of one token) for every row.

    No shuffle: each task counts its own rows. Null and empty texts have no tokens;
    null doc_ids and repeated rows, ties too, come back as they are; an empty table gives no
    rows; columns other than doc_id and text are ignored. Very long texts are
    split into pre-tokens like any other, so no piece of work grows with a text.
    """

    proof = counter(model_path).proof  # some kilobytes, bounded by the vocabulary

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path, proof)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in rows(batch, "doc_id", "text"):
                    n, whole = model.count(text)
                    yield doc_id, len(text.encode()), n, n > limit, whole

        yield from chunks(each(), SCHEMA)

    return texts(docs).mapInArrow(of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
