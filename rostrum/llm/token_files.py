"""Binary files of token ids with Elias-Fano encoded document boundaries.

A file holds a run of documents in ascending order of doc_id: their ids, one after
another in the fewest whole bytes that the vocabulary needs, and two monotone
sequences as Elias-Fano codes, the documents' ends within the file and their
doc_ids. Such a code keeps the low bits of each value as they are and the high bits
in unary, about two bits more than the low ones for each value; a directory of
32-bit places of every 256th one answers select(i) with a short scan, so no table of
64-bit offsets is kept or read. A document is read by two selects and one range of
bytes.

`token_ids` is a Spark data source: tasks write files of bounded size under names of
their own, and the commit lists those of successful tasks in the manifest, one line
a file. What a lost or repeated task has left is never read.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rostrum.llm.bpe import SETTLED, encoder
from rostrum.llm.common import rows, texts
from rostrum.llm.packing import byte_letters

MAGIC = b"IDSEF001"
#: Magic, bytes of an id, documents with a null doc_id, documents, ids, least doc_id that is not null.
HEAD = struct.Struct("<8sBQQQq")
#: Low bits, values, bytes of low bits, bytes of high bits, entries of the directory.
CODE = struct.Struct("<BQQQQ")
#: A one of the high bits in so many has a place in the directory.
EVERY = 256
#: A file is closed at so many ids or documents; a document is never split.
MOST_IDS, MOST_DOCS = 1 << 24, 1 << 20
MANIFEST = "manifest"
ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-descending sequence of unsigned 64-bit numbers in two bits a value and its low bits."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.places = low_bits, n, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n > 1 and (values[1:] < values[:-1]).any():
            raise ValueError("the values must not descend")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        return cls(low_bits, n, cls._packed(values, low_bits), np.packbits(bits, bitorder="little"), at[::EVERY].astype("<u4"))

    @staticmethod
    def _packed(values: np.ndarray, width: int) -> np.ndarray:
        """The low bits one after another; lots of 65,536 values end on whole bytes."""
        shifts = np.arange(width, dtype=np.uint64)
        lots = [np.packbits(((values[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, len(values), 65536)]
        return np.concatenate(lots) if lots else np.zeros(0, dtype=np.uint8)

    def _low(self, i: int, j: int) -> np.ndarray:
        """The low bits of values i to j."""
        if not self.low_bits:
            return np.zeros(j - i, dtype=np.uint64)
        first, last = i * self.low_bits // 8, (j * self.low_bits + 7) // 8
        bits = np.unpackbits(self.low[first:last], bitorder="little")[i * self.low_bits - first * 8 :][: (j - i) * self.low_bits]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i: from the directory's place, bytes are counted until the one that holds it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.places[i // EVERY]), i % EVERY
        byte = place // 8
        left += int(ONES[int(self.high[byte]) & ((1 << place % 8) - 1)])
        while left >= (here := int(ONES[self.high[byte]])):
            left -= here
            byte += 1
        at = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        return (at - i << self.low_bits) + int(self._low(i, i + 1)[0])

    def values(self) -> np.ndarray:
        """All values in order."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        parts = [self._low(i, min(i + 65536, self.n)) for i in range(0, self.n, 65536)]
        low = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        return (at - np.arange(self.n, dtype=np.uint64) << np.uint64(self.low_bits)) + low

    def to_bytes(self) -> bytes:
        return CODE.pack(self.low_bits, self.n, len(self.low), len(self.high), len(self.places)) + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The code at the start of data and its size."""
        low_bits, n, low, high, places = CODE.unpack_from(data)
        a, b, c = CODE.size, CODE.size + low, CODE.size + low + high
        end = c + 4 * places
        return cls(low_bits, n, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8), np.frombuffer(data[c:end], "<u4")), end


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """One file: head, ends, doc_ids, ids; documents in ascending order, null doc_ids first."""
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    shifted = np.array([d - least for d in named], dtype=np.uint64)
    return b"".join([HEAD.pack(MAGIC, width, len(doc_ids) - len(named), len(doc_ids), len(ids) // width, least), EliasFano.of(ends).to_bytes(), EliasFano.of(shifted).to_bytes(), ids])


class TokenFile:
    """A file of the above, read through any seekable handle; `head` bytes hold all but the ids."""

    def __init__(self, data: memoryview):
        magic, self.width, self.nulls, self.n, self.n_ids, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.ends, size = EliasFano.from_bytes(data[HEAD.size :])
        self.names, more = EliasFano.from_bytes(data[HEAD.size + size :])
        self.head = HEAD.size + size + more
        if len(data) < self.head + self.n_ids * self.width:
            raise ValueError("a file of token ids is cut short")
        self.ids = np.frombuffer(data[self.head : self.head + self.n_ids * self.width], f"<u{self.width}")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the file's document i."""
        name = None if i < self.nulls else self.least + self.names.select(i - self.nulls)
        return name, self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the file, and ids of every document."""
        start, names = 0, self.names.values().tolist()
        for i, end in enumerate(self.ends.values().tolist()):
            yield None if i < self.nulls else self.least + names[i - self.nulls], start, self.ids[start:end]
            start = end


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int, int]]


class Writer(DataSourceArrowWriter):
    """Writes (doc_id, ids) as they come; ids are binary, `width` bytes each."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        out: list[tuple[str, int, int]] = []
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        ends: list[int] = []
        at = 0

        def close() -> None:
            name = f"{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(file_bytes(doc_ids, np.array(ends, dtype=np.uint64), b"".join(parts), self.width))
            out.append((name, len(doc_ids), at))

        for batch in iterator:
            for doc_id, ids in rows(batch, "doc_id", "ids"):
                n = len(ids) // self.width
                if doc_ids and (at + n > MOST_IDS or len(doc_ids) >= MOST_DOCS):
                    close()
                    doc_ids, parts, ends, at = [], [], [], 0
                at += n
                doc_ids.append(doc_id)
                parts.append(ids)
                ends.append(at)
        if doc_ids:
            close()
        return Written(TaskContext.get().partitionId(), out)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        lines = [f"{name} {docs} {ids}\n" for m in sorted(filter(None, messages), key=lambda m: m.partition) for name, docs, ids in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write("".join(lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            for name, _, _ in m.files:
                store.delete_file(f"{root}/{name}")


@dataclass
class File(InputPartition):
    name: str
    docs_before: int
    ids_before: int


def manifest(path: str) -> list[File]:
    """The files in order, with the documents and ids before each."""
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        lines = f.read().decode().splitlines()
    out, docs, ids = [], 0, 0
    for line in lines:
        name, n, m = line.split(" ")
        out.append(File(name, docs, ids))
        docs, ids = docs + int(n), ids + int(m)
    return out


def opened(path: str, name: str) -> TokenFile:
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{name}") as f:
        return TokenFile(memoryview(f.read()))


class Reader(DataSourceReader):
    """A task a file; each document's ids are read where its ends select them."""

    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[File]:
        return manifest(self.path)

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if self.with_ids else fields)
        held: list[tuple] = []
        size = 0
        for doc_id, start, ids in opened(self.path, partition.name).documents():
            row = doc_id, partition.ids_before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
            held.append((*row, ids.astype("int32")) if self.with_ids else row)
            size += len(ids)
            if len(held) >= 8192 or self.with_ids and size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class TokenIds(DataSource):
    """format("token_ids"): writes (doc_id long, ids binary), reads doc_id, start, n_tokens, ids_crc32 and, with the option ids, the ids."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def _ids(self) -> bool:
        return self.options.get("ids", "false").lower() == "true"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if self._ids() else "")

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._ids())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("width", 4)))


class WordIds:
    """Ids of whole texts by a vocabulary file with word ends, as the library for it gives them.

    White space bounds words, so each stretch between is encoded once and remembered,
    to a bounded number. New stretches are encoded together: every word, with a mark at
    its end, is one piece of a byte-level encoder whose ranks are the file's merges.
    That encoder merges any neighbours that form a vocabulary string; this is what the
    file's own merges do exactly if each string, by those merges alone, becomes one
    token, which is proved here for every string. Texts outside the ranges of SETTLED,
    or with special strings, go to the library.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        import tiktoken

        own = encoder(path)
        self.own, self.library, self.remembered = own, own.library, remembered
        self.width = 2 if max(own.names) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        back = {c: b for b, c in enumerate(byte_letters())}
        bare = {t: (t[: -len(own.end)], True) if own.end and t.endswith(own.end) else (t, False) for t in own.vocab}
        self.proven = bool(own.known and own.end) and all(own.merge(*b) == [own.vocab[t]] and back.keys() >= set(b[0]) for t, b in bare.items())
        if self.proven:
            made = {a + b: k for (a, b), k in own.rank.items()}
            # Letters come before all merges: bytes, then bytes at the end of a word, which are one letter with the mark.
            order = sorted(own.vocab, key=lambda t: (made.get(t, -1), bare[t][1], own.vocab[t]))
            strings = [bytes(back[c] for c in bare[t][0]) + (b"\0" if bare[t][1] else b"") for t in order]
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks={b: k for k, b in enumerate(strings)}, special_tokens={})
            self.real = np.array([own.vocab[t] for t in order], dtype=self.kind)
            self.ending = np.array([bare[t][1] for t in order])
        self.seen: dict[str, bytes] = {}

    def _learned(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches without white space, encoded in one call."""
        words = [(s,) if s.isalpha() else self.own.words.findall(s) for s in stretches]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        got = np.asarray(self.fast.encode_ordinary("\0".join([*chain.from_iterable(words), ""])), dtype=np.int64)
        ends = np.concatenate([[0], np.flatnonzero(self.ending[got]) + 1]) if len(got) else np.zeros(1, dtype=np.int64)
        at = ends[np.concatenate([[0], np.cumsum(sizes)])] * self.width
        data = self.real[got].tobytes() if len(got) else b""
        return {s: data[a:b] for s, a, b in zip(stretches, at[:-1].tolist(), at[1:].tolist())}

    def encode(self, several: list[str]) -> list[bytes]:
        """The ids of each text, `width` bytes each."""
        found = [None if not self.proven or "<|" in t or SETTLED.fullmatch(t) is None else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split() for t in several]
        known = [None if f is None else list(map(self.seen.get, f)) for f in found]
        new = list(dict.fromkeys(chain.from_iterable([s for s, k in zip(f, ids) if k is None] for f, ids in zip(found, known) if f is not None)))
        here = self._learned(new) if new else {}
        out = []
        for text, f, ids in zip(several, found, known):
            if f is None:
                out.append(np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes())
            else:
                out.append(b"".join([here[s] if k is None else k for s, k in zip(f, ids)]))
        if len(self.seen) + len(new) > self.remembered:
            self.seen = {}
        if len(new) <= self.remembered:
            self.seen.update((s, ids) for s, ids in here.items() if len(s) <= 48)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encodes every text, adds end_id, and writes the ids to a new folder in ascending order of doc_id.

    Null doc_ids come first; rows of one doc_id lie together by the hash of their text,
    equal rows in any order. Null and empty texts are the end id alone; an empty table
    makes a manifest without files; other columns are ignored. Ranges of (doc_id, hash)
    go to tasks, so no doc_id is too common for the ranges; a text is encoded whole by
    one task, and a task holds one file's ids, or one text's where those are more.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    width = 2 if max(encoder(vocabulary).names) < 1 << 16 and end_id < 1 << 16 else 4
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(vocabulary)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = model.encode(part.column("text").to_pylist())
                ids = [x + end for x in ids] if width == model.width else [np.frombuffer(x, model.kind).astype(f"<u{width}").tobytes() + end for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, type=pa.binary())], schema=schema)

    order = ["doc_id", "h", "r"]
    found = texts(docs).withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(of, "doc_id long, ids binary")
    found.write.format("token_ids").mode("append").option("path", path).option("width", width).save()


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of every document of a folder, from its files; start counts the ids of all documents before it. A folder without documents gives no rows."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("ids", str(with_ids).lower()).load(path)


def document(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one document by its number over all files, without Spark: the manifest names the file, two selects the bytes."""
    held = [f for f in manifest(path) if f.docs_before <= number]
    if number < 0 or not held:
        raise IndexError(number)
    file = opened(path, held[-1].name)
    return file.document(number - held[-1].docs_before)
