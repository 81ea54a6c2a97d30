"""Text records in brackets, as results software writes them: {[key value ...] ...} with lists in parentheses."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed names of the format: keys of records, and what a cell of a pool's grid says.
POOL_PEOPLE, POOL_GRID, BRACKET_BOUTS = "les_tir_feuille", "grille", "les_matches"
WON, LOST = ("v", "w"), "d"

_TOKEN = re.compile(r'(?m)^;.*$|"([^"]*)"|([{}\[\]()])|([^\s{}\[\]()"]+)')
_COMMENT = re.compile(r"(?m)^;.*$")
_QUOTED = re.compile(r'(?m)^;.*$|"([^"]*)"|"')
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_MARKS = {*_CLOSES, *_CLOSES.values()}
_RANKED = re.compile(r"(?m)^([a-z]);(\d+);(\d+);")
#: Rows of texts that are sent back at once.
ROWS = 50_000


def _tokens(text: str) -> tuple[list[str], dict[str, str]]:
    """The marks and words of a text, by string methods alone where it has no quotes, and what the words for quoted ones stand for."""
    quoted: dict[str, str] = {}

    def word(m: re.Match) -> str:
        if m[1] is None:
            return " "
        quoted[f'"{len(quoted)}'] = m[1]
        return f' "{len(quoted) - 1} '

    if '"' in text:
        text = _QUOTED.sub(word, text)
    elif ";" in text:
        text = _COMMENT.sub("", text)
    for mark in _MARKS:
        text = text.replace(mark, f" {mark} ")
    return text.split(), quoted


def parsed(text: str) -> list[dict]:
    """The records of a text: a dict each, lists as lists, words as strings. Raises ValueError where brackets do not match."""
    values: list = []
    open_: list[tuple[str, list]] = []
    tokens, quoted = _tokens(text)
    for at, token in enumerate(tokens):
        if token not in _MARKS:
            values.append(quoted.get(token, token) if quoted else token)
        elif token in _CLOSES:
            open_.append((token, values))
            values = []
        else:
            kind, outer = open_.pop() if open_ else ("", values)
            if _CLOSES.get(kind) != token:
                places = [m.start() for m in _TOKEN.finditer(text) if m[2]]
                raise ValueError(f"{token} at {places[sum(t in _MARKS for t in tokens[:at])]} closes nothing")
            if kind == "{":
                values = {k[0]: k[1] if len(k) == 2 else k[1:] for k in values if isinstance(k, list) and k and isinstance(k[0], str)}
            outer.append(values)
            values = outer
    if open_:
        raise ValueError("a bracket is left open")
    return [r for r in values if isinstance(r, dict)]


def _touches(value: object) -> int | None:
    return int(value) if isinstance(value, str) and re.fullmatch(r"[0-9]{1,2}", value) else None


def _pool(r: dict) -> Iterator[tuple]:
    people, grid = r[POOL_PEOPLE], r[POOL_GRID]
    if not (isinstance(grid, list) and len(grid) == len(people) > 1 and all(isinstance(row, list) and len(row) == len(people) for row in grid)):
        raise ValueError("the grid is not as wide as the pool")

    def cell(i: int, j: int) -> tuple[object, int | None]:
        c = grid[i][j]
        return (c[0], _touches(c[1])) if isinstance(c, list) and len(c) == 2 else (None, None)

    for i in range(len(people)):
        for j in range(i + 1, len(people)):
            (x, mine), (y, its) = cell(i, j), cell(j, i)
            fought = mine is not None and its is not None and ((x in WON and y == LOST and mine >= its) or (y in WON and x == LOST and its >= mine))
            yield "pool", str(r["numero"]), people[i], people[j], mine if fought else None, its if fought else None, (people[i] if x in WON else people[j]) if fought else None, None


def _bracket(r: dict) -> Iterator[tuple]:
    for x in r[BRACKET_BOUTS]:
        bout = x.get("match") if isinstance(x, dict) else None
        if isinstance(bout, list) and len(bout) >= 7:
            a, b, winner = (v if isinstance(v, str) and v.isdecimal() else None for v in (bout[0], bout[1], bout[4]))
            yield "bracket", str(r["nom"]), a, b, _touches(bout[2]), _touches(bout[3]), winner, None


def _rows(text: str) -> Iterator[tuple]:
    ranked = _RANKED.findall(text) if ";" in text else []
    for code, place, who in ranked:
        yield "place", code, who, None, None, None, None, int(place)
    for r in [] if ranked else parsed(text):
        if POOL_GRID in r:
            yield from _pool(r)
        elif BRACKET_BOUTS in r:
            yield from _bracket(r)
        elif "cle" in r and "nom" in r:
            yield "person", r.get("prenom") or None, r["cle"], r["nom"], None, None, None, None


def rows_of(text: str) -> list[tuple]:
    """Rows of one text: bouts of pools and brackets, places of classifications, and fencers by name; one that says why where it is refused."""
    try:
        return list(_rows(text)) or [("refused", "no record", None, None, None, None, None, None)]
    except (ValueError, KeyError, TypeError) as e:
        return [("refused", f"{type(e).__name__}: {e}", None, None, None, None, None, None)]


def read_records(files: DataFrame, text: str, keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): the files' columns, or those to keep, with kind, round, a, b, score_a, score_b, winner, place of each row of their text.

    A pool has a row per pair of its people, without scores where the two cells of its
    grid do not agree on one bout; a bracket has one per bout, a classification one per
    place (its code as `round`, the person as `a`), a list of people one per person
    (given name as `round`, number as `a`, surname as `b`). A text whose brackets do not
    match, whose grid is not square or which has no record is refused whole, with the
    reason; a null text has no rows. Files are read in the tasks that hold them, each
    text by itself, so the largest text bounds a task's memory.
    """
    kept = list(files.columns if keep is None else keep)
    own = files.select(*kept, F.col(text).alias("__text"))
    row = pa.schema([(c, pa.string()) for c in ("kind", "round", "a", "b")] + [("score_a", pa.int32()), ("score_b", pa.int32()), ("winner", pa.string()), ("place", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, files_of = batch.column(len(kept)), batch.select(range(len(kept)))
            of, rows = [], []
            for k in range(len(texts)):
                if (text := texts[k].as_py()) is not None:
                    found = rows_of(text)
                    rows += found
                    of += [k] * len(found)
                if rows and (len(rows) >= ROWS or k == len(texts) - 1):
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), row)]
                    yield pa.RecordBatch.from_arrays([*files_of.take(pa.array(of, pa.int32())).columns, *columns], names=[*kept, *row.names])
                    of, rows = [], []

    schema = T.StructType([*files.select(*kept).schema, *T.StructType.fromDDL("kind string, round string, a string, b string, score_a int, score_b int, winner string, place int")])
    out = own.mapInArrow(read, schema)
    return out.where("kind <> 'refused'"), out.where("kind = 'refused'").select(*kept, F.col("round").alias("reason"))
