"""Deeply nested JSON records into related flat tables, by columnar shredding.

Groups of records are shredded into one column per path, every entry with its repetition level (at which repeated
ancestor the path starts anew) and definition level (how much of the path is there). A path's column comes from the
column of the path above it, step by step, and only paths that the scheme names are followed. The tables are put
together again from those level sequences alone: positions of all repeated ancestors follow from the repetition
levels, whether an element is there from the definition levels, and fields of one ancestor lie at equal places.

Nulls: a null record, or one that can't be read as JSON, gives nothing; JSON inside a JSON string is read through.
A null element gives no row but keeps its position. Ties and repeated rows: each input row is shredded by itself, so
repeated rows give repeated rows unless the caller drops them; a null id is kept. Records of any depth are read; very
long ones are one value of one task. Of keys that a JSON object repeats the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records, and characters of text, that are shredded together.
GROUP_RECORDS, GROUP_CHARS = 2_000, 8_000_000
#: Repeated ancestors that a column has at most; what is deeper is a record of its own.
LEVELS = 64
#: Rows, and about as many bytes, that are handed on together.
OUT_ROWS, OUT_BYTES = 50_000, 16_000_000

ABSENT, OBJECT, ARRAY, STRING, NUMBER, BOOLEAN = range(6)
KIND = {type(None): ABSENT, dict: OBJECT, list: ARRAY, str: STRING, int: NUMBER, float: NUMBER, bool: BOOLEAN}
KIND_NAMES = ["null", "object", "array", "string", "number", "boolean"]

_COLUMN = "path:string,max_definition:int,max_repetition:int,repetition:array<int>,definition:array<int>,kind:array<tinyint>,value:array<string>"
SHREDDED = f"record_id array<bigint>, base array<string>, columns array<struct<{_COLUMN}>>"

# Schemes: steps below a path; "keep" marks the columns that are wanted, by their levels or with their values, too.
_NUMBERS = {"[]": {"keep": "values"}}
_TILE: dict = {"keep": "levels", ".geometricError": {"keep": "values"}, ".refine": {"keep": "values"}, ".content": {".uri": {"keep": "values"}, ".url": {"keep": "values"}}, ".boundingVolume": {".box": _NUMBERS}, ".transform": _NUMBERS}
_TILE[".children"] = {"[]": _TILE}
TILES = {".root": _TILE}
_BOXED: dict = {"keep": "levels", ".boundingVolume": {".box": {"[]": {"keep": "levels"}}}}
_BOXED[".children"] = {"[]": _BOXED}
BOXED = {".root": _BOXED}
_NAMING: dict = {"keep": "levels", ".content": {".uri": {"keep": "values"}, ".url": {"keep": "values"}}}
_NAMING[".children"] = {"[]": _NAMING}
NAMING = {".root": _NAMING}
PROPERTIES = {"[]": {"keep": "levels", "[]": {"keep": "values", "[]": {"keep": "values"}}}}
SETS = {"[]": {"keep": "levels", "[]": {"keep": "levels"}}}


# --- reading

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def _read_deep(text: str):
    """A JSON text nested deeper than the library's reader goes, by a stack of open containers."""
    skip = lambda i: _SPACE.match(text, i).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("no key")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        return name, skip(at + 1)

    open_: list = []
    names: list = []
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            new = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                open_.append(new)
                names.append(None)
                if c == "{":
                    names[-1], at = key(at)
                continue
            value, at = new, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError("no value")
            value, at = json.loads(m.group()), m.end()
        while True:  # a value is complete: it goes into what holds it, which may be complete, too
            at = skip(at)
            if not open_:
                if at != len(text):
                    raise ValueError("text after the value")
                return value
            top = open_[-1]
            if type(top) is dict:
                top[names[-1]] = value
            else:
                top.append(value)
            c = text[at : at + 1]
            at = skip(at + 1)
            if c == ",":
                if type(top) is dict:
                    names[-1], at = key(at)
                break
            if c != ("}" if type(top) is dict else "]"):
                raise ValueError("not closed")
            value = top
            open_.pop()
            names.pop()


def parse(text: str | None):
    """The value of a JSON text, read through JSON strings; None if it can't be read."""
    value = text
    try:
        while type(value) is str:
            try:
                value = json.loads(value)
            except RecursionError:
                value = _read_deep(value)
    except ValueError:
        return None
    return value


# --- shredding


class Column:
    """A path's entries over a group of records: repetition and definition levels and, while shredding, the values that are there with their places."""

    __slots__ = ("at", "cut", "d", "deep", "full", "path", "r", "v")

    def __init__(self, path: str, full: int, deep: int, r: np.ndarray, d: np.ndarray, at: np.ndarray, v: list):
        self.path, self.full, self.deep, self.r, self.d, self.at, self.v, self.cut = path, full, deep, r, d, at, v, False

    def field(self, key: str, listed: bool) -> Column | None:
        """The column of a key below; None where no entry has it. listed: a single object stands for a list of one."""
        own = [(k, y) for k, x in enumerate(self.v) if type(x) is dict and (y := x.get(key)) is not None]
        if not own:
            return None
        at = self.at[[k for k, _ in own]]
        v = [[y] if listed and type(y) is dict else y for _, y in own]
        d = self.d.copy()
        d[at] = self.full + 1
        return Column(f"{self.path}.{key}", self.full + 1, self.deep, self.r, d, at, v)

    def elements(self) -> Column | None:
        """The column of the elements below; None where no entry has any. An entry without elements stays one entry, below the level of a null element."""
        many = np.fromiter((len(x) if type(x) is list else 0 for x in self.v), np.int64, len(self.v))
        has = many > 0
        if not has.any():
            return None
        n = np.ones(len(self.r), np.int64)
        n[self.at] = np.maximum(many, 1)
        start = np.cumsum(n) - n
        r = np.full(int(n.sum()), self.deep + 1, np.int32)
        r[start] = self.r
        d = self.d.copy()
        d[self.at[~has]] = self.full - 1
        d = np.repeat(d, n)
        own, length = self.at[has], many[has]
        at = np.repeat(start[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        v = list(chain.from_iterable(x for x in self.v if type(x) is list))
        there = np.fromiter((x is not None for x in v), bool, len(v))
        d[at[there]] = self.full + 1
        return Column(self.path + "[]", self.full + 1, self.deep + 1, r, d, at[there], [x for x in v if x is not None])


def shred(values: list, scheme: dict | None = None, lists: frozenset = frozenset(), levels: int | None = None) -> Iterator[tuple[Column, bool]]:
    """(column, whether its values are wanted) of every path that the scheme keeps; without a scheme of all paths there are.

    lists: keys whose single object stands for a list of one; with levels they aren't followed below so many repetitions, and the column there is marked as cut.
    """
    there = [k for k, x in enumerate(values) if x is not None]
    d = np.zeros(len(values), np.int32)
    d[there] = 1
    root = Column("$", 1, 0, np.zeros(len(values), np.int32), d, np.array(there, np.int64), [values[k] for k in there])
    todo = [(root, scheme)]
    while todo:
        c, below = todo.pop()
        steps = [k for k in below if k != "keep"] if below is not None else [*dict.fromkeys("." + k for x in c.v if type(x) is dict for k in x), "[]"]
        for step in steps:
            if levels is not None and c.deep >= levels and step[1:] in lists:
                c.cut = True
                continue
            inner = c.elements() if step == "[]" else c.field(step[1:], step[1:] in lists)
            if inner is not None:
                todo.append((inner, None if below is None else below[step]))
        if below is None or "keep" in below:
            yield c, below is None or below["keep"] == "values"


def _text(x) -> str | None:
    return x if type(x) is str else None if type(x) in (dict, list, type(None)) else json.dumps(x)


def _offsets(parts: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))


def _row(ids: list, base: list, columns: list[tuple[Column, bool]]) -> pa.RecordBatch:
    """A group of records as one row of SHREDDED."""
    flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0), t)
    own = [c for c, _ in columns]
    kinds, texts = [], []
    for c, wanted in columns:
        kind = np.zeros(len(c.r), np.int8)
        kind[c.at] = np.fromiter(map(KIND.__getitem__, map(type, c.v)), np.int8, len(c.v))
        kinds.append(kind)
        text: list = [None] * len(c.r) if wanted else []
        if wanted:
            for k, x in zip(c.at.tolist(), c.v, strict=True):
                text[k] = _text(x)
        texts.append(text)
    levels = _offsets([c.r for c in own])
    lists = [pa.ListArray.from_arrays(levels, flat([getattr(c, k) for c in own], pa.int32())) for k in ("r", "d")]
    lists.append(pa.ListArray.from_arrays(levels, flat(kinds, pa.int8())))
    lists.append(pa.ListArray.from_arrays(_offsets(texts), pa.array(list(chain.from_iterable(texts)), pa.string())))
    heads = [pa.array([c.path for c in own], pa.string()), pa.array([c.full for c in own], pa.int32()), pa.array([c.deep for c in own], pa.int32())]
    cells = pa.StructArray.from_arrays([*heads, *lists], names=[x.split(":")[0] for x in _COLUMN.split(",")])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(pa.array(ids, pa.int64())), one(pa.array(base, pa.string())), one(cells)], names=["record_id", "base", "columns"])


def _shredded_group(ids: list, values: list, scheme: dict | None, lists: frozenset) -> Iterator[pa.RecordBatch]:
    """What lies deeper than LEVELS below is shredded as records of its own, which know the path they start at."""
    todo = [(ids, [None] * len(ids), values)]
    while todo:
        ids, base, values = todo.pop()
        columns = list(shred(values, scheme, lists, LEVELS))
        yield _row(ids, base, columns)
        for c, _ in columns:
            if c.cut:
                rows = [k for k, x in enumerate(c.v) if type(x) is dict and any(x.get(key) for key in lists)]
                at = c.at[rows]
                owner = (np.cumsum(c.r <= 0) - 1)[at].tolist()
                steps = [p[at].tolist() for p in positions(c.r, c.deep)]
                paths = [".".join([base[o] or "0", *map(str, x)]) for o, x in zip(owner, zip(*steps, strict=True), strict=True)]
                if rows:
                    todo.append(([ids[o] for o in owner], paths, [{"root": c.v[k]} for k in rows]))


def shredded(records: DataFrame, record_id: str, text: str, lists: tuple = (), scheme: dict | None = None) -> DataFrame:
    """The level sequences of groups of records (see SHREDDED) by path, of the paths that the scheme keeps or of all."""
    keys = frozenset(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        values: list = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (value := parse(t)) is None:
                    continue
                ids.append(i)
                values.append(value)
                size += len(t)
                if len(ids) >= GROUP_RECORDS or size >= GROUP_CHARS:
                    yield from _shredded_group(ids, values, scheme, keys)
                    ids, values, size = [], [], 0
        if ids:
            yield from _shredded_group(ids, values, scheme, keys)

    return records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("text")).mapInArrow(run, SHREDDED)


# --- putting together


class Levels:
    """A column as it was stored: levels and kinds as numpy arrays, values as Arrow text."""

    __slots__ = ("d", "deep", "full", "kind", "r", "values")

    def __init__(self, full: int, deep: int, r: np.ndarray, d: np.ndarray, kind: np.ndarray, values: pa.Array):
        self.full, self.deep, self.r, self.d, self.kind, self.values = full, deep, r, d, kind, values

    def text(self, index: np.ndarray) -> pa.Array:
        """Values at the places of index; null where the index is below 0 or nothing is there."""
        return self.values.take(pa.array(index, pa.int64(), mask=index < 0))


def positions(r: np.ndarray, levels: int) -> list[np.ndarray]:
    """Positions of the repeated ancestors of each entry by level, from the repetition levels alone."""
    out, index = [], np.arange(len(r))
    for k in range(1, levels + 1):
        count = np.cumsum(r == k)
        anew = np.maximum.accumulate(np.where(r < k, index, 0))
        out.append(count - count[anew])
    return out


def owners(c: Levels, level: int) -> np.ndarray:
    """The place of each entry's ancestor in the column of that repeated ancestor."""
    return np.cumsum(c.r <= level) - 1


def _dotted(parts: list[np.ndarray]) -> pa.Array:
    cols = [pa.array(p).cast(pa.string()) for p in parts]
    return pc.binary_join_element_wise(*cols, ".") if len(cols) > 1 else cols[0]


Group = tuple[pa.Array, pa.Array, dict[str, Levels]]


def _groups(batch: pa.RecordBatch) -> Iterator[Group]:
    ids, bases, columns = (batch.column(k) for k in range(3))
    names = [x.split(":")[0] for x in _COLUMN.split(",")]
    for i in range(batch.num_rows):
        cells = columns[i].values
        fields = {n: cells.field(n) for n in names}
        own = {}
        for k, path in enumerate(fields["path"].to_pylist()):
            r, d, kind = (fields[n][k].values.to_numpy(zero_copy_only=False) for n in ("repetition", "definition", "kind"))
            own[path] = Levels(fields["max_definition"][k].as_py(), fields["max_repetition"][k].as_py(), r, d, kind, fields["value"][k].values)
        yield ids[i].values, bases[i].values, own


def rebuilt(columns: DataFrame, schema: str, *tables) -> DataFrame:
    """The rows that the tables make of each group, one table after the other; a table yields lists of Arrow arrays in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for group in _groups(batch):
                for arrays in chain.from_iterable(t(group) for t in tables):
                    if len(arrays[0]):
                        held.append(pa.RecordBatch.from_arrays(arrays, names=names))
                    if sum(b.num_rows for b in held) >= OUT_ROWS or sum(b.nbytes for b in held) >= OUT_BYTES or len(held) >= 200:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return columns.mapInArrow(run, schema)


def _tile_columns(columns: dict[str, Levels], at_least: str = "") -> Iterator[tuple[str, int]]:
    """(path, depth) of the tile columns there are."""
    path, depth = "$.root", 0
    while path in columns:
        if path + at_least in columns:
            yield path, depth
        path, depth = path + ".children[]", depth + 1


def _tile_keys(ids: pa.Array, base: pa.Array, c: Levels, rows: np.ndarray, depth: int) -> list[pa.Array]:
    """record_id, node_path, parent_path and depth of entries of a tile column."""
    owner = pa.array(owners(c, 0)[rows])
    start = base.take(owner)
    steps = [pa.array(p[rows]).cast(pa.string()) for p in positions(c.r, depth)]
    at = [pc.coalesce(start, pa.scalar("0")), *steps]
    join = lambda x: pc.binary_join_element_wise(*x, ".") if len(x) > 1 else x[0]
    above = pc.add(pc.coalesce(pc.count_substring(start, "."), pa.scalar(0, pa.int32())), pa.scalar(depth, pa.int32()))
    return [ids.take(owner), join(at), join(at[:-1]) if depth else pa.array([""] * len(rows), pa.string()), above]


def _own(base: pa.Array, c: Levels, depth: int) -> np.ndarray:
    """Which entries are rows here: the root of a record that goes on below another isn't."""
    return np.ones(len(c.r), bool) if depth else base.is_null().to_numpy(zero_copy_only=False)[owners(c, 0)]


def _tile_rows(fields: bool):
    def table(group: Group):
        ids, base, columns = group
        for path, depth in _tile_columns(columns):
            c = columns[path]
            rows = np.flatnonzero((c.d == c.full) & (c.kind == OBJECT) & _own(base, c, depth))
            out = _tile_keys(ids, base, c, rows, depth)
            if fields:
                none = pa.nulls(len(rows), pa.string())
                take = lambda leaf, path=path, rows=rows, none=none: columns[path + leaf].text(rows) if path + leaf in columns else none
                out += [take(".geometricError"), take(".refine"), pc.coalesce(take(".content.uri"), take(".content.url"))]
            yield out if fields else out[:3]

    return table


def _number_rows(leaf: str, count: int, values: bool):
    def table(group: Group):
        ids, base, columns = group
        for path, depth in _tile_columns(columns, leaf):
            c, tile = columns[path + leaf], columns[path]
            owner, n = owners(c, depth), len(tile.r)
            element, number = c.d >= c.full - 1, (c.d == c.full) & (c.kind == NUMBER)
            whole = (np.bincount(owner[element], minlength=n) == count) & (np.bincount(owner[number], minlength=n) == count) & _own(base, tile, depth)
            rows = np.flatnonzero(whole)
            out = _tile_keys(ids, base, tile, rows, depth)[:3]
            if values:
                flat = c.text(np.flatnonzero(whole[owner])).cast(pa.float64())
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * count, pa.int32()), flat))
            yield out

    return table


KEYS = "record_id bigint, node_path string, parent_path string"


def tile_columns(tilesets: DataFrame, scheme: dict | None = TILES) -> DataFrame:
    return shredded(tilesets, "tileset_id", "tileset_json", ("children",), scheme)


def tiles(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path, depth, geometric_error, refine, content_uri) of every tile; fields that a tile hasn't are null."""
    return rebuilt(columns, KEYS + ", depth int, geometric_error string, refine string, content_uri string", _tile_rows(True))


def boxes(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path, box) of tiles whose box has exactly 12 numbers."""
    return rebuilt(columns, KEYS + ", box array<double>", _number_rows(".boundingVolume.box[]", 12, True))


def transforms(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path, matrix) of tiles whose transform has exactly 16 numbers."""
    return rebuilt(columns, KEYS + ", matrix array<double>", _number_rows(".transform[]", 16, True))


def _named(kind: str, table):
    return lambda group: ([pa.array([kind] * len(x[0]), pa.string()), *x] for x in table(group))


def tiles_and_boxes(columns: DataFrame) -> DataFrame:
    """(rec_kind, record_id, node_path, parent_path) of tiles and of those with a box of 12 numbers, from one reading of the columns."""
    return rebuilt(columns, "rec_kind string, " + KEYS, _named("tile", _tile_rows(False)), _named("box", _number_rows(".boundingVolume.box[]", 12, False)))


def contents(columns: DataFrame) -> DataFrame:
    """(record_id, content_uri) of every tile that names one."""

    def table(group: Group):
        ids, base, columns = group
        for path, _ in _tile_columns(columns):
            for leaf in (".content.uri", ".content.url"):
                c = columns.get(path + leaf)
                if c is not None:
                    rows = np.flatnonzero((c.d == c.full) & (c.kind == STRING))
                    yield [ids.take(pa.array(owners(c, 0)[rows])), c.text(rows)]

    return rebuilt(columns, "record_id bigint, content_uri string", table)


def property_columns(objects: DataFrame, scheme: dict | None = PROPERTIES) -> DataFrame:
    return shredded(objects, "object_id", "properties", scheme=scheme)


def _set_rows(names: bool):
    def table(group: Group):
        ids, base, columns = group
        c = columns.get("$[]")
        if c is None:
            return
        rows = np.flatnonzero((c.d == c.full) & (c.kind == ARRAY))
        out = [ids.take(pa.array(owners(c, 0)[rows])), _dotted([positions(c.r, 1)[0][rows]]), pa.array([""] * len(rows), pa.string())]
        if names:
            m = columns.get("$[][]")
            # the first entry below each set is its name, if it is a text
            first = np.flatnonzero(m.r <= 1)[rows] if m is not None else np.full(len(rows), -1)
            out.append(m.text(np.where(m.kind[first] == STRING, first, -1)) if m is not None else pa.nulls(len(rows), pa.string()))
        yield out

    return table


def _prop_rows(values: bool):
    def table(group: Group):
        ids, base, columns = group
        c = columns.get("$[][]")
        if c is None:
            return
        p, q = positions(c.r, 2)
        rows = np.flatnonzero((c.d == c.full) & (c.kind == ARRAY) & (q > 0))
        out = [ids.take(pa.array(owners(c, 0)[rows])), _dotted([p[rows], q[rows] - 1]), _dotted([p[rows]])]
        if values:
            m = columns.get("$[][][]")
            name = value = np.full(len(rows), -1)
            kind = pa.nulls(len(rows), pa.string())
            if m is not None:
                place, owner = positions(m.r, 3)[2], owners(m, 2)
                held = []
                for k in (0, 1):
                    own = np.full(len(c.r), -1)
                    there = np.flatnonzero((place == k) & (m.d >= m.full - 1))
                    own[owner[there]] = there
                    held.append(own[rows])
                name, value = held
                kind = pa.array(KIND_NAMES).take(pa.array(m.kind[value], pa.int8(), mask=value < 0))
            text = m.text if m is not None else lambda x: pa.nulls(len(x), pa.string())
            out += [text(name), text(value), kind]
        yield out

    return table


def psets(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path, pset_name) of every inner list."""
    return rebuilt(columns, KEYS + ", pset_name string", _set_rows(True))


def props(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path) of every list after a set's name."""
    return rebuilt(columns, KEYS, _prop_rows(False))


def prop_values(columns: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path, prop_name, prop_value, value_kind); a nested value has the kind only."""
    return rebuilt(columns, KEYS + ", prop_name string, prop_value string, value_kind string", _prop_rows(True))


def sets_and_props(columns: DataFrame) -> DataFrame:
    """(rec_kind, record_id, node_path, parent_path) of property sets and properties, from one reading of the columns."""
    return rebuilt(columns, "rec_kind string, " + KEYS, _named("pset", _set_rows(False)), _named("prop", _prop_rows(False)))
