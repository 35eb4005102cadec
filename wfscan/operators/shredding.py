"""Problem 4: deeply nested records as columns with repetition and definition levels, and flat tables made from those columns.

`shred` turns each JSON document into one row per leaf path, whatever the path: the document as it is, but for the list of nodes, which
comes in one of three places and is put into one. A row holds the whole column of its document: for every value, or gap, the level at
which a repetition starts (0: the document, 1: a node, 2: an array within it, ...), the number of path steps that are present, and the
value. Gaps are kept, so the columns of a document stay aligned. `wanted` leaves out columns that nobody will read, before they are made.

Tables need nothing but the level sequences: counting repetitions gives each value's index at every repeated ancestor. `assemble`
gives the values under some ancestors; `flat_tables` gives a table for every repeated ancestor, its rows keyed by their positions and
linked to the row of the ancestor above. A batch of columns is assembled in one vectorised pass, as every column begins at level 0.

Map-only: no shuffle, and a document of any size concerns one row of one task. Results: null, empty and unreadable bodies give no
rows; null members and nulls in arrays give none, but array positions count; a repeated document gives its rows again. Half of a
surrogate pair, which JSON can write but no text holds, comes out as U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from itertools import chain, repeat
from json.decoder import WHITESPACE, scanstring
from json.scanner import NUMBER_RE

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.session import ship_package, spread

COLUMNS = "record_id bigint, steps array<string>, reps array<int>, defs array<int>, vals array<string>, kind string"
ITEM, OBJECT = "[]", "{}"  # steps: an array element, and a mark that an object is there; members have a dot before their name
_BLANKS = " \t\r\n\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # around a document
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str):
    """json.loads for any depth of nesting and integers of any length."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):  # deeper than calls may be, or an integer of more digits than int reads
        return _loads_deep(text)


def _integer(digits: str) -> int | Decimal:
    try:
        return int(digits)
    except ValueError:
        return Decimal(digits)


def _text(value) -> str:
    """A scalar as text."""
    return value if isinstance(value, str) else str(value) if type(value) in (int, Decimal) else json.dumps(value)


def _loads_deep(text: str):
    def skip(at: int) -> int:
        return WHITESPACE.match(text, at).end()

    def member(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("no name")
        key, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        return key, at + 1

    holders: list[tuple] = []  # open objects and arrays, with the name of the member that is read
    at = 0
    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            value, at = ({} if c == "{" else []), skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key, at = member(at) if c == "{" else (None, at)
                holders.append((value, key))
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := NUMBER_RE.match(text, at):
            value, at = float(m[0]) if m[2] or m[3] else _integer(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("no value")
            value, at = _WORDS[word], at + len(word)
        while holders:
            holder, key = holders[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if key is not None:
                    key, at = member(at)
                    holders[-1] = (holder, key)
                break
            if c != ("]" if key is None else "}"):
                raise ValueError("not closed")
            holders.pop()
            value, at = holder, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("more than one value")
            return value


def read_document(body: str | None) -> dict | None:
    """The document, or null if there is none to be read; byte-order marks and a document inside a string are allowed."""
    for _ in range(2):
        if not isinstance(body, str):
            break
        try:
            body = loads(body.lstrip("﻿" + _BLANKS).rstrip(_BLANKS))
        except ValueError:
            return None
    return body if isinstance(body, dict) else None


def _nodes_of(place: dict) -> list | None:
    nodes = place.get("nodes")
    if isinstance(nodes, str):
        try:
            nodes = loads(nodes)
        except ValueError:
            nodes = None
    return nodes if isinstance(nodes, list) and nodes else None


def normalise(doc: dict) -> dict:
    """The document with its nodes at one place, under `nodes`, and their parameters as structures; all else stays where it is.

    The nodes are the first list that isn't empty of workflow.workflow.nodes, workflow.nodes and nodes. What stands as nodes at the top
    and isn't the one is kept as `other_nodes`. Parameters that hold no structure stay as they are.
    """
    outer = doc.get("workflow") if isinstance(doc.get("workflow"), dict) else None
    inner = outer.get("workflow") if outer and isinstance(outer.get("workflow"), dict) else None
    places = [p for p in (inner, outer, doc) if p is not None]
    found, of = next(((n, p) for p in places if (n := _nodes_of(p))), ([], None))
    rest = {k: v for k, v in doc.items() if k != "nodes"}
    if of is not None and of is outer:
        rest["workflow"] = {k: v for k, v in outer.items() if k != "nodes"}
    elif of is not None and of is inner:
        rest["workflow"] = outer | {"workflow": {k: v for k, v in inner.items() if k != "nodes"}}
    if of is not doc and "nodes" in doc:
        name = "other_nodes"
        while name in doc:
            name += "_"
        rest[name] = doc["nodes"]
    nodes = []
    for n in found:
        if isinstance(n, dict):
            held = n.get("parameters")
            for _ in range(2):  # text that holds a structure, once or twice
                if isinstance(held, str):
                    try:
                        held = loads(held)
                    except ValueError:
                        break
            if isinstance(held, (dict, list)):
                n = n | {"parameters": held}
        nodes.append(n)
    return rest | {"nodes": nodes}


def _projected(value, wanted: list[tuple[str, ...]]):
    """The parts of a value below any of the paths."""
    if () in wanted:
        return value
    if isinstance(value, dict):
        below = {w[0][1:]: [x[1:] for x in wanted if x[0] == w[0]] for w in wanted if w[0][0] == "."}
        return {k: _projected(value[k], w) for k, w in below.items() if k in value}
    if isinstance(value, list):
        below = [w[1:] for w in wanted if w[0] == ITEM]
        return [_projected(v, below) for v in value] if below else None
    return None


# What the kinds of a column's values are called, by their sum.
_KINDS = ["|".join(n for i, n in enumerate(("boolean", "number", "string")) if k >> i & 1) for k in range(8)] + ["object"]


def _kind(value) -> int:
    return 4 if isinstance(value, str) else 1 if isinstance(value, bool) else 2


class _Path:
    """A path of the schema: a node of the tree of all paths that occur in one document."""

    __slots__ = ("defs", "item", "kinds", "members", "reps", "above", "step", "vals", "scalar", "mark", "rep", "_columns")

    def __init__(self, above: _Path | None, step: str, rep: int):
        self.above, self.step, self.rep, self.members, self.item, self.scalar, self.mark = above, step, rep, {}, None, False, None
        self.reps, self.defs, self.vals, self.kinds, self._columns = [], [], [], 0, None

    @property
    def steps(self) -> tuple[str, ...]:
        out, p = [], self
        while p.above is not None:
            out.append(p.step)
            p = p.above
        return tuple(reversed(out))

    @property
    def columns(self) -> list[_Path]:
        """The paths from here on that are columns."""
        if self._columns is None:
            out, todo = [], [self]
            while todo:
                p = todo.pop()
                if p.scalar:
                    out.append(p)
                if p.mark is not None:
                    out.append(p.mark)
                todo += p.members.values()
                if p.item is not None:
                    todo.append(p.item)
            self._columns = out
        return self._columns


def _learn(path: _Path, value) -> None:
    todo = [(path, value)]  # a stack of its own: documents may be nested deeper than calls
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                if (p := path.members.get(k)) is None:
                    p = path.members[k] = _Path(path, "." + k, path.rep)
                if isinstance(v, (dict, list)):
                    todo.append((p, v))
                elif v is not None:
                    p.scalar = True
        elif isinstance(value, list):
            if path.item is None:
                path.item = _Path(path, ITEM, path.rep + 1)
                if path.step == ".nodes" and path.above.above is None:
                    path.item.mark = _Path(path.item, OBJECT, path.rep + 1)
            for v in value:
                if isinstance(v, (dict, list)):
                    todo.append((path.item, v))
                elif v is not None:
                    path.item.scalar = True


def _gap(path: _Path, rep: int, level: int) -> None:
    for c in path.columns:
        c.reps.append(rep)
        c.defs.append(level)
        c.vals.append(None)


def _emit(path: _Path, value, rep: int, level: int) -> None:
    """Append one entry, a value or a gap, to every column below the path."""
    todo = [(path, value, rep, level)]
    while todo:
        path, value, rep, level = todo.pop()
        if path.mark is not None:
            there = isinstance(value, dict)
            path.mark.reps.append(rep)
            path.mark.defs.append(level + 1 if there else level)
            path.mark.vals.append(OBJECT if there else None)
            if there:
                path.mark.kinds = 8
        if path.scalar:
            there = value is not None and not isinstance(value, (dict, list))
            path.reps.append(rep)
            path.defs.append(level + 1 if there else level)
            path.vals.append(_text(value) if there else None)
            if there:
                path.kinds |= _kind(value)
        if path.item is not None:
            if isinstance(value, list) and value:
                p = path.item
                if p.item is None and not p.members and p.mark is None:  # leaves
                    for i, v in enumerate(value):
                        there = v is not None and not isinstance(v, (dict, list))
                        p.reps.append(p.rep if i else rep)
                        p.defs.append(level + 2 if there else level + 1)
                        p.vals.append(_text(v) if there else None)
                        if there:
                            p.kinds |= _kind(v)
                else:
                    for i in range(len(value) - 1, -1, -1):
                        todo.append((p, value[i], rep if i == 0 else p.rep, level + 1))
            else:
                _gap(path.item, rep, level)
        if path.members:
            if isinstance(value, dict):
                for k, p in path.members.items():
                    v = value.get(k)
                    if p.item is None and not p.members:  # a leaf
                        if v is None:
                            p.reps.append(rep)
                            p.defs.append(level)
                            p.vals.append(None)
                            continue
                        there = not isinstance(v, (dict, list))
                        p.reps.append(rep)
                        p.defs.append(level + 2 if there else level + 1)
                        p.vals.append((v if isinstance(v, str) else _text(v)) if there else None)
                        if there:
                            p.kinds |= _kind(v)
                    elif v is None:
                        _gap(p, rep, level)
                    else:
                        todo.append((p, v, rep, level + 1))
            else:
                for p in path.members.values():
                    _gap(p, rep, level)


def shred_document(doc: dict):
    """(steps, repetition levels, definition levels, values, kind) of each leaf path of one document."""
    root = _Path(None, "", 0)
    _learn(root, doc)
    _emit(root, doc, 0, 0)
    for p in root.columns:
        yield p.steps, p.reps, p.defs, p.vals, _KINDS[p.kinds]


def _shredded(batches: Iterator[pa.RecordBatch], wanted: list[tuple[str, ...]] | None) -> Iterator[list[tuple]]:
    """Lists of (record, steps, reps, defs, vals, kind), of some tens of thousands of entries each."""
    rows, entries = [], 0
    for b in batches:
        for record, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            doc = read_document(body)
            if doc is None:
                continue
            doc = normalise(doc)
            for c in shred_document(_projected(doc, wanted) if wanted else doc):
                rows.append((record, *c))
                entries += len(c[1])
            if entries > 100_000:
                yield rows
                rows, entries = [], 0
    if rows:
        yield rows


def _whole(text):
    """Text, or lists of it, with U+FFFD for each half of a surrogate pair."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(text, str) else list(map(_whole, text)) if isinstance(text, (list, tuple)) else text


def _array(values, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array(_whole(values), kind)


def shred(df: DataFrame, id_col: str = "record_id", body_col: str = "body", wanted: list[tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document and leaf path with the column's level sequences; only paths below those wanted, if some are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
        for rows in _shredded(batches, wanted):
            yield pa.RecordBatch.from_arrays([_array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "steps", "reps", "defs", "vals", "kind"])

    return _documents(df, id_col, body_col).mapInArrow(run, COLUMNS)


def _documents(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    ship_package(df.sparkSession)
    return spread(df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(body_col).alias("body")))


def indexes(reps: list[int], depth: int) -> np.ndarray:
    """Position of each entry at every repeated ancestor, from the repetition levels alone: entry x level, level 1 first."""
    r = np.asarray(reps, np.int32)
    out = np.zeros((len(r), depth), np.int64)
    for level in range(1, depth + 1):
        starts = r < level  # the count at this level begins again
        steps = np.cumsum(r == level)
        out[:, level - 1] = steps - np.maximum.accumulate(np.where(starts, steps, 0))
    return out


def path_text(steps: list[str] | tuple[str, ...], at: list[int] | tuple[int, ...]) -> str:
    """A readable path; `at` are the positions of its array steps."""
    out, k = "", 0
    for s in steps:
        if s == ITEM:
            out += f"[{at[k]}]"
            k += 1
        elif s[0] == ".":
            out += s if out else s[1:]
    return out


Under = tuple[tuple[str, ...], ...]
PARAMETERS = (".nodes", ITEM, ".parameters")


def _places(steps: list[tuple[str, ...]], reps: list[list[int]], defs: list[list[int]]):
    """(column, entry, positions) of the values of columns: the column of each, its place among the entries, its index at each level."""
    size = np.fromiter(map(len, reps), np.int64, len(reps))
    total = int(size.sum())
    r = np.fromiter(chain.from_iterable(reps), np.int32, total)
    d = np.fromiter(chain.from_iterable(defs), np.int32, total)
    full = np.array([len(s) + (s[-1] != OBJECT) for s in steps], np.int32)
    column = np.repeat(np.arange(len(reps)), size)
    hit = np.flatnonzero(d == full[column])
    at = indexes(r, max(s.count(ITEM) for s in steps))[hit]
    starts = np.cumsum(size) - size
    return column[hit], hit - starts[column[hit]], at


def _assembled(rows: list[tuple], under: Under, values: bool) -> pa.RecordBatch | None:
    """(record_id, node_no, param_path[, value, kind]) of the values below any of some paths with one repeated step."""
    kept = [(x, max((u for u in under if x[1][: len(u)] == u and (len(x[1]) > len(u) or u[-1] == OBJECT)), key=len, default=None)) for x in rows]
    rows, heads = [x for x, u in kept if u], [len(u) for _, u in kept if u]
    if not rows:
        return None
    column, entry, at = _places([x[1] for x in rows], [x[2] for x in rows], [x[3] for x in rows])
    rests = [x[1][h:] for x, h in zip(rows, heads, strict=True)]
    plain = [path_text(s, ()) if ITEM not in s else None for s in rests]
    column, own = column.tolist(), at[:, 0]
    paths = [plain[c] if plain[c] is not None else path_text(rests[c], p[1:]) for c, p in zip(column, at.tolist() if any(p is None for p in plain) else column, strict=True)]
    out = [pa.array([rows[c][0] for c in column], pa.int64()), pa.array(own, pa.int64()), _array(paths, pa.string())]
    if values:
        out += [_array([rows[c][4][k] for c, k in zip(column, entry.tolist(), strict=True)], pa.string()), pa.array([rows[c][5] for c in column], pa.string())]
    return pa.RecordBatch.from_arrays(out, ["record_id", "node_no", "param_path", "value", "kind"][: len(out)])


_VALUES = "record_id bigint, node_no bigint, param_path string, value string, kind string"


def _rows_of(b: pa.RecordBatch) -> list[tuple]:
    return [(r, tuple(s), *x) for r, s, *x in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def assemble(columns: DataFrame, below: tuple[str, ...] = PARAMETERS) -> DataFrame:
    """(record_id, node_no, param_path, value, kind): the values under a repeated ancestor, with its position and their own path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if (out := _assembled(_rows_of(b), (below,), True)) is not None:
                yield out

    own = F.slice("steps", 1, len(below)) == F.array(*[F.lit(s) for s in below])
    return columns.where(own & (F.size("steps") > len(below))).mapInArrow(run, _VALUES)


def _assembled_documents(df: DataFrame, under: Under, values: bool) -> DataFrame:
    """Shred and assemble in one task, so that columns don't leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shredded(batches, list(under)):
            if (out := _assembled(rows, under, values)) is not None:
                yield out

    return _documents(df, "record_id", "body").mapInArrow(run, _VALUES if values else "record_id bigint, node_no bigint, param_path string")


def parameter_values(df: DataFrame) -> DataFrame:
    """(record_id, node_no, param_path, value, kind): every scalar below the parameters of a node."""
    return _assembled_documents(df, (PARAMETERS,), True)


def nodes_and_values(df: DataFrame) -> DataFrame:
    """(record_id, node_no, param_path): a row with an empty path per node object, and one per scalar below its parameters."""
    return _assembled_documents(df, ((".nodes", ITEM, OBJECT), PARAMETERS), False)


def node_table(df: DataFrame) -> DataFrame:
    """(record_id, node_no, type, name, n_values): the nodes, each with the number of values below its parameters."""
    values = parameter_values(df).groupBy("record_id", "node_no").agg(F.count("*").alias("n_values"))
    own = assemble(shred(df, wanted=[(".nodes", ITEM, ".type"), (".nodes", ITEM, ".name")]), (".nodes", ITEM))
    nodes = own.groupBy("record_id", "node_no").agg(F.max(F.when(F.col("param_path") == "type", F.col("value"))).alias("type"), F.max(F.when(F.col("param_path") == "name", F.col("value"))).alias("name"))
    return nodes.join(values, ["record_id", "node_no"], "left").select("record_id", "node_no", "type", "name", F.coalesce("n_values", F.lit(0)).alias("n_values"))


_TABLES = "record_id bigint, table_name string, row_key string, parent_table string, parent_key string, field string, value string, kind string"


def _table_of(steps: tuple[str, ...]) -> tuple[int, str, str | None, str]:
    """Of a column: how many repeated steps it has, its table, the table above, and its field."""
    steps = [s for s in steps if s != OBJECT]
    ends = [i + 1 for i, s in enumerate(steps) if s == ITEM]
    name = lambda end: "".join(steps[:end]).removeprefix(".")
    last, above = ends[-1] if ends else 0, ends[-2] if len(ends) > 1 else 0
    return len(ends), name(last), name(above) if ends else None, path_text(steps[last:], ())


def flat_tables(df: DataFrame, wanted: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(record_id, table_name, row_key, parent_table, parent_key, field, value, kind): the fields of a table per repeated ancestor.

    A table is named by its path (`nodes[]`, `nodes[].parameters.values[]`; '' is the document), a row of it by the positions of the
    ancestors on that path (`3`, `3.0`); the parent is the table of the ancestor above and the key of its row. A node object without a
    field has one with an empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _TABLES.split(", ")]
        for rows in _shredded(batches, wanted):
            steps = [x[1] for x in rows]
            column, entry, at = _places(steps, [x[2] for x in rows], [x[3] for x in rows])
            known = {s: _table_of(s) for s in set(steps)}
            facts = list(zip(*[known[s] for s in steps], strict=True))
            depth, starts = np.array(facts[0]), np.cumsum([0] + [len(x[4]) for x in rows])
            record, table, above, field, kind = (_array(c, k) for c, k in zip(([x[0] for x in rows], *facts[1:], [x[5] for x in rows]), [pa.int64()] + [pa.string()] * 4, strict=True))
            value = _array(list(chain.from_iterable(repeat(None, len(x[4])) if x[1][-1] == OBJECT else x[4] for x in rows)), pa.string())
            depths = depth[column]
            for d in np.unique(depths):  # keys of as many positions are joined at once
                own = np.flatnonzero(depths == d)
                c = pa.array(column[own])
                key = [pa.array(at[own, i]).cast(pa.string()) for i in range(d)]
                root = pa.array([""]).take(pa.array(np.zeros(len(own), np.int64)))
                own_key = pc.binary_join_element_wise(*key, ".") if key else root
                parent_key = pa.nulls(len(own), pa.string()) if not key else pc.binary_join_element_wise(*key[:-1], ".") if len(key) > 1 else root
                yield pa.RecordBatch.from_arrays([record.take(c), table.take(c), own_key, above.take(c), parent_key, field.take(c), value.take(pa.array(starts[column[own]] + entry[own])), kind.take(c)], names)

    return _documents(df, "record_id", "body").mapInArrow(run, _TABLES)


def flat_table(tables: DataFrame, table_name: str, fields: list[str]) -> DataFrame:
    """(record_id, row_key, parent_key, the fields): one of the tables with its fields as columns."""
    own = tables.where(F.col("table_name") == table_name)
    return own.groupBy("record_id", "row_key", "parent_key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
