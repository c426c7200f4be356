"""Columnar shredding of nested records.

A JSON record is striped into one column for each leaf path. An entry of a column holds a repetition level (the
depth of the array at which the path repeats; 0 starts a record), a definition level (how many optional or
repeated steps of the path exist) and a value. Beside the scalar leaves, every array has a marker column whose
values are the kinds of its elements, so that elements without scalar fields are not lost. The table of a repeated
ancestor is rebuilt from the level sequences alone: counters over the repetition levels give the index of each
element at every depth, and the deepest object around it is its parent.

Defined cases: null, empty or invalid JSON (also NaN and Infinity) gives no column; nesting may have any depth; a key
that occurs twice keeps its last value; half surrogates become U+FFFD; an object or array that is empty leaves only
its marker entry.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a path besides the keys, which are strings: into an array; from an array to its marker column.
REP, MARK = 0, 1

Path = tuple[str | int, ...]


def _no_constant(name: str) -> None:
    raise ValueError(name)


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_LITERALS = {"true": True, "false": False, "null": None}


def parse_deep(text: str) -> object:
    """json.loads for nesting of any depth: open containers are kept on a list."""
    skip = lambda i: _SPACE.match(text, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return k, skip(i + 1)

    open_: list[tuple[dict | list, str]] = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        v: object
        if c == "{" or c == "[":
            v = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                k, i = key_at(i) if c == "{" else ("", i)
                open_.append((v, k))
                continue
            i += 1
        elif c == '"':
            v, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            v, i = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
        else:
            name = next((n for n in _LITERALS if text.startswith(n, i)), None)
            if name is None:
                raise ValueError(i)
            v, i = _LITERALS[name], i + len(name)
        # v is whole: put it into its container, and close containers that end here.
        while open_:
            box, k = open_.pop()
            if isinstance(box, dict):
                box[k] = v
            else:
                box.append(v)
            i = skip(i)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                k, i = key_at(i) if isinstance(box, dict) else ("", i)
                open_.append((box, k))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(i)
            v, i = box, i + 1
        else:
            if skip(i) != len(text):
                raise ValueError(i)
            return v


def parse(text: str | None) -> tuple[bool, object]:
    """(is valid, value)."""
    if not text:
        return False, None
    try:
        try:
            return True, json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            return True, parse_deep(text)
    except ValueError:
        return False, None


class Column_:
    """Entries of one leaf path."""

    __slots__ = ("reps", "defs", "values")

    def __init__(self) -> None:
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.values: list[str | None] = []


def schema_of(value: object) -> dict:
    """The tree of steps below a record: keys and REP; the entry None marks a scalar."""
    tree: dict = {}
    todo = [(value, tree)]
    while todo:
        v, node = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                todo.append((x, node.setdefault(k, {})))
        elif isinstance(v, list):
            below = node.setdefault(REP, {})
            for x in v:
                todo.append((x, below))
        else:
            node[None] = True
    return tree


_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def kind_of(v: object) -> str:
    return _KIND.get(type(v), "number")


def shred(value: object, markers_only: bool = False) -> dict[Path, Column_]:
    """Stripe one record. Paths of scalars end in a key or REP; marker columns end in MARK."""
    out: dict[Path, Column_] = {}

    def put(path: Path, r: int, d: int, v: str | None) -> None:
        if (c := out.get(path)) is None:
            c = out[path] = Column_()
        c.reps.append(r)
        c.defs.append(d)
        c.values.append(v)

    absent = object()
    # Depth first, without recursion; entries of a column come in record order.
    todo: list = [(value, schema_of(value), (), 0, 0, 0)]
    while todo:
        v, node, path, r, d, depth = todo.pop()
        if None in node and not markers_only:
            scalar = v is not absent and not isinstance(v, (dict, list))
            put(path, r, d + 1 if scalar and v is not None else d, (v if isinstance(v, str) else json.dumps(v)) if scalar and v is not None else None)
        below = []
        for step, child in node.items():
            if step is None:
                continue
            if step == REP:
                mark = (*path, REP, MARK)
                if isinstance(v, list) and v:
                    for i, x in enumerate(v):
                        at = r if i == 0 else depth + 1
                        put(mark, at, d + 1, kind_of(x))
                        below.append((x, child, (*path, REP), at, d + 1, depth + 1))
                else:
                    put(mark, r, d, None)
                    below.append((absent, child, (*path, REP), r, d, depth + 1))
            else:
                has = isinstance(v, dict) and step in v
                below.append((v[step] if has else absent, child, (*path, step), r, d + has, depth))
        todo.extend(reversed(below))
    return out


def indices(path: Path, column: Column_) -> Iterator[tuple[list[int], int]]:
    """(index at every repeated step, entry number) of the entries that exist down to the last repeated step."""
    at = [i for i, s in enumerate(path) if s == REP]
    need = [i + 1 for i in at]  # every step down to it is defined
    counters = [0] * len(at)
    for n, (r, d) in enumerate(zip(column.reps, column.defs)):
        if r == 0:
            counters = [0] * len(at)
        else:
            counters[r - 1] += 1
            counters[r:] = [0] * (len(at) - r)
        if not at or d >= need[-1]:
            yield counters, n


def spell(root: str, path: Path, index: list[int]) -> tuple[str, str]:
    """The path of an element and of the nearest enclosing object that is an element itself (else root)."""
    said, parent, k = f"{root}.data", root, 0
    for i, step in enumerate(path):
        if step == REP:
            said += f"[{index[k]}]"
            k += 1
            if i + 1 < len(path) and path[i + 1] != REP:
                parent = said
        else:
            said += "." + step
    return said, parent


def clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode("utf-8") if not s.isascii() and any("\ud800" <= c <= "\udfff" for c in s) else s


def _responses(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", F.posexplode("xhr_responses").alias("pos", "response")).select("page_id", "pos", F.col("response.data").alias("data")).where("data is not null and data <> ''")


def object_rows(pages: DataFrame) -> DataFrame:
    """(page_id, path, parent_path): every JSON object that is an element of an array."""

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, paths, parents = [], [], []
            for page, pos, text in zip(batch["page_id"], batch["pos"], batch["data"]):
                ok, value = parse(text)
                if not ok:
                    continue
                root = f"xhr_responses[{pos}]"
                columns = shred(value, markers_only=True)
                for path, column in columns.items():
                    values = column.values
                    for index, n in indices(path[:-1], column):
                        if values[n] == "object":
                            said, parent = spell(root, path[:-1], index)
                            ids.append(page)
                            paths.append(clean(said))
                            parents.append(clean(parent))
            yield pd.DataFrame({"page_id": pd.Series(ids, dtype="int64"), "path": pd.Series(paths, dtype=object), "parent_path": pd.Series(parents, dtype=object)})

    return _responses(pages).mapInPandas(assemble, "page_id bigint, path string, parent_path string")


def leaf_columns(pages: DataFrame) -> DataFrame:
    """(page_id, pos, leaf_path, reps, defs, vals): the striped columns of every response."""

    def stripe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, pos, text in zip(batch["page_id"], batch["pos"], batch["data"]):
                ok, value = parse(text)
                if not ok:
                    continue
                columns = shred(value)
                for path, c in columns.items():
                    name = "data" + "".join({REP: "[]", MARK: "#kind"}.get(s) or f".{s}" for s in path)
                    out.append((page, pos, clean(name), c.reps, c.defs, [v if v is None else clean(v) for v in c.values]))
            yield pd.DataFrame(out, columns=["page_id", "pos", "leaf_path", "reps", "defs", "vals"])

    return _responses(pages).mapInPandas(stripe, "page_id bigint, pos int, leaf_path string, reps array<int>, defs array<int>, vals array<string>")


def field_rows(pages: DataFrame) -> DataFrame:
    """(page_id, path, field, value): the scalar leaves of every response, each with its innermost array element."""

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, pos, text in zip(batch["page_id"], batch["pos"], batch["data"]):
                ok, value = parse(text)
                if not ok:
                    continue
                root = f"xhr_responses[{pos}]"
                columns = shred(value)
                for path, c in columns.items():
                    if path and path[-1] == MARK:
                        continue
                    last = max((i for i, s in enumerate(path) if s == REP), default=-1)
                    field = ".".join(path[last + 1 :])
                    for index, n in indices(path, c):
                        if c.defs[n] == len(path) + 1:
                            said = spell(root, path[: last + 1], index)[0] if last >= 0 else root
                            out.append((page, clean(said), clean(field), clean(c.values[n])))
            yield pd.DataFrame(out, columns=["page_id", "path", "field", "value"])

    return _responses(pages).mapInPandas(assemble, "page_id bigint, path string, field string, value string")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, path, parent_path, cells): every row of every table; blank rows count."""
    tables = pages.select("page_id", F.posexplode("tables").alias("t", "rows"))
    rows = tables.select("page_id", "t", F.posexplode("rows").alias("r", "cells"))
    parent: Column = F.concat(F.lit("tables["), F.col("t"), F.lit("]"))
    return rows.select("page_id", F.concat(parent, F.lit("["), F.col("r"), F.lit("]")).alias("path"), parent.alias("parent_path"), "cells")


def nested_rows(pages: DataFrame) -> DataFrame:
    """The links of all flat tables: objects in arrays of xhr_responses, and rows of tables."""
    return object_rows(pages).unionByName(table_rows(pages).drop("cells"))
