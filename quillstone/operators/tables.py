"""Problem 2, the values: the root table and one typed child table per array level.

A row stands for a record (the root table, named '') or for an array element, and carries the members of its object that
are no arrays, those of objects within it under their joined names; a scalar element has the column ``value``. Arrays are
left to their own tables, so each value of a record is in exactly one row. The columns come from the merged schema of a
table's members: each has the type that most of its values can be read as, and what does not fit is kept in ``extras``.
Keys, paths and the defined cases are those of ``nested``; a record without any of the roots still has its root row.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.drift import SQL_TYPE, cast_value, column_kind, column_names, form_of
from quillstone.operators.nested import MAX_PATHS, array_names, kind_of, merged_schema, node_keys, read_json, unwrapped

#: table, path, ordinal, kind, path and ordinal of the parent, {member path: value}
Node = tuple[str, str, int | None, str, str | None, int | None, dict[tuple, object]]


def nodes_of(rec: dict, roots: Sequence[str], names: frozenset[str]) -> Iterator[Node]:
    """The root row of a record and one row per non-null array element at any depth."""
    start = {root: rec[root] for root in roots if root in rec}
    todo: list[tuple] = [("", "", None, start, None, None)]
    while todo:
        table, path, ordinal, value, up, up_ord = todo.pop()
        at = "" if ordinal is None else f"{path}[{ordinal}]"
        inside = "" if ordinal is None else f"{table}[]"
        members: dict[tuple, object] = {}
        own = None if ordinal is None else path
        # path below the row's own object, name and value
        walk: list[tuple] = [((), "", value)]
        while walk:
            below, name, v = walk.pop()
            v = unwrapped(v)
            if isinstance(v, dict) and below and name in names:
                v = [v]
            if isinstance(v, list):
                dots = "".join(f".{k}" for k in below)
                t, p = (f"{inside}{dots}", f"{at}{dots}") if at else (dots[1:], dots[1:])
                todo += [(t, p, k, x, own, ordinal) for k, x in enumerate(map(unwrapped, v)) if x is not None]
            elif isinstance(v, dict) and (v or not below):
                walk += [((*below, k), k, x) for k, x in v.items()]
            else:
                members[below] = v
        yield table, path, ordinal, kind_of(value), up, up_ord, members


_KEYS = "record_id {id}, table string, path string, ordinal int, kind string, parent_path string, parent_ordinal int"
_NAMES = ["record_id", "table", "path", "ordinal", "kind", "parent_path", "parent_ordinal"]
_INTS = {"ordinal": "Int32", "parent_ordinal": "Int32"}


def _lines(df: DataFrame, id_col: str, record: str) -> DataFrame:
    return df.select(F.col(id_col).alias("i"), F.col(record).cast("string").alias("r"))


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def all_rows(df: DataFrame, id_col: str, record: str, roots: Sequence[str]) -> DataFrame:
    """The rows of all tables, the root rows as table '', with ``body``: their members as JSON, by dotted path.

    The body of a scalar element is its value.
    """
    names = frozenset(array_names(merged_schema(df, record, roots)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text in zip(batch["i"], batch["r"], strict=True):
                rec = read_json(text)
                if isinstance(rec, dict):
                    for *keys, members in nodes_of(rec, roots, names):
                        body = members[()] if () in members else {_dotted(p): v for p, v in members.items()}
                        out.append((rid, *keys, json.dumps(body, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=[*_NAMES, "body"]).astype(_INTS)

    flat = _lines(df, id_col, record).mapInPandas(rows, _KEYS.format(id=_id_type(df, id_col)) + ", body string")
    return node_keys(flat)


def _dotted(path: tuple) -> str:
    return ".".join(k.replace(".", r"\.") for k in path)


def typed_table(
    df: DataFrame, id_col: str, record: str, roots: Sequence[str], table: str, max_fields: int = MAX_PATHS
) -> DataFrame:
    """One table: keys, ordinal, a typed column per member that any row has, and ``extras``."""
    names = frozenset(array_names(merged_schema(df, record, roots)))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for rec in map(read_json, batch["r"]):
                if isinstance(rec, dict):
                    for at, *_, members in nodes_of(rec, roots, names):
                        if at == table:
                            seen.update(("\u0001".join(p), form_of(v)) for p, v in members.items())
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "form", "n"])

    lines = _lines(df, id_col, record)
    counted = lines.mapInPandas(forms, "path string, form string, n long").groupBy("path", "form").agg(F.sum("n").alias("n"))
    found: dict[tuple, dict[str, int]] = {}
    for r in counted.limit(max_fields + 1).collect():
        found.setdefault(tuple(r["path"].split("\u0001")) if r["path"] else (), {})[r["form"]] = r["n"]
    if sum(map(len, found.values())) > max_fields:
        raise ValueError(f"more than {max_fields} members: these names are data")
    # a null in place of an object or array is no member of its own
    within = {p[:k] for p in found for k in range(len(p))}
    empty = {p for p in found if set(found[p]) == {""} and (p in within or p[-1:] and p[-1] in names)}
    kinds = {p: k for p in sorted(found) if p not in empty and (k := column_kind(found[p]))}
    keys = ["record_id", "node_id", "parent_id", "path", "ordinal"]
    heads = column_names([p or ("value",) for p in kinds], [*keys, "extras"])
    inner = {p: f"c{k}" for k, p in enumerate(kinds)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, values = [], []
            for rid, text in zip(batch["i"], batch["r"], strict=True):
                rec = read_json(text)
                if not isinstance(rec, dict):
                    continue
                for node in nodes_of(rec, roots, names):
                    if node[0] != table:
                        continue
                    row, extra = {}, {}
                    for p, v in node[-1].items():
                        if v is None or v == {}:
                            continue
                        cast, whole = cast_value(v, kinds[p]) if p in kinds else (None, False)
                        if p in inner:
                            row[inner[p]] = cast
                        if not whole:
                            extra[_dotted(p)] = json.dumps(v, ensure_ascii=False)
                    out.append((rid, *node[:-1], extra))
                    values.append(row)
            frame = pd.DataFrame(out, columns=[*_NAMES, "extras"]).astype(_INTS)
            cols = {c: pd.Series([r.get(c) for r in values], dtype=object) for c in inner.values()}
            yield pd.concat([frame, pd.DataFrame(cols)], axis=1)

    types = [f"{inner[p]} {SQL_TYPE[k]}" for p, k in kinds.items()]
    schema = ", ".join([_KEYS.format(id=_id_type(df, id_col)), "extras map<string,string>", *types])
    made = node_keys(lines.mapInPandas(rows, schema))
    return made.select(*keys, *[F.col(inner[p]).alias(h) for p, h in zip(kinds, heads, strict=True)], "extras")
