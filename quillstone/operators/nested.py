"""Problem 2: deeply nested JSON records as flat tables that keep their parents.

A first pass infers the merged schema: every path below the chosen roots with the kinds of value seen there. A second
pass explodes each array level of a record in one narrow stage: every array element becomes a row that carries its own
surrogate key, its parent's, the path of its array and its ordinal. The root table and the child tables with typed values
are made by ``tables``. The recursion over unknown depth, JSON held in text at any level and kinds that
change from row to row cannot be stated with built-in functions, so both passes are Arrow-batched Python; there is no
shuffle but that of the small schema aggregation.

Defined cases: null, torn and non-object records give no rows. Missing and null roots are skipped. JSON text counts as
what it holds, also when encoded more than once. A single object under a name that holds an array anywhere in the table
counts as an array of it. Null elements take an ordinal but give no row. Repeated rows give their rows again. Long
records are processed whole; nesting deeper than the JSON parser can read counts as torn.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More paths than this are data, not a schema; the inference then fails instead of growing without bound.
MAX_PATHS = 100_000


def read_json(text: object) -> object:
    """The value of one line; None for null and torn lines."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def unwrapped(value: object) -> object:
    """What a text holds if it holds an object or array, else the value itself."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = read_json(value)
        if inner is None or (isinstance(inner, str) and inner.lstrip()[:1] not in ("{", "[", '"')):
            return value
        value = inner
    return value


def kind_of(value: object) -> str:
    """object, array, text, whole number, decimal number, truth value; '' for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "truth value"
    return {dict: "object", list: "array", str: "text", int: "whole number", float: "decimal number"}[type(value)]


def merged_schema(df: DataFrame, record: str, roots: Sequence[str]) -> DataFrame:
    """(path, name, kind, n): the merged schema below ``roots``; array levels are written ``[]``."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["r"]:
                rec = read_json(text)
                if not isinstance(rec, dict):
                    continue
                todo = [(root, root, rec[root]) for root in roots if root in rec]
                while todo:
                    path, name, value = todo.pop()
                    value = unwrapped(value)
                    seen[path, name, kind_of(value)] += 1
                    if isinstance(value, dict):
                        todo += [(f"{path}.{k}", k, v) for k, v in value.items()]
                    elif isinstance(value, list):
                        todo += [(f"{path}[]", "", v) for v in value]
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "name", "kind", "n"])

    parts = df.select(F.col(record).cast("string").alias("r")).mapInPandas(
        paths, "path string, name string, kind string, n long"
    )
    return parts.groupBy("path", "name", "kind").agg(F.sum("n").alias("n"))


def array_names(schema: DataFrame, max_paths: int = MAX_PATHS) -> set[str]:
    """Names under which an array was seen; the schema must have fewer than ``max_paths`` of them."""
    rows = schema.where("kind = 'array' and name <> ''").select("name").distinct().limit(max_paths).collect()
    if len(rows) >= max_paths:
        raise ValueError(f"{max_paths} names or more hold arrays: these names are data")
    return {r["name"] for r in rows}


NODE_SCHEMA = (
    "record_id {id}, table string, path string, ordinal int, kind string, "
    "parent_path string, parent_ordinal int, body string"
)


def explode_nested(
    df: DataFrame, id_col: str, record: str, roots: Sequence[str], arrays: set[str] | None = None
) -> DataFrame:
    """One row per non-null array element at any depth, of every kind.

    ``table`` is the path without ordinals (one child table each), ``node_id`` and ``parent_id`` are surrogate keys
    (the parent of an outermost element is the record itself), ``body`` is the element as JSON.
    """
    if arrays is None:
        arrays = array_names(merged_schema(df, record, roots))
    names = frozenset(arrays)

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch["i"], batch["r"], strict=True):
                rec = read_json(text)
                if not isinstance(rec, dict):
                    continue
                # path, table, name, value, path and ordinal of the enclosing element
                todo = [(root, root, root, rec[root], None, None) for root in roots if root in rec]
                while todo:
                    path, table, name, value, up, up_ord = todo.pop()
                    value = unwrapped(value)
                    if isinstance(value, dict) and name in names:
                        value = [value]
                    if isinstance(value, list):
                        for k, v in enumerate(value):
                            v = unwrapped(v)
                            if v is None:
                                continue
                            out.append((rid, table, path, k, kind_of(v), up, up_ord, json.dumps(v, ensure_ascii=False)))
                            if isinstance(v, dict):
                                at = f"{path}[{k}]"
                                todo += [(f"{at}.{a}", f"{table}[].{a}", a, b, path, k) for a, b in v.items()]
                            elif isinstance(v, list):
                                todo.append((f"{path}[{k}]", f"{table}[]", "", v, path, k))
                    elif isinstance(value, dict):
                        todo += [(f"{path}.{a}", f"{table}.{a}", a, b, up, up_ord) for a, b in value.items()]
            frame = pd.DataFrame(
                out, columns=["record_id", "table", "path", "ordinal", "kind", "parent_path", "parent_ordinal", "body"]
            )
            yield frame.astype({"parent_ordinal": "Int32"})

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("i"), F.col(record).cast("string").alias("r")).mapInPandas(
        nodes, NODE_SCHEMA.format(id=id_type)
    )
    return node_keys(rows)


def node_keys(rows: DataFrame) -> DataFrame:
    """Adds ``node_id`` and ``parent_id``; rows without ordinal are the records themselves and have no parent."""
    key = lambda p, o: F.md5(F.concat_ws("\u0001", F.col("record_id").cast("string"), p, o.cast("string")))
    root = F.md5(F.col("record_id").cast("string"))
    own = F.when(F.col("ordinal").isNull(), root).otherwise(key(F.col("path"), F.col("ordinal")))
    parent = F.when(F.col("parent_path").isNull(), root).otherwise(key(F.col("parent_path"), F.col("parent_ordinal")))
    return rows.withColumns({"node_id": own, "parent_id": F.when(F.col("ordinal").isNotNull(), parent)})


def object_elements(df: DataFrame, id_col: str, record: str, roots: Sequence[str]) -> DataFrame:
    """(id, path, ordinal) of every object that is an element of an array."""
    nodes = explode_nested(df, id_col, record, roots).where("kind = 'object'")
    return nodes.select(F.col("record_id").alias(id_col), "path", "ordinal")


def child_table(nodes: DataFrame, table: str, schema: str) -> DataFrame:
    """The child table of one array level: keys, ordinal and the typed members of ``schema``."""
    rows = nodes.where(F.col("table") == table)
    return rows.select(
        "record_id", "node_id", "parent_id", "ordinal", F.from_json("body", schema).alias("v")
    ).select("record_id", "node_id", "parent_id", "ordinal", "v.*")
