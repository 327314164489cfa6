"""Problem 4: schemas that drift between files.

The fields of every file are aggregated to one small schema row a file; each schema is then matched with that of the
file before it by similarity flooding: pairs of fields start from the likeness of their names and types, scores flow
between a pair and the pairs of its members and its parent until they settle, and consistent one-to-one
correspondences are selected. Matching works on schemas, so its cost does not depend on the rows of a file. The same
matching against the prevailing schema of the whole table gives the other names of its fields: each file votes for the
names it matches, and a name that stands beside the prevailing one in as many files is another field. Fields outside the
prevailing schema keep their own name below their canonical parent, so every field that any file has is in the table.

Defined cases: null, torn and non-object lines are left out; a file without a readable line is no file. A field whose
values are all null belongs to its file but has no type: it can be renamed to a field of any type, and is never
retyped. If a field has several types in one file, its most frequent one counts (the first by name of equals). Repeated
lines change nothing. Empty tables give empty results. Runs with a null id form one run.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.nested import kind_of, read_json, unwrapped
from quillstone.session import cut

#: Files of a run that one window task orders at most; the rest is linked from bucket to bucket.
BUCKET = 1024


def file_fields(df: DataFrame, record: str, file_key: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    """One row a file: ``fields``, an array of (path, kind), sorted by path. Members of arrays are no fields."""
    skip, keys = frozenset(ignore), list(file_key)
    names = [f"k{i}" for i in range(len(keys))]

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for *key, text in batch[[*names, "r"]].itertuples(index=False, name=None):
                rec = read_json(text)
                if not isinstance(rec, dict):
                    continue
                key = tuple(None if pd.isna(k) else k for k in key)
                seen[(*key, "", "object")] += 1
                todo = [((k,), v) for k, v in rec.items() if k not in skip]
                while todo:
                    path, value = todo.pop()
                    seen[(*key, "\u0001".join(path), kind_of(value))] += 1
                    if isinstance(value, dict):
                        todo += [((*path, k), v) for k, v in value.items()]
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=[*names, "path", "kind", "n"])

    types = [f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)]
    parts = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(record).cast("string").alias("r")
    ).mapInPandas(fields, ", ".join([*types, "path string", "kind string", "n long"]))
    counted = parts.groupBy(*names, "path", "kind").agg(F.sum("n").alias("n"))
    # '' (null) counts least, then the most frequent kind, then the first by name
    az = "abcdefghijklmnopqrstuvwxyz"
    rank = F.struct((F.col("kind") != "").alias("a"), F.col("n"), F.translate("kind", az, az[::-1]).alias("b"))
    best = F.max_by("kind", rank)
    one = counted.groupBy(*names, "path").agg(best.alias("kind"))
    files = one.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("path", "kind"))).alias("fields"))
    return files.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "fields")


def with_predecessor(files: DataFrame, run: str, seq: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``prev``: the next smaller ``seq`` of the run; a window sees one bucket of a run, or one row a bucket."""
    ids = files.select(run, seq).withColumn("_b", F.floor(F.col(seq) / bucket))
    inside = Window.partitionBy(run, "_b").orderBy(seq)
    ids = ids.withColumn("_in", F.lag(seq).over(inside))
    tops = ids.groupBy(run, "_b").agg(F.max(seq).alias("_top"))
    before = tops.withColumn("_before", F.lag("_top").over(Window.partitionBy(run).orderBy("_b"))).drop("_top")
    linked = ids.alias("i").join(
        before.alias("t"), F.col(f"i.{run}").eqNullSafe(F.col(f"t.{run}")) & F.col("i._b").eqNullSafe(F.col("t._b")), "left"
    )
    return linked.select(F.col(f"i.{run}").alias(run), F.col(f"i.{seq}").alias(seq), F.coalesce("_in", "_before").alias("prev"))


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", name)]


def name_likeness(a: str, b: str) -> float:
    """0 to 1: shared words and shared letter trigrams of two names."""
    wa, wb = _words(a), _words(b)
    if wa and sorted(wa) == sorted(wb):
        return 1.0
    words = 2 * sum((Counter(wa) & Counter(wb)).values()) / max(1, len(wa) + len(wb))
    grams = lambda ws: Counter(s[i : i + 3] for s in ["  " + "".join(ws) + " "] for i in range(len(s) - 2))
    ga, gb = grams(wa), grams(wb)
    return max(words, 2 * sum((ga & gb).values()) / max(1, sum(ga.values()) + sum(gb.values())))


Schema = dict[tuple[str, ...], str]


def flood(old: Schema, new: Schema, rounds: int = 50, eps: float = 1e-4) -> dict[tuple, float]:
    """Scores of all pairs of fields at the same depth that could correspond, after similarity flooding.

    A pair is a node of the propagation graph; its neighbours are the pair of the parents and the pairs of the members.
    """

    def level(s: Schema) -> dict[tuple, list[tuple]]:
        tree: dict[tuple, list[tuple]] = {}
        for p in s:
            tree.setdefault(p[:-1], []).append(p)
        return tree

    kids_a, kids_b = level(old), level(new)
    start: dict[tuple, float] = {}
    todo: list[tuple] = [((), ())]
    edges: dict[tuple, list[tuple]] = {}
    while todo:
        up = todo.pop()
        stay = {a[-1] for a in kids_a.get(up[0], ())} & {b[-1] for b in kids_b.get(up[1], ())}
        for a in kids_a.get(up[0], ()):
            for b in kids_b.get(up[1], ()):
                # a name on both sides stays; other names can only correspond if their kinds agree
                if a[-1] != b[-1] and (a[-1] in stay or b[-1] in stay or (old[a] and new[b] and old[a] != new[b])):
                    continue
                pair = (a, b)
                start[pair] = 2.0 if a[-1] == b[-1] else 0.1 + name_likeness(a[-1], b[-1])
                edges.setdefault(pair, [])
                if up in start:
                    edges[pair].append(up)
                    edges[up].append(pair)
                if old[a] == new[b] == "object":
                    todo.append(pair)
    score = dict(start)
    for _ in range(rounds):
        flow = {p: start[p] + sum(score[q] / len(edges[q]) for q in edges[p]) for p in start}
        top = max(flow.values(), default=1.0)
        flow = {p: v / top for p, v in flow.items()}
        change = max((abs(flow[p] - score[p]) for p in flow), default=0.0)
        score = flow
        if change < eps:
            break
    return score


def correspondences(old: Schema, new: Schema, near: float = 0.5) -> dict[tuple, tuple]:
    """Consistent one-to-one correspondences: parents correspond, kinds agree, names agree wherever they can.

    A renamed object must keep at least ``near`` of its members.
    """
    score = flood(old, new)
    by_parent: dict[tuple, list[tuple]] = {}
    for a, b in score:
        by_parent.setdefault((a[:-1], b[:-1]), []).append((a, b))
    members = lambda s, p: {q[len(p) :] for q in s if q[: len(p)] == p and len(q) == len(p) + 1}

    def nearly(a: tuple, b: tuple) -> bool:
        if old[a] != "object" or new[b] != "object":
            return True
        ma, mb = members(old, a), members(new, b)
        return len(ma & mb) >= near * max(len(ma), len(mb))

    found: dict[tuple, tuple] = {}
    todo = [((), ())]
    while todo:
        up = todo.pop()
        pairs = by_parent.get(up, [])
        taken_a: set[tuple] = set()
        taken_b: set[tuple] = set()
        same = [(a, b) for a, b in pairs if a[-1] == b[-1]]
        rest = sorted((p for p in pairs if nearly(*p)), key=lambda p: (-score[p], p))
        for a, b in [*same, *rest]:
            if a in taken_a or b in taken_b:
                continue
            taken_a.add(a)
            taken_b.add(b)
            found[a] = b
            if old[a] == new[b] == "object":
                todo.append((a, b))
    return found


def _retyped(a: str, b: str) -> bool:
    return bool(a and b and a != b)


def changes_between(old: Schema, new: Schema) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) between two schemas."""
    match = correspondences(old, new)
    back = {b: a for a, b in match.items()}
    dots = ".".join
    out = []
    for a, kind in old.items():
        up = a[:-1]
        if up and (up not in match or _retyped(old[up], new[match[up]])):
            continue
        if a not in match:
            out.append(("removed", dots(a), ""))
            continue
        b = match[a]
        if a[-1] != b[-1]:
            out.append(("renamed", dots(a), dots(b)))
        if _retyped(kind, new[b]):
            out.append(("retyped", dots(a), dots(b)))
    for b in new:
        up = b[:-1]
        if b in back or (up and (up not in back or _retyped(old[back[up]], new[up]))):
            continue
        out.append(("added", "", dots(b)))
    return out


def _schema(fields: object) -> Schema:
    return {tuple(f["path"].split("\u0001")): f["kind"] for f in fields if f["path"]}


def schema_changes(df: DataFrame, run: str, seq: str, record: str, ignore: Sequence[str]) -> DataFrame:
    """(run, seq, change, old_field, new_field): every change between a file and the one before it in its run."""
    files = file_fields(df, record, [run, seq], ignore).select(
        F.col(run).alias("run"), F.col(seq).alias("seq"), "fields"
    )
    files = cut(files, "file-fields")
    links = with_predecessor(files, "run", "seq").where("prev is not null")
    new, old = files.alias("n"), files.alias("o")
    k = links.alias("k")
    pairs = (
        k.join(new, F.col("k.run").eqNullSafe(F.col("n.run")) & F.col("k.seq").eqNullSafe(F.col("n.seq")))
        .join(old, F.col("k.run").eqNullSafe(F.col("o.run")) & F.col("k.prev").eqNullSafe(F.col("o.seq")))
        .select(F.col("k.run").alias("run"), F.col("k.seq").alias("seq"), F.col("o.fields").alias("a"), F.col("n.fields").alias("b"))
        .where("a <> b")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (r, s, *c)
                for r, s, a, b in zip(batch["run"], batch["seq"], batch["a"], batch["b"], strict=True)
                for c in changes_between(_schema(a), _schema(b))
            ]
            yield pd.DataFrame(out, columns=["run", "seq", "change", "old_field", "new_field"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    out = pairs.mapInPandas(
        compare, f"run {kinds['run']}, seq {kinds['seq']}, change string, old_field string, new_field string"
    )
    return out.select(F.col("run").alias(run), F.col("seq").alias(seq), "change", "old_field", "new_field")


def _bounded(rows: DataFrame, max_fields: int) -> list:
    found = rows.limit(max_fields + 1).collect()
    if len(found) > max_fields:
        raise ValueError(f"more than {max_fields} fields: these names are data")
    return found


def prevailing_schema(files: DataFrame, targets: Sequence[str], share: float = 0.5, max_fields: int = 10_000) -> Schema:
    """The fields below ``targets`` that at least ``share`` of the files holding the target have, by their commonest kind."""
    each = files.select(F.explode("fields").alias("f")).select("f.path", "f.kind")
    each = each.where(F.split("path", "\u0001")[0].isin(*targets) & (F.col("kind") != ""))
    rows = _bounded(each.groupBy("path", "kind").agg(F.count("*").alias("n")), max_fields)
    best: dict[str, tuple[int, str]] = {}
    total: Counter = Counter()
    for r in rows:
        total[r["path"]] += r["n"]
        best[r["path"]] = max(best.get(r["path"], (0, "")), (r["n"], r["kind"]))
    keep = {p: k for p, (_, k) in best.items() if total[p] >= share * total[p.split("\u0001")[0]]}
    return {tuple(p.split("\u0001")): k for p, k in keep.items()}


Aliases = dict[tuple[int, str], list[str]]


def other_names(files: DataFrame, canon: Schema, max_fields: int = 10_000) -> Aliases:
    """(depth, name) of other names to the canonical names they stand for, the likeliest first.

    A name stands for another if more files match the two than have both beside each other in one object.
    """
    known = frozenset((len(c), c[-1]) for c in canon)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for fields in batch["fields"]:
                schema = _schema(fields)
                pairs = {(len(c), c[-1], b[-1]) for c, b in correspondences(canon, schema).items()}
                seen.update((*p, 1) for p in pairs if p[1] != p[2])
                objects: dict[tuple, set[str]] = {}
                for path in schema:
                    objects.setdefault(path[:-1], set()).add(path[-1])
                beside = set()
                for up, names in objects.items():
                    here = {n for n in names if (len(up) + 1, n) in known}
                    beside |= {(len(up) + 1, c, n) for c in here for n in names - here}
                seen.update((*p, -1) for p in beside)
            rows = [(*k[:3], k[3] * n) for k, n in seen.items()]
            yield pd.DataFrame(rows, columns=["depth", "name", "other", "n"])

    each = files.select("fields").mapInPandas(votes, "depth int, name string, other string, n long")
    rows = _bounded(each.groupBy("depth", "name", "other").agg(F.sum("n").alias("n")).where("n > 0"), max_fields)
    out: Aliases = {}
    for r in sorted(rows, key=lambda r: (-r["n"], r["name"])):
        out.setdefault((r["depth"], r["other"]), []).append(r["name"])
    return out


def canonical_values(rec: dict, canon: Schema, aliases: Aliases, ignore: frozenset[str]) -> Iterator[tuple[tuple, object]]:
    """(canonical path, value) of every member that is no object, and of empty objects.

    Where the canonical field is an object, a text or a single-element list that holds one is read as it, and the
    elements of a list go to the members that one of their texts names.
    """
    todo: list[tuple[tuple, object]] = [((), {k: v for k, v in rec.items() if k not in ignore})]
    while todo:
        up, value = todo.pop()
        if canon.get(up) == "object" and not isinstance(value, dict):
            inner = unwrapped(value)
            if isinstance(inner, list) and len(inner) == 1 and isinstance(inner[0], dict) and not _member(up, inner[0], canon):
                inner = inner[0]
            elif isinstance(inner, list) and inner and all(isinstance(x, dict) for x in inner):
                named = {_member(up, x, canon): x for x in inner}
                if len(named) == len(inner) and None not in named:
                    inner = named
            value = inner if isinstance(inner, dict) else value
        if not isinstance(value, dict) or (up and not value):
            yield up, value
            continue
        taken = {up + (k,) for k in value}
        for k, v in value.items():
            at = up + (k,)
            if at not in canon:
                for c in aliases.get((len(at), k), ()):
                    if up + (c,) in canon and up + (c,) not in taken:
                        at = up + (c,)
                        taken.add(at)
                        break
            todo.append((at, v))


def _member(up: tuple, element: dict, canon: Schema) -> str | None:
    """The member object of ``up`` that a text of the element names."""
    return next((v for v in element.values() if isinstance(v, str) and canon.get(up + (v,)) == "object"), None)


SQL_TYPE = {"text": "string", "whole number": "bigint", "decimal number": "double", "truth value": "boolean"}
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_READ = re.compile(rf"\s*({_NUMBER})\s*(?:(%)|/\s*({_NUMBER}))?\s*", re.A)


def read_number(value: object) -> tuple[int | float | None, str]:
    """The number a value holds, and its form: '' (a plain number), '%' or '/'. None for what is none."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value, ""
    m = _READ.fullmatch(value) if isinstance(value, str) and len(value) < 400 else None
    if not m:
        return None, ""
    number, percent, below = m.groups()
    try:
        if percent:
            return float(Decimal(number) / 100), "%"
        if below:
            return (float(Fraction(number) / Fraction(below)), "/") if Fraction(below) else (None, "")
        return (int(number), "") if number.lstrip("+-").isdigit() else (float(number), "")
    except (ArithmeticError, ValueError):
        return None, ""


def _single(value: object) -> object:
    """The element of a list that holds one value, also as text."""
    inner = unwrapped(value)
    return inner[0] if isinstance(inner, list) and len(inner) == 1 and not isinstance(inner[0], (dict, list)) else value


def form_of(value: object) -> str:
    """The kind of a value as it decides the type of a column; numbers written with a sign of their own are 'share'."""
    value = _single(value)
    number, sign = read_number(value)
    if number is None:
        return kind_of(value)
    if sign:
        return "share"
    whole = isinstance(number, int) or (math.isfinite(number) and number == int(number))
    return "whole number" if whole else "decimal number"


def column_kind(forms: dict[str, int]) -> str:
    """The kind of a field's column: numbers, text or truth values, whichever most values are; '' if it has only members."""
    numbers = sum(forms.get(k, 0) for k in ("whole number", "decimal number", "share"))
    n, kind = max((numbers, "number"), (forms.get("text", 0), "text"), (forms.get("truth value", 0), "truth value"))
    if not n:
        return "text" if "array" in forms or set(forms) == {""} else ""
    if kind != "number":
        return kind
    return "decimal number" if "decimal number" in forms or "whole number" not in forms else "whole number"


def cast_value(value: object, kind: str) -> tuple[object, bool]:
    """The value as ``kind``, None where it does not fit, and whether that says all the value said."""
    value = _single(value)
    if kind == "text":
        if isinstance(value, str):
            return value, True
        return json.dumps(value, ensure_ascii=False), True
    if kind == "truth value":
        if isinstance(value, bool):
            return value, True
        known = {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None
        return known, known is not None
    number, sign = read_number(value)
    if number is None:
        return None, False
    try:
        if kind == "decimal number":
            return float(number), sign != "/" and (isinstance(number, float) or int(float(number)) == number)
        if number != int(number) or not -(2**63) <= number < 2**63:
            return None, False
        return int(number), sign != "/"
    except (OverflowError, ValueError):
        return None, False


def column_names(paths: Sequence[tuple], taken: Sequence[str]) -> list[str]:
    """Path names joined by ``_``, told apart by a number where that leaves two alike in any case."""
    used, out = {t.lower() for t in taken}, []
    for p in paths:
        name = first = re.sub(r"\W", "_", "_".join(p)) or "_"
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{first}_{n}"
        used.add(name.lower())
        out.append(name)
    return out


def united(
    df: DataFrame,
    id_cols: Sequence[str],
    run: str,
    seq: str,
    record: str,
    targets: Sequence[str],
    ignore: Sequence[str],
    max_fields: int = 10_000,
) -> DataFrame:
    """All readable lines as one table: ``id_cols``, one typed column per canonical field of any file, and ``extras``.

    The values of a line are found under the canonical name of each member and read as the type that most values of the
    field have: numbers also from text, percent, fractions and lists of one value. ``extras`` maps the dotted path (dots in names as ``\\.``) to
    the JSON of every value that does not fit its column, and of fractions, whose parts a number does not keep.
    More than ``max_fields`` fields are an error.
    """
    files = cut(file_fields(df, record, [run, seq], ignore), "file-fields")
    canon = prevailing_schema(files, targets, max_fields=max_fields)
    aliases = other_names(files, canon, max_fields)
    skip = frozenset(ignore)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["r"]:
                rec = read_json(text)
                if isinstance(rec, dict):
                    seen.update(("\u0001".join(p), form_of(v)) for p, v in canonical_values(rec, canon, aliases, skip))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "form", "n"])

    counted = df.select(F.col(record).cast("string").alias("r")).mapInPandas(forms, "path string, form string, n long")
    found: dict[tuple, dict[str, int]] = {}
    for r in _bounded(counted.groupBy("path", "form").agg(F.sum("n").alias("n")), 7 * max_fields):
        if r["path"] or r["form"] != "object":
            found.setdefault(tuple(r["path"].split("\u0001")), {})[r["form"]] = r["n"]
    if len(found) > max_fields:
        raise ValueError(f"more than {max_fields} fields: these names are data")
    # prevailing fields come first and take the plain names
    within = {p[:k] for p in found for k in range(len(p))}
    order = sorted((p for p in found if set(found[p]) != {""} or p not in within), key=lambda p: (p not in canon, p))
    kinds = {p: k for p in order if (k := column_kind(found[p]))}
    ids = [f"i{k}" for k in range(len(id_cols))]
    names = dict(zip(kinds, column_names(list(kinds), [*id_cols, "extras"]), strict=True))
    inner = {p: f"c{k}" for k, p in enumerate(kinds)}

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, rows, extras = [], [], []
            for k, text in enumerate(batch["r"]):
                rec = read_json(text)
                if not isinstance(rec, dict):
                    continue
                row, extra = {}, {}
                for p, v in canonical_values(rec, canon, aliases, skip):
                    if v is None:
                        continue
                    cast, whole = cast_value(v, kinds[p]) if p in kinds else (None, False)
                    if p in inner:
                        row[inner[p]] = cast
                    if not whole and v != {}:
                        extra[".".join(k.replace(".", r"\.") for k in p)] = json.dumps(v, ensure_ascii=False)
                kept.append(k)
                rows.append(row)
                extras.append(extra)
            out = batch.iloc[kept][ids].reset_index(drop=True)
            cols = {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in inner.values()}
            yield pd.concat([out, pd.DataFrame(cols), pd.DataFrame({"extras": pd.Series(extras, dtype=object)})], axis=1)

    types = [f"{i} {df.schema[c].dataType.simpleString()}" for i, c in zip(ids, id_cols, strict=True)]
    types += [f"{inner[p]} {SQL_TYPE[k]}" for p, k in kinds.items()]
    lines = df.select(*[F.col(c).alias(i) for c, i in zip(id_cols, ids, strict=True)], F.col(record).cast("string").alias("r"))
    flat = lines.mapInPandas(values, ", ".join([*types, "extras map<string,string>"]))
    return flat.select(
        *[F.col(i).alias(c) for c, i in zip(id_cols, ids, strict=True)],
        *[F.col(inner[p]).alias(names[p]) for p in kinds],
        "extras",
    )
