"""Keys of arithmetic operations: two operations share a key if they are the same computation step by step.

Spelling and formatting, words around the operation, needless brackets, the writing of equal numbers and the order of
the two operands of ``+`` and ``*`` or of the arguments of gcd, lcm, max and min do not count. Numbers, operators,
functions and every other order do. Nothing is evaluated and nothing re-associated.
"""

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillstone.llm.spelling import _DROPPED, _FROM, _TO

# fixed values: the function names of the task
FUNCTIONS = frozenset(
    "factorial fact comb c perm p gcd lcm abs floor ceil round sqrt isqrt fib digit_sum digit_product reverse_digits "
    "sigma phi totient prime_count nth_prime pow mod max min".split()
)
COMMUTATIVE = frozenset(["gcd", "lcm", "max", "min"])

_MAP = str.maketrans(dict(zip(_FROM, _TO, strict=False)) | {c: None for c in _DROPPED if c not in "_＿"} | {"＿": "_"})
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_GROUPED = re.compile(r"(?<=[0-9])[_\s]+(?=[0-9])")
_TOKEN = re.compile(r"[0-9]+(?:\.[0-9]+)?|\.[0-9]+|[^\W\d_]+(?:_[^\W\d_]+)*|\*\*|//|[-+*/%^!(),\[\]{}]")
_PREC = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "neg": 3, "^": 4}
#: Longer keys of inner nodes are replaced by their digest, so that long operations cost linear time.
_LONG = 256


def _number(text: str) -> str:
    whole, _, part = text.partition(".")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    return f"{whole}.{part}" if part else whole


def _short(key: str) -> str:
    return key if len(key) <= _LONG else "#" + hashlib.md5(key.encode("utf-8", "surrogatepass")).hexdigest()


def tokens(text: str) -> list[str]:
    """Numbers, function names, operators, brackets and separators; words and other marks are left out."""
    s = _INVISIBLE.sub("", text).translate(_MAP).lower()
    s = _GROUPED.sub("", s)
    raw = _TOKEN.findall(s)
    out: list[str] = []
    calls: list[bool] = []
    i, n = 0, len(raw)
    while i < n:
        t = raw[i]
        if t[0].isalpha():
            if t in FUNCTIONS and i + 1 < n and raw[i + 1] in "([{":
                out.append(t)
        elif t in "([{":
            calls.append(bool(out) and out[-1] in FUNCTIONS)
            out.append("(")
        elif t in ")]}":
            if calls:
                calls.pop()
            out.append(")")
        elif t == "," and not (calls and calls[-1]):
            if out and out[-1].isdigit() and i + 1 < n and re.fullmatch(r"[0-9]{3}(\.[0-9]+)?", raw[i + 1]):
                out[-1] += raw[i + 1]
                i += 1
        elif t == "**":
            out.append("^")
        else:
            out.append(t)
        i += 1
    while out and out[0] in ("*", "^", "/", "%", ",", "!", "//"):
        out.pop(0)
    while out and out[-1] in ("*", "^", "/", "%", ",", "+", "-", "//"):
        out.pop()
    return out


def tree_key(toks: list[str]) -> str | None:
    """The key of the operation's tree; None if the tokens are no operation."""
    values: list[str] = []
    ops: list[tuple[str, int]] = []  # operator, number of arguments so far of a call

    def reduce() -> None:
        op, _ = ops.pop()
        if op == "neg":
            values.append(_short(f"(neg {values.pop()})"))
            return
        b, a = values.pop(), values.pop()
        if op in ("+", "*") and b < a:
            a, b = b, a
        values.append(_short(f"({a}{op}{b})"))

    operand = True  # an operand is due
    try:
        for i, t in enumerate(toks):
            if operand:
                if t[0].isdigit() or t[0] == ".":
                    values.append(_number(t))
                    operand = False
                elif t in FUNCTIONS:
                    if toks[i + 1] != "(":
                        return None
                    ops.append((t, 0))
                elif t == "(":
                    ops.append(("(", len(values)))
                elif t == "-":
                    ops.append(("neg", 0))
                elif t == "+":
                    continue
                else:
                    return None
            elif t == "!":
                values.append(_short(f"({values.pop()}!)"))
            elif t in (")", ","):
                while ops and ops[-1][0] != "(":
                    reduce()
                if not ops:
                    return None
                start = ops[-1][1]
                if t == ",":
                    if len(ops) < 2 or ops[-2][0] not in FUNCTIONS:
                        return None
                    operand = True
                    continue
                ops.pop()
                args = values[start:]
                if ops and ops[-1][0] in FUNCTIONS:
                    name, _ = ops.pop()
                    del values[start:]
                    if name in COMMUTATIVE:
                        args.sort()
                    values.append(_short(f"{name}({','.join(args)})"))
                elif len(args) != 1:
                    return None
            elif t in _PREC:
                right = t == "^"
                while ops and ops[-1][0] in _PREC and (
                    _PREC[ops[-1][0]] > _PREC[t] or (_PREC[ops[-1][0]] == _PREC[t] and not right)
                ):
                    reduce()
                ops.append((t, 0))
                operand = True
            else:
                return None
        if operand:
            return None
        while ops:
            if ops[-1][0] == "(" or ops[-1][0] in FUNCTIONS:
                return None
            reduce()
    except IndexError:
        return None
    return values[0] if len(values) == 1 else None


def operation_keys(text: object) -> tuple[str | None, str | None]:
    """(tree key, text key) of an operation; None where there is none. Blank texts have neither."""
    if not isinstance(text, str):
        return None, None
    toks = tokens(text)
    if not any(t[0].isdigit() or t[0] == "." or t in FUNCTIONS for t in toks):
        rest = "".join(c for c in unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower() if c.isalnum())
        return None, ("w" + rest if rest else None)
    flat = "t" + "".join(toks)
    tree = tree_key(toks)
    return ("o" + tree if tree is not None else None), flat


#: Characters of a sort key that carry its order; a digest behind them tells longer ones apart.
HEAD = 32
SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")


def _sorted_as(kind: str, text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return f"{kind}{text[:HEAD].encode('utf-8', 'replace').decode()}|{hashlib.md5(raw).hexdigest()}"


def record_keys(text: object) -> tuple[list[str], list[int] | None]:
    """(sort keys, shingles) of a text: ordered by tree and by spelling; without an operation forwards and backwards.

    Shingles are hashes of five words each, only for texts that are no operation and have at least five words.
    """
    tree, flat = operation_keys(text)
    if flat is None:
        return [], None
    if not flat.startswith("w"):
        return [_sorted_as(k[0], k[1:]) for k in (tree, flat) if k is not None], None
    words = [w for w in _WORD.findall(unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower())]
    grams = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    hashes = [int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for g in grams]
    return [_sorted_as("v", flat[:0:-1]), _sorted_as("w", flat[1:])], sorted(hashes) or None


_KEYS = StructType([StructField("keys", ArrayType(StringType())), StructField("grams", ArrayType(LongType()))])


@F.pandas_udf(_KEYS)
def _keys_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([record_keys(t) for t in batch], columns=["keys", "grams"])


def sort_keys(c: Column) -> Column:
    """struct(keys, grams): the sort keys of a text, which agree only if they stand for the same, and its shingles."""
    return _keys_udf.asNondeterministic()(c.cast("string"))
