"""Canonical spelling of an arithmetic text, as a JVM column expression.

Two texts have the same spelling if they differ only in white space and invisible characters, letter case, quotes,
markup or brackets around the whole, introducing and closing marks, digit grouping, a leading plus, or in the sign
chosen for the same operator or separator. Digits, decimal points, minus signs, operators, inner brackets, the places
of separators and the order of operands are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: signs with the same meaning
_SAME = {
    "*": "×⋅∗·✕✖∙⨯",
    "/": "÷∕⁄",
    "-": "−–—‒‑‐﹣⁻",
    "+": "﹢",
    ",": ";、",
    "(": "❨⟮",
    ")": "❩⟯",
}
_WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_QUOTES = "'\"`´‘’‚‛“”„‟«»‹›「」『』′″＇＂｀"
_DROPPED = _QUOTES + "$_\\＄＿＼"


def _tables() -> tuple[str, str]:
    to = {w: n for w, n in _WIDE.items() if w not in _DROPPED}
    for norm, signs in _SAME.items():
        to.update({s: norm for s in signs})
    to[chr(0xFF1B)] = ","
    to[";"] = ","
    src = "".join(to) + _DROPPED
    return src, "".join(to.values())


_FROM, _TO = _tables()
_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{FE00}-\x{FE0F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]+"
_INTRO = r"^(?:->|=>|[=>:|#•◦▪‣·*~→⇒➔,?…]|\.(?![0-9]))+"
_ENCLOSED = r"^[(\[{][\s\S]*[)\]}]$"
_LEADING = r"^(?:[(\[{]|->|=>|[=>:|#•◦▪‣·*~→⇒➔,?…]|\.(?![0-9]))+"
_CLOSE = r"(?:[=?.:,…|#*~>→•。])+$"


def flat(c: Column) -> Column:
    """Characters, case, white space, quotes; null becomes ''."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\\(times|cdot)(?![a-zA-Z])", "*")
    s = F.regexp_replace(s, r"\\div(?![a-zA-Z])", "/")
    s = F.regexp_replace(s, _BLANK, "")
    return F.lower(F.translate(s, _FROM, _TO))


def _outer_layers(s: Column, lead: Column, trail: Column) -> Column:
    """How many pairs of brackets enclose the whole of ``s``, of ``lead`` opening and ``trail`` closing ones."""

    def step(acc: Column, ch: Column) -> Column:
        depth = (
            acc["d"]
            + F.when(ch.isin("(", "[", "{"), 1).otherwise(0)
            - F.when(ch.isin(")", "]", "}"), 1).otherwise(0)
        )
        i = acc["i"] + 1
        low = F.when((i >= acc["a"]) & (i <= acc["b"]), F.least(acc["m"], depth)).otherwise(acc["m"])
        return F.struct(i.alias("i"), depth.alias("d"), low.alias("m"), acc["a"].alias("a"), acc["b"].alias("b"))

    zero = F.lit(0)
    start = F.struct(
        zero.alias("i"), zero.alias("d"), F.least(lead, trail).alias("m"), lead.alias("a"), (F.length(s) - trail).alias("b")
    )
    return F.aggregate(F.split(s, ""), start, step, lambda acc: F.greatest(acc["m"], F.lit(0)))


def barrier(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds computed columns behind a generator, which filters and projections are not merged through.

    Each expression is then evaluated once a row, however often and wherever the new column is used.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.explode_outer(F.array(F.struct(*[e.alias(c) for c, e in columns.items()]))).alias("_made")
    return df.select(*keep, made).select(*keep, *[F.col("_made")[c].alias(c) for c in columns])


def _peeled(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _INTRO, ""), _CLOSE, "")


def _bare(c: Column) -> Column:
    """Brackets around the whole and the marks within them taken off, layer after layer, until nothing changes.

    Every step takes at least one of the brackets that the text begins with, so their number bounds the steps.
    """
    layers = lambda s: F.when(
        s.rlike(_ENCLOSED),
        _outer_layers(s, F.length(F.regexp_extract(s, r"^([(\[{]*)", 1)), F.length(F.regexp_extract(s, r"([)\]}]*)$", 1))),
    ).otherwise(F.lit(0))

    def step(s: Column, _: Column) -> Column:
        # a one-element array binds the number of layers, which is used twice
        inner = F.transform(F.array(layers(s)), lambda k: F.when(k > 0, _peeled(F.substring(s, k + 1, F.length(s) - 2 * k))).otherwise(s))
        return F.when(s.rlike(_ENCLOSED), inner[0]).otherwise(s)

    begins = F.regexp_extract(c, _LEADING, 0)
    most = F.length(F.regexp_replace(begins, r"[^(\[{]", ""))
    return F.when(c.rlike(_ENCLOSED), F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), c, step)).otherwise(c)


def with_spelling(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds, for each new name: source column, the canonical spelling; '' for null, blank and mark-only texts.

    Brackets and marks may alternate around a text however often.
    """
    df = barrier(df, {c: _peeled(flat(F.col(src))) for c, src in columns.items()})
    return barrier(df, {c: _ungrouped(_bare(F.col(c))) for c in columns})


def _ungrouped(s: Column) -> Column:
    """``**`` as ``^``, commas that group digits before the first bracket dropped, a leading plus dropped."""
    s = F.regexp_replace(s, r"\*\*", "^")
    s = F.regexp_replace(s, r"\G([^(\[{,]*?[0-9]),(?=[0-9]{3}(?![0-9]))", "$1")
    return F.regexp_replace(s, r"^\++", "")
