"""Numbers and verdicts in free text, as JVM column expressions.

Patterns and tolerances are those of the task: a thousands separator splits a number, the last number of a text counts,
and signs are read greedily.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and bounds of the task
NUMBER_ONLY = r"^[+-]?([0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)$"
NUMBER_IN_TEXT = r"[+-]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)"
NUMBER_WITH_EXPONENT = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
WHOLE_FLOAT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
EXACT_INT = float(2**53)
TOLERANCE = 1e-9
HIGH_CONFIDENCE = 0.8
AROUND = "*`\"'"
OPERATION_PROMPT = "What is the result of %s? Give only the result."
VERDICT = r"(?i)<verdict>\s*(keep|discard)\s*</verdict>"
CONFIDENCE = r"(?i)<confidence>\s*(high|medium|low|[0-9]+(?:\.[0-9]+)?)\s*</confidence>"
FIXED_SOLUTION = r"(?i)<solution>\s*([^\s<]+)\s*</solution>"
SCORE = r"(?i)<score>\s*([01](?:\.[0-9]+)?|0?\.[0-9]+)\s*</score>"
SCORE_WORDS = {"yes": 1.0, "correct": 1.0, "true": 1.0, "no": 0.0, "incorrect": 0.0, "false": 0.0}
EXAMPLE = r"(?is)<example>\s*operation:\s*(.+?)\s*solution:\s*(.+?)\s*</example>"
LINE_PAIR = (
    r"^\s*(?:[-*]|[0-9]+[.)])?\s*(.+?)\s*(?:=|,|->|=>)\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
)
LINE_HEADERS = ("operation", "expression", "expr")

_SPACE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def strip(c: Column) -> Column:
    """The text without white space around it, of any script."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def double(c: Column, pattern: str = WHOLE_FLOAT) -> Column:
    """A double, null unless the whole text is a number: a bare cast would take '42d'."""
    return F.when(c.rlike(pattern), c.try_cast("double"))


def escape_newlines(c: Column) -> Column:
    r"""CRLF, CR and LF as the two characters ``\n``."""
    s = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    s = F.replace(s, F.lit("\r"), F.lit("\n"))
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


def unescape_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))


def is_number_only(c: Column) -> Column:
    """Whole text a plain finite number, without exponent."""
    return F.coalesce(strip(c).rlike(NUMBER_ONLY), F.lit(False))


def is_completed(c: Column) -> Column:
    """Something but blanks is left after unescaping line breaks."""
    return F.coalesce(F.length(strip(unescape_newlines(c))) > 0, F.lit(False))


def last_number(c: Column, pattern: str = NUMBER_IN_TEXT) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def _unmarked(c: Column) -> Column:
    """Without markup and quotes around the whole; those inside stay."""
    return strip(F.regexp_replace(strip(c), rf"^[{AROUND}]+|[{AROUND}]+$", ""))


def to_number_only(c: Column) -> Column:
    """Canonical text of a bare number, also within markup or quotes; else of the last number of the text; else null."""
    bare = strip(unescape_newlines(c))
    inner = _unmarked(bare)
    found = F.when(bare.rlike(NUMBER_ONLY), bare).when(inner.rlike(NUMBER_ONLY), inner).otherwise(last_number(bare))
    return canonical_number(found)


def numeric_answer(c: Column) -> Column:
    """The value of an answer: the whole text as number (markup around it and one trailing dot allowed), else its last number."""
    text = strip(unescape_newlines(c))
    bare = _unmarked(text)
    dots = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
    body = F.when(bare.endswith(".") & (dots == 1), strip(F.rtrim(bare, F.lit(".")))).otherwise(bare)
    return F.coalesce(double(body), double(last_number(text, NUMBER_WITH_EXPONENT)))


def whole_text(v: Column) -> Column:
    """A whole double as integer text."""
    return v.cast("decimal(20,0)").cast("string")


def canonical_number(c: Column) -> Column:
    """Exactly whole numbers as integer text, else the text without a leading plus."""
    v = double(strip(c))
    plain = F.regexp_replace(strip(c), r"^\++", "")
    return F.when((v == F.floor(v)) & (F.abs(v) <= EXACT_INT), whole_text(v)).otherwise(plain)


def canonical_solution(c: Column) -> Column:
    """Nearly whole numbers up to 2**53 as integer text, else the trimmed text without a leading plus."""
    plain = F.regexp_replace(strip(c), r"^\++", "")
    v = double(plain)
    near = F.rint(v)
    whole = (F.abs(v - near) <= TOLERANCE) & (F.abs(v) <= EXACT_INT)
    return F.when(whole, whole_text(near)).otherwise(plain)


def numbers_equal(a: Column, b: Column) -> Column:
    """Finite and equal absolutely, as nearest integers, or relatively, each within 1e-9."""
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    gap = F.abs(a - b)
    near = lambda x: (F.abs(x - F.rint(x)) <= TOLERANCE) & (F.abs(x) <= EXACT_INT)
    ints = near(a) & near(b) & (F.rint(a) == F.rint(b))
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.coalesce(finite & ((gap <= TOLERANCE) | ints | (gap <= TOLERANCE * scale)), F.lit(False))


def solutions_match(a: Column, b: Column) -> Column:
    """Equal as numbers; texts without a number must be equal."""
    x, y = numeric_answer(a), numeric_answer(b)
    return F.when(x.isNull() | y.isNull(), strip(a) == strip(b)).otherwise(numbers_equal(x, y))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(F.length(x) > 0, x)


def verdict(c: Column, fallback: Column | None = None) -> Column:
    """struct(keep, confidence, solution): defaults are discard, low and the fallback, if that is not empty."""
    sol = canonical_solution(_found(c, FIXED_SOLUTION))
    if fallback is not None:
        sol = F.coalesce(sol, F.nullif(fallback, F.lit("")))
    return F.struct(
        F.coalesce(F.lower(_found(c, VERDICT)) == "keep", F.lit(False)).alias("keep"),
        F.coalesce(F.lower(_found(c, CONFIDENCE)), F.lit("low")).alias("confidence"),
        sol.alias("solution"),
    )


def confidence_is_high(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.coalesce((s == "high") | (double(s) >= HIGH_CONFIDENCE), F.lit(False))


def judge_score(c: Column) -> Column:
    """Tagged score, at most 1; else what the last word for right or wrong says; else 0."""
    tag = double(_found(c, SCORE))
    score = F.when(tag.isNotNull(), F.least(F.lit(1.0), tag))
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    last = F.try_element_at(F.filter(words, lambda w: w.isin(*SCORE_WORDS)), F.lit(-1))
    good = last.isin(*[w for w, v in SCORE_WORDS.items() if v])
    return F.coalesce(score, F.when(good, 1.0), F.lit(0.0))


def judge_reward(score: Column, well_formed: Column, coefficient: float = 0.1) -> Column:
    """Answer score minus the format penalty."""
    return F.lit(coefficient) * (well_formed.cast("double") - 1.0) + score


def text_key(c: Column) -> Column:
    """Key of a text that is no operation: lower case without white space."""
    return F.lower(F.regexp_replace(c, r"\s", ""))


def commutative_pair_key(left: Column, op: str, right: Column) -> Column:
    """Key of ``left op right`` whose operands are ordered as texts."""
    a, b = left.cast("string"), right.cast("string")
    return F.concat(F.least(a, b), F.lit(f"|{op}|"), F.greatest(a, b))


def operation_prompt(operation: Column) -> Column:
    return F.format_string(OPERATION_PROMPT, operation)


def judge_prompt(operation: Column, answer: Column) -> Column:
    """The question put to a judge of an answer; it is given no solution."""
    # fixed values: the wording of the task
    head = F.lit(
        "You are grading a model's answer to an arithmetic problem.\n"
        "Solve the problem yourself, then decide whether the model's answer is correct.\n"
        "You are not given a reference answer — verify the result independently.\n"
        "Ignore minor formatting differences (whitespace, trailing zeros, signs like +42).\n"
        "If the model output contains reasoning, grade only the final numeric result.\n"
    )
    tail = F.lit(
        "\nRespond with <score>1</score> if the answer is correct, or <score>0</score> if incorrect.\n"
        "Do not wrap any other text inside the score tags."
    )
    asked = F.concat(F.lit("Problem prompt: "), operation_prompt(operation))
    return F.concat_ws("\n", head, asked, F.concat(F.lit("Expression: "), operation), F.concat(F.lit("Model answer: "), answer), tail)


def age_label(at: Column, now: Column) -> Column:
    """How long before ``now``, in the largest fitting unit below a day; then the time itself. Null times give ''."""
    gone = F.rint(now.cast("double") - at.cast("double"))
    s = F.when(gone < 0, 0.0).otherwise(gone)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    ago = F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago"))
    return F.coalesce(ago, F.date_format(at, "yyyy-MM-dd HH:mm:ss'Z'"), F.lit(""))


def band(value: Column, half: Column) -> Column:
    """struct(low, high) of a share with its half width, inside [0, 1]."""
    h = F.coalesce(half, F.lit(0.0))
    return F.struct(F.greatest(value - h, F.lit(0.0)).alias("low"), F.least(value + h, F.lit(1.0)).alias("high"))


# --- one text, many rows -------------------------------------------------------------------------------------------

def line_pairs(c: Column) -> Column:
    """array<struct(operation, solution)> from lines like ``- 1+2 = 3`` that end with a number; header lines are skipped."""
    lines = F.split(c, r"\R|[\x{1C}-\x{1E}]")
    pairs = F.transform(
        lines,
        lambda t: F.struct(
            strip(F.regexp_extract(t, LINE_PAIR, 1)).alias("operation"), canonical_solution(F.regexp_extract(t, LINE_PAIR, 2)).alias("solution")
        ),
    )
    return F.filter(pairs, lambda p: (p["solution"] != "") & ~F.lower(p["operation"]).isin(*LINE_HEADERS))


def tag_pairs(c: Column) -> Column:
    """array<struct(operation, solution)> from ``<example>operation: … solution: …</example>`` blocks."""
    part = lambda k: F.regexp_extract_all(c, F.lit(EXAMPLE), F.lit(k))
    pairs = F.arrays_zip(part(1).alias("operation"), part(2).alias("solution"))
    pairs = F.transform(
        pairs, lambda p: F.struct(strip(p["operation"]).alias("operation"), canonical_solution(p["solution"]).alias("solution"))
    )
    return F.filter(pairs, lambda p: (F.length(p["operation"]) > 0) & (F.length(p["solution"]) > 0))


def json_pairs(c: Column) -> Column:
    """array<struct(operation, solution)> from a JSON array of objects, first '[' to last ']'.

    Elements that are no objects are skipped; falsy values (0, 0.0, false, '') give way to the alternative names.
    """
    body = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    items = F.try_parse_json(body).try_cast("array<variant>")
    value = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda v, name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    def truthy(v: Column, name: str) -> Column:
        k, s = kind(v, name), value(v, name)
        falsy = ((k != "STRING") & (F.lower(s).isin("false") | (double(s) == 0.0))) | (F.length(s) == 0)
        text = F.when(k == "BOOLEAN", F.initcap(s)).otherwise(s)
        return F.when(~F.coalesce(falsy, F.lit(False)), text)

    pairs = F.transform(
        items,
        lambda v: F.struct(
            strip(F.coalesce(truthy(v, "operation"), truthy(v, "expr"))).alias("operation"),
            canonical_solution(F.coalesce(truthy(v, "solution"), truthy(v, "answer"))).alias("solution"),
        ),
    )
    return F.filter(pairs, lambda p: (F.length(p["operation"]) > 0) & (F.length(p["solution"]) > 0))


def generated_pairs(c: Column) -> Column:
    """First strategy that applies: JSON array, example blocks, lines."""
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    c = strip(c)
    return F.when(some(json_pairs(c)), json_pairs(c)).when(c.rlike(EXAMPLE), tag_pairs(c)).otherwise(line_pairs(c))
