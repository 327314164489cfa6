"""Problem 6: broken prompt and response pairs.

Responses are masked: the question, in whatever formatting, becomes one sign, other numbers another. Checks on the single
pair find empty responses, copies (the question again and no value) and foreign sentences. What remains without a value
is either cut off or a refusal, and that is read from the templates of all responses:

* A response whose words begin a template that goes on to a value in other pairs was cut off.
* Openings (the first 12 words; for short responses the whole) are clustered by MinHash over five-word shingles; candidates
  of one band are verified at a similarity of 0.8, and verified links are followed to connected components. A template
  recurs if it has a shingle of ended templates that comes with at least two different computations (counted
  exactly). Templates that recur over different questions decline or evade, and so do the ended ones in the cluster of
  such a one.
* All others break off without giving a value, also such as were said once only, and are cut off.

Defined cases: null outputs, and such as hold no letter or digit, are empty. A null question matches nothing. A bare
number as question is its own value. Rows written twice are judged twice, alike. Every output is read whole. Empty tables
give empty results; other columns are never read.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillstone.llm.opkey import FUNCTIONS, operation_keys, tokens
from quillstone.operators.skew import join_to_groups
from quillstone.session import cut

SHINGLE, SIMILARITY = 5, 0.8
OPENING = 12
#: Rows a band: unlike openings seldom meet, pairs at 0.8 meet in one of the bands with a probability of 0.9998.
BANDS, ROWS = 16, 4

# fixed values: common English words of questions, explanations and refusals
ENGLISH = frozenset(
    """a about above add after again all along also am an and answer any apart are arrive as asked aside at be because
    before both brackets but by calculate can cannot check combine come comes compute consult could decline did do does
    done down each either else end equal equals evaluate exact expression final find first follow for from function get
    give gives go got had has have help hence here higher hope how however i if in inner inside into is it its just know
    lack last leave leaves left let like long made make may me method model more must my need needed next no not note
    nothing now number of off offer ok on one only operation or order other our out outside over part parts piece please
    problem question rather remains request rest result right same see should signs simple simply since so some sorry
    split start stays step sum take tell term terms than that the them then there these they this those three through
    to together too tools total tricks true try two understand until up use value we were what when where which while
    will with work would write yes you your""".split()
)
# fixed values: words that only put a question
FRAMING = frozenset(
    """a again answer asked calculate calculated can comes compute computed could determine equation evaluate evaluated
    exercise expression figure find following for give given here how i in input is it me much of operation out please
    prompt problem query question read reads requested result rewritten solve task tell that the this to value wanted
    was what with words work would you your""".split()
)
TAILS = frozenset("comes equals is please to what".split())
_NEEDS_QUESTION = re.compile(r"(?:expression|evaluate|evaluating|of|solve|computing|calculate|compute)\s*$", re.I)
_ENDING = re.compile(r"(?:ing|ly|ness|ful|tion|sion|ment|ould|ght|ish|ook|able|ible)$|(?:'s|n't|'ll|'d|'m|'ve|'re)$")
_PIECES = {piece for name in FUNCTIONS for piece in name.split("_")}
_NAMES = "|".join(sorted(FUNCTIONS, key=len, reverse=True))
_CHUNK = re.compile(
    rf"(?:(?<![^\W\d_])(?:{_NAMES})(?=\s*[(（])|[0-9.,;_+\-*/^%!()\[\]{{}}×÷⋅∗·−–∕＋－＾（）！，；]|[^\S\n])+", re.I
)
_SPAN = re.compile(rf"[+\-−–(\[{{]*(?:(?:{_NAMES})\s*[(（]|\.?[0-9]).*[0-9)\]}}）!！]|[+\-−–]?[0-9]", re.I | re.S)
_LABEL = re.compile(r"(?:step|part|line|note|no\.?|question|task)\s*$", re.I)
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SHAPE = re.compile(r"[\u0002-\u0004]|[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?。！？]['\"”’)»*`\s]*$")
QUESTION, NUMBER, OTHER = SIGNS = ("\u0002", "\u0003", "\u0004")


def mask(question: str, text: str) -> tuple[str, bool]:
    """``text`` with the question, numbers and other operations replaced by signs; whether the question is a bare number."""
    tree, flat, bare = _operation(question)
    ended = bool(_END.search(text))
    out, at = [], 0
    for chunk in _CHUNK.finditer(text):
        m = _SPAN.search(chunk.group())
        if not m:
            continue
        start, stop = chunk.start() + m.start(), chunk.start() + m.end()
        t2, f2, number = _operation(m.group())
        same = bool((t2 and t2 == tree) or (f2 and f2 == flat))
        cut_off = re.match(r"\s*[+\-*/^%×÷⋅∗−(]", text[stop:]) and not re.match(r"\s*[*(]*\s*(?:[^\W\d]|$)", text[stop:])
        if same or (not number and flat and f2 and _same_bag(flat, f2)):
            sign = QUESTION
        elif not number or cut_off or _LABEL.search(text[:start]):
            sign = OTHER
        elif stop >= len(text.rstrip()) and not ended and f2 and flat and flat.startswith(f2) and _NEEDS_QUESTION.search(text[:start]):
            sign = OTHER
        else:
            sign = NUMBER
        out += [text[at:start], f" {sign} "]
        at = stop
    out.append(text[at:])
    return "".join(out), bare


def _parsed(text: str) -> tuple[str | None, str | None, bool]:
    """Tree key and text key of an operation, and whether it is a bare number."""
    toks = tokens(text)
    number = sum(t[0].isdigit() or t[0] == "." for t in toks) == 1 and all(t in "+-()" or t[0] in "0123456789." for t in toks)
    return *operation_keys(text), number


_parsed_before = lru_cache(1 << 16)(_parsed)


def _operation(text: str) -> tuple[str | None, str | None, bool]:
    """``_parsed``; questions and values come again and again, so short ones are parsed once while they are remembered."""
    return _parsed_before(text) if len(text) <= 200 else _parsed(text)


def _same_bag(a: str, b: str) -> bool:
    parts = lambda s: sorted(re.findall(r"[0-9]+(?:\.[0-9]+)?|[a-z_]+", s[1:]))
    return parts(a) == parts(b)


def foreign(words: list[str]) -> bool:
    """Whether the words are a sentence in another language than English: at most half of them look English."""
    if not words:
        return False
    if sum(ord(c) > 0x24F and c.isalpha() for w in words if not w.isascii() for c in w) > 1:
        return True
    known = sum(w in ENGLISH or (len(w) > 2 and w.isascii() and bool(_ENDING.search(w))) for w in words)
    return 2 * known <= len(words)


def read_pair(question: str | None, output: str | None) -> tuple[str, list[str], bool]:
    """(class, template words, whether the text ends its sentence); class is a defect, 'value', 'bare' or 'open'.

    'bare': the only number is the question, which is a bare number.
    """
    text = _INVISIBLE.sub("", (output or "").replace("\\n", "\n"))
    if not any(c.isalnum() for c in text):
        return "empty", [], False
    masked, bare = mask(question or "", text)
    shape = [t.lower().replace("’", "'") for t in _SHAPE.findall(masked)]
    end = len(shape)
    if OTHER in shape:
        # letters behind a cut operation are the beginning of a function's name
        last = len(shape) - 1 - shape[::-1].index(OTHER)
        if all(any(p.startswith(w) for p in _PIECES) for w in shape[last + 1 :]):
            end = last + 1
    latin = [w for w in shape[:end] if w not in SIGNS and w not in FUNCTIONS]
    ended = bool(_END.search(text))
    if foreign(latin) and (NUMBER in shape or (bare and QUESTION in shape) or len(latin) > 2):
        return "language", shape, ended
    if NUMBER in shape:
        return "value", shape, ended
    if QUESTION in shape:
        last = len(shape) - 1 - shape[::-1].index(QUESTION)
        head = [w for w in shape[:last] if w not in SIGNS]
        if set(head) <= FRAMING and set(shape[last + 1 :]) <= TAILS and shape[0] != "to" and not (
            shape[-1] == "is" and "what" not in shape
        ):
            return ("value" if bare else "copy"), shape, ended
        if bare:
            return "bare", shape, ended
    return "open", shape, ended


def _bands(words: list[str]) -> list[str]:
    """MinHash bands of the five-word shingles of an opening."""
    grams = shingles(words[:OPENING])
    sig = []
    for k in range(BANDS * ROWS):
        sig.append(min(hashlib.blake2b(f"{k}:{g}".encode(), digest_size=8).hexdigest() for g in grams))
    return ["/".join([str(b), *sig[b * ROWS : (b + 1) * ROWS]]) for b in range(BANDS)]


def shingles(words: list[str]) -> list[str]:
    if len(words) <= SHINGLE:
        return [" ".join(words)]
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def _jaccard(a: str, b: str) -> float:
    x, y = set(shingles(a.split(" ")[:OPENING])), set(shingles(b.split(" ")[:OPENING]))
    return len(x & y) / len(x | y)


def set_keys(opening: str) -> list[tuple[str, bool]]:
    """Key of an opening's set of shingles (True), and those of the sets with one shingle less that are alike (False).

    An opening has at most eight shingles, so two are alike at 0.8 only if their sets are equal or one has one more.
    """
    grams = shingles(opening.split(" ")[:OPENING])
    key = lambda gs: hashlib.md5("/".join(gs).encode("utf-8", "surrogatepass")).hexdigest()
    n = len(grams)
    less = [(key(grams[:i] + grams[i + 1 :]), False) for i in range(n)] if n > 1 and n - 1 >= SIMILARITY * n else []
    return [(key(grams), True), *less]


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) for a table of distinct openings: connected components of verified MinHash links.

    A band bucket links each member to its smallest member, so that n openings give n - 1 candidates. Members unlike it are
    linked to all openings alike by the equality of their sets of shingles, so no alike pair of a bucket stays apart.
    """

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, b) for o in batch["opening"] for b in _bands(o.split(" "))]
            yield pd.DataFrame(rows, columns=["opening", "band"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(alike=[_jaccard(a, b) >= SIMILARITY for a, b in zip(batch["opening"], batch["centre"], strict=True)])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(o, *k) for o in batch["opening"] for k in set_keys(o)], columns=["opening", "key", "whole"])

    each = cut(openings.select("opening").mapInPandas(bands, "opening string, band string"), "bands")
    centre = cut(each.groupBy("band").agg(F.min("opening").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    pairs = join_to_groups(each, centre, ["band"], "n").where("opening <> centre").select("opening", "centre").distinct()
    pairs = cut(pairs.mapInPandas(compare, "opening string, centre string, alike boolean"), "compared")
    keys = cut(openings.select("opening").mapInPandas(sets, "opening string, key string, whole boolean"), "opening-sets")
    rest = cut(keys.join(pairs.where("not alike").select("opening").distinct(), "opening", "left_semi"), "unlike-sets")
    # openings of one set are linked to the smallest of them, and a set to the one with a shingle more
    owner = lambda k: k.where("whole").groupBy("key").agg(F.min("opening").alias("centre"))
    links = pairs.where("alike").select("opening", "centre")
    for some, others in ((rest, keys), (keys, rest)):
        # one row a key on one side, and AQE splits a key that many openings share
        links = links.unionByName(some.join(owner(others), "key").select("opening", "centre"))
    # both ways, and each opening to itself
    ways = F.explode(F.array(F.struct("opening", "centre"), F.struct(F.col("centre").alias("opening"), F.col("opening").alias("centre"))))
    own = openings.select("opening", F.col("opening").alias("centre"))
    both = cut(links.select(ways.alias("w")).select("w.*").unionByName(own).distinct(), "links")
    labels = cut(both.groupBy("opening").agg(F.min("centre").alias("cluster")), "opening-clusters")
    while True:
        # the smallest label of a neighbour, until no label changes
        near = both.join(labels.withColumnsRenamed({"opening": "centre", "cluster": "c"}), "centre").groupBy("opening")
        new = near.agg(F.min("c").alias("cluster"), F.min(F.when(F.col("centre") == F.col("opening"), F.col("c"))).alias("had"))
        labels = cut(new.select("opening", "cluster", (F.col("cluster") < F.col("had")).alias("changed")), "opening-clusters")
        if labels.where("changed").isEmpty():
            return labels.select("opening", "cluster")


def defects(df: DataFrame, id_col: str, question_col: str, output_col: str) -> DataFrame:
    """(id, defect) of every defective pair.

    Rows are read twice, to form templates and to give each its verdict; between these all steps have one row a template.
    Every step writes its table, so no plan holds another's joins: plans of many joins are what fills the driver's memory.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, q, o in zip(batch["id"], batch["q"], batch["o"], strict=True):
                q = q if isinstance(q, str) else None
                kind, words, ended = read_pair(q, o if isinstance(o, str) else None)
                asked = (_operation(q or "")[0] or q) if kind in ("open", "bare") else q
                out.append((i, kind, *hash_of(asked), " ".join(words), ended))
            yield pd.DataFrame(out, columns=["id", "kind", "q1", "q2", "words", "ended"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("id"), F.col(question_col).cast("string").alias("q"), F.col(output_col).cast("string").alias("o")
    ).mapInPandas(features, f"id {kind}, kind string, q1 long, q2 long, words string, ended boolean")
    rows = cut(rows, "pairs")
    done = rows.where("kind not in ('value', 'open', 'bare')").select("id", F.col("kind").alias("defect"))

    # one row a template and kind; the least and greatest digest of its questions differ if it came with two of them
    least, most = ("q1_least", "q2_least"), ("q1_most", "q2_most")
    asked = [*(F.min(c[:2]).alias(c) for c in least), *(F.max(c[:2]).alias(c) for c in most)]
    shapes = rows.where("kind in ('value', 'open', 'bare')").groupBy("words", "kind")
    shapes = cut(shapes.agg(F.max("ended").alias("ended"), F.count("*").alias("n"), *asked), "shapes")

    # continuations of the templates that give a value: digest of the stem and the next word
    valued = shapes.where("kind = 'value'").select("words")

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for t in batch["words"]:
                w = t.split(" ")
                w = w[: w.index(NUMBER)] if NUMBER in w else w
                seen.update(zip(stems_of(w), w, strict=False))
            yield pd.DataFrame(sorted(seen), columns=["stem", "next"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["words"]:
                # a text without words has no last one
                w = t.split(" ") if t else []
                *_, stem = stems_of(w[:-1])
                *_, key = stems_of(w)
                out.append((key, " ".join(w[:OPENING]), stem, w[-1] if w else ""))
            new = pd.DataFrame(out, columns=["key", "opening", "stem", "last"], index=batch.index)
            yield pd.concat([batch, new], axis=1)

    # a bare number in the place of a value is its own answer, if no other response has a value there
    own = shapes.where("kind = 'bare'").withColumn("answered", F.regexp_replace("words", f"(?s)^(.*){QUESTION}", f"$1{NUMBER}"))
    own = own.join(valued.withColumnRenamed("words", "answered"), "answered", "left_anti").select(*shapes.columns)
    open_ = shapes.where("kind = 'open'").unionByName(own).groupBy("words").agg(
        F.max("ended").alias("ended"), F.sum("n").alias("n"), F.max(F.col("kind") == "bare").alias("bare"),
        *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most),
    )
    fields = "words string, ended boolean, n long, bare boolean, q1_least long, q2_least long, q1_most long, q2_most long"
    templates = cut(open_.mapInPandas(parts, f"{fields}, key string, opening string, stem string, last string"), "templates")
    goes_on = valued.mapInPandas(stems, "stem string, next string").distinct().withColumn("letter", F.substring("next", 1, 1))
    # a response may be cut within a word: its last one begins the next word of the template
    t, g = templates.alias("t"), goes_on.alias("g")
    same = (F.col("t.stem") == F.col("g.stem")) & (F.substring("t.last", 1, 1) == F.col("g.letter"))
    left = cut(t.join(g, same & F.col("g.next").startswith(F.col("t.last")), "left_anti"), "not-broken")
    clusters = opening_clusters(cut(left.select("opening").distinct(), "openings"))
    gram = F.pandas_udf(_shingle_lists, ArrayType(StringType()))
    grams = cut(left.select("key", "ended", *least, *most, F.explode(gram("words")).alias("g")), "shingles")
    # shingles of ended templates that recur over different questions, counted exactly
    told = [*(F.min(F.when(F.col("ended"), F.col(c))).alias(c) for c in least), *(F.max(F.when(F.col("ended"), F.col(c))).alias(c) for c in most)]
    recurring = grams.groupBy("g").agg(F.count("*").alias("n"), *told).where("q1_least < q1_most or q2_least < q2_most")
    recurring = cut(recurring.select("g", "n"), "recurring-shingles")
    recurs = cut(join_to_groups(grams.select("key", "g"), recurring, ["g"], "n").select("key").distinct(), "recurring")
    of_words = left.select("words", "key", "ended", "opening").join(clusters, "opening")
    of_words = of_words.join(recurs.withColumn("recurs", F.lit(True)), "key", "left").na.fill(False, ["recurs"])
    of_words = cut(of_words.select("words", "ended", "cluster", "recurs"), "judged")
    known = of_words.where("recurs").select("cluster").distinct()
    declines = of_words.where("ended and not recurs").join(known, "cluster", "left_semi").select("words")
    declines = of_words.where("recurs").select("words").unionByName(declines).withColumn("defect", F.lit("refusal"))
    # all other templates break off
    final = templates.select("words", "n", "bare").join(declines, "words", "left").na.fill("truncated", ["defect"])
    final = cut(final, "verdicts")
    rest = join_to_groups(rows.where("kind in ('open', 'bare')").select("id", "kind", "words"), final, ["words"], "n")
    rest = rest.where("kind = 'open' or bare").select("id", "defect")
    return done.unionByName(rest).select(F.col("id").alias(id_col), "defect")


def stems_of(words: list[str]) -> Iterator[str]:
    """Digests of the first 0, 1, 2 … words: equal beginnings meet by equality, at a cost linear in the text."""
    h = hashlib.md5()
    yield h.hexdigest()
    for w in words:
        h.update(w.encode("utf-8", "surrogatepass") + b" ")
        yield h.hexdigest()


def _shingle_lists(words: pd.Series) -> pd.Series:
    return words.map(lambda w: shingles(w.split(" ")))


def hash_of(q: str | None) -> tuple[int, int]:
    """MD5 of a question as two longs."""
    d = hashlib.md5((q or "").encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)
