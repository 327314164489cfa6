"""Problem 9: text decoded with a wrong character encoding, found and restored by expectation-maximization.

Wrong decoding is a substitution cipher on bytes: bytes of a true code page were read by another one. Which swaps a source
suffers from is unknown, so for every word with non-ASCII characters the swap is a hidden variable, 'no swap' included.

* Language model: character bigrams of the corpus. At the start only words count that no reading as UTF-8 explains.
* E-step: the posterior of every swap of a word, from the swap's weight in the word's source and the bigram probability of
  the word it would restore.
* M-step: new weights per source, and bigram counts in which words count as what they were restored to. The mapping of a
  swap is that of its code pages and not learned; only the weights and the bigrams are, in a fixed number of rounds.

After the last round every word is decided by its odds against 'no swap'; a document is found if one word is decided well
enough, or several together, or it holds replacement characters of a lossy decoding inside its text. Restoring applies
the swap's code pages to the words decided for it.

The model is a table of bigrams over a folded alphabet (all large scripts count by blocks of 256 characters), whose size
does not grow with the corpus and is checked; the weights have a row per source and swap. All words of all documents are
counted in one pass with map-side sums; only distinct words with non-ASCII characters enter the iterations.

Defined cases: null, empty and blank texts are not found and stay as they are; pure ASCII texts are never found. Rows
with a null source share one set of weights. Repeated texts are judged alike. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut

# fixed values: code pages that readers assume, and those that text is really in
READ_AS = ["cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850"]
TRUE = ["utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850"]
WIDE = ["shift_jis", "euc_jp", "gbk", "euc_kr"]
NONE = "none"
#: Most distinct bigrams of the folded alphabet; more means that the folding does not fit the data.
MAX_BIGRAMS = 2_000_000
MAX_WEIGHTS = 1_000_000
_WORD = re.compile(r"[^ \t\r\n]+")
_SCRAP = "�"


@lru_cache(maxsize=None)
def _writer(page: str) -> dict[str, int]:
    """Character to byte of a code page; bytes without a character stand for the control of the same number."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


def _bytes(word: str, page: str) -> bytes | None:
    table = _writer(page)
    try:
        return bytes([table[c] for c in word])
    except KeyError:
        return None


def _fine(word: str) -> bool:
    return not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") or c == _SCRAP for c in word)


def _decode(raw: bytes, page: str) -> str | None:
    try:
        return raw.decode(page)
    except UnicodeDecodeError:
        return None


def swaps(word: str, pages: tuple[str, ...] | None = None) -> dict[str, str]:
    """Every swap that could have made ``word``, with what it restores; ``pages`` limits the true code pages."""
    out: dict[str, str] = {}
    for page in READ_AS:
        raw = _bytes(word, page)
        if raw is None:
            continue
        for true in pages or (TRUE + WIDE if page == "cp1252" else TRUE):
            if true == page:
                continue
            back = _decode(raw, true)
            if back is None or back == word:
                continue
            if true == "utf-8" and not _fine(back):
                for again in ("cp1252", "mac-roman", "cp437", "cp850", "cp1251", "cp1250"):
                    raw2 = _bytes(back, again)
                    twice = _decode(raw2, "utf-8") if raw2 is not None else None
                    if twice is not None and twice != back and _fine(twice):
                        out[f"{page}<utf-8<{again}<utf-8"] = twice
                continue
            if not _fine(back):
                continue
            out[f"{page}<{true}"] = back
            if true == "utf-8" and not back.isascii():
                for again in ("cp1252", page):
                    raw2 = _bytes(back, again)
                    twice = _decode(raw2, "utf-8") if raw2 is not None else None
                    if twice is not None and twice != back and _fine(twice):
                        out[f"{page}<utf-8<{again}<utf-8"] = twice
    return out


def fold(c: str) -> str:
    """The character in the model's alphabet: digits as one, large scripts by block."""
    o = ord(c)
    if "0" <= c <= "9":
        return "0"
    if o < 0x3200:
        return c
    return chr(0xF0000 + (o >> 8))


def bigrams(word: str) -> list[tuple[str, str]]:
    s = ["^", *map(fold, word), "$"]
    return list(zip(s, s[1:], strict=False))


#: Smoothing in shares of all bigrams, so that it acts alike at every size: letters rarer than this lend no support to
#: each other, else the few garbled texts would look like a language of their own.
SHARE = 3e-4


class Bigrams:
    """Log probabilities of words under smoothed bigram counts."""

    def __init__(self, counts: dict[tuple[str, str], float], share: float = SHARE):
        self.pair = counts
        self.left: dict[str, float] = defaultdict(float)
        self.right: dict[str, float] = defaultdict(float)
        for (a, b), n in counts.items():
            self.left[a] += n
            self.right[b] += n
        self.left, self.right = dict(self.left), dict(self.right)
        self.total = sum(self.right.values()) + 1.0
        self.strength = 1.0 + share * self.total
        self.memo: dict[tuple[str, str], float] = {}

    def log(self, a: str, b: str) -> float:
        key = (a, b)
        v = self.memo.get(key)
        if v is None:
            base = (self.right.get(b, 0.0) + 1e-7 * self.total) / self.total
            v = math.log((self.pair.get(key, 0.0) + self.strength * base) / (self.left.get(a, 0.0) + self.strength))
            if ord(b) >= 0xF0000:
                v -= math.log(256)
            self.memo[key] = v
        return v

    def word(self, word: str) -> float:
        return sum(self.log(a, b) for a, b in bigrams(word))


def posterior(word: str, options: dict[str, str], model: Bigrams, weight: dict[str, float], floor: float) -> dict[str, float]:
    """Log scores of 'none' and every swap of a word."""
    score = {NONE: math.log(weight.get(NONE, 0.9)) + model.word(word)}
    for k, back in options.items():
        score[k] = math.log(max(weight.get(k, 0.0), floor)) + model.word(back)
    return score


def _normal(score: dict[str, float]) -> dict[str, float]:
    top = max(score.values())
    e = {k: math.exp(v - top) for k, v in score.items()}
    z = sum(e.values())
    return {k: v / z for k, v in e.items()}


def words_of(text: str) -> Iterator[re.Match]:
    return _WORD.finditer(text)


FLOOR = 1e-4
#: Log odds against 'none' at which a word, or all such words together, make a document found. Words that are a lone sign or
#: letter without context need more.
ONE, TOGETHER, LONE = 3.5, 5.0, 6.0
#: Log odds at which the distinct words of a document (two at least) that agree on one swap make it found, the swap's prior
#: being counted once for the document.
POOLED = 6.0
#: Log odds within which a document's chief swap wins over others when its text is restored.
NEAR = 8.0


def has_context(word: str) -> bool:
    """Whether a word has letters around a suspicious one to judge it by."""
    letters = sum(c.isalpha() for c in word)
    return letters >= 3 or (letters >= 2 and any(c.isascii() and c.isalpha() for c in word))


class Judge:
    """Decides words and documents by a learned model."""

    def __init__(self, pairs: dict[tuple[str, str], float], weights: dict[str, dict[str, float]]):
        self.model = Bigrams(pairs)
        self.weights = weights
        self.memo: dict[tuple[str, str], tuple[dict[str, float], dict[str, str]]] = {}

    def prior(self, swap: str, source: str) -> float:
        """Log weight of a swap against 'none' in a source."""
        w = self.weights.get(source, {})
        return math.log(max(w.get(swap, 0.0), FLOOR)) - math.log(w.get(NONE, 0.9))

    def word(self, word: str, source: str) -> tuple[dict[str, float], dict[str, str]]:
        """(log odds against 'none' of every swap, what each restores) of a word with non-ASCII characters."""
        key = (word, source)
        hit = self.memo.get(key)
        if hit is None:
            options = swaps(word)
            score = posterior(word, options, self.model, self.weights.get(source, {}), FLOOR)
            none = score.pop(NONE)
            near = {k: v - none for k, v in score.items() if v - none > -NEAR}
            hit = (near, {k: options[k] for k in near})
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = hit
        return hit

    def document(self, text: str | None, source: str) -> tuple[bool, str | None]:
        """(found, restored text) of a document."""
        if not text or text.isascii():
            return False, text
        found, together, per_swap, spots = False, 0.0, defaultdict(float), []
        pooled: dict[str, dict[str, float]] = defaultdict(dict)
        for m in words_of(text):
            w = m.group()
            if w.isascii():
                continue
            odds, back = self.word(w, source)
            best = max(odds, key=lambda k: (odds[k], k), default=None)
            spots.append((m.start(), m.end(), odds, back, best))
            context = has_context(w)
            if context:
                for k, v in odds.items():
                    pooled[k][w] = v
            if best is None or odds[best] <= 0:
                continue
            found |= odds[best] >= (ONE if context else LONE)
            together += odds[best] if context else 0.0
            for k, v in odds.items():
                per_swap[k] += max(0.0, v)
        found |= together >= TOGETHER
        for k, each in pooled.items():
            if not found and len(each) > 1:
                prior = self.prior(k, source)
                found = sum(v - prior for v in each.values()) + prior >= POOLED
        if not found:
            return lost_characters(text), text
        for k, each in pooled.items():
            per_swap[k] = max(per_swap[k], sum(v - self.prior(k, source) for v in each.values()))
        chief = max(per_swap, key=lambda k: (per_swap[k], k), default=NONE)
        garbled = [best is not None and odds[best] > 0 for _, _, odds, _, best in spots]
        out, at = [], 0
        for i, (a, b, odds, back, best) in enumerate(spots):
            # the document's chief swap explains a word as well as its own best one, and words between garbled ones
            beside = any(garbled[max(0, i - 1) : i + 2])
            if chief in odds and (odds[chief] > 0 or beside or has_context(text[a:b])) and odds[chief] > odds[best] - NEAR:
                use = chief
            elif garbled[i]:
                use = best
            else:
                continue
            out += [text[at:a], back[use]]
            at = b
        return True, "".join([*out, text[at:]])


def lost_characters(text: str) -> bool:
    """Replacement characters within or beside words: what a lossy decoding leaves."""
    return bool(re.search(rf"\w{_SCRAP}|{_SCRAP}\w", text))


def _source(s: object) -> str:
    return s if isinstance(s, str) else ""


def learn(df: DataFrame, text_col: str, source_col: str, rounds: int = 3) -> tuple[dict, dict]:
    """(bigram counts, weights per source) after expectation-maximization over all words of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trusted: dict[str, bool] = {}
        for batch in batches:
            pairs: Counter = Counter()
            words: Counter = Counter()
            plain: Counter = Counter()
            for text, source in zip(batch["t"], batch["s"], strict=True):
                if not isinstance(text, str):
                    continue
                for m in words_of(text):
                    w = m.group()
                    if w.isascii():
                        plain[w] += 1
                        continue
                    words[w, _source(source)] += 1
                    ok = trusted.get(w)
                    if ok is None:
                        ok = _SCRAP not in w and not swaps(w, ("utf-8",))
                        if len(trusted) > 200_000:
                            trusted.clear()
                        trusted[w] = ok
                    if ok:
                        plain[w] += 1
            for w, n in plain.items():
                for pair in bigrams(w):
                    pairs[pair] += n
            rows = [("b", a, b, n) for (a, b), n in pairs.items()] + [("w", w, s, n) for (w, s), n in words.items()]
            yield pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("t"), F.col(source_col).cast("string").alias("s")).mapInPandas(
        count, "kind string, a string, b string, n long"
    )
    counted = cut(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "words")
    base = _bounded(counted.where("kind = 'b'").select("a", "b", "n"), MAX_BIGRAMS)
    pairs = {(r["a"], r["b"]): float(r["n"]) for r in base}
    weights: dict[str, dict[str, float]] = {}
    words = counted.where("kind = 'w'").select("a", "b", "n")
    for _ in range(rounds):
        step = _expect(words, pairs, weights)
        sums = step.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        sums = cut(sums, "expected")
        mass: dict[str, dict[str, float]] = defaultdict(dict)
        for r in _bounded(sums.where("kind = 'k'").select("a", "b", "n"), MAX_WEIGHTS):
            mass[r["a"]][r["b"]] = r["n"]
        weights = {s: {k: v / sum(m.values()) for k, v in m.items()} for s, m in mass.items()}
        new = {(r["a"], r["b"]): float(r["n"]) for r in base}
        for r in _bounded(sums.where("kind = 'b'").select("a", "b", "n"), MAX_BIGRAMS):
            new[r["a"], r["b"]] = new.get((r["a"], r["b"]), 0.0) + r["n"]
        pairs = {p: n for p, n in new.items() if n > 1e-6}
    return pairs, weights


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the model has more than {most} rows")
    return rows


def _expect(words: DataFrame, pairs: dict, weights: dict) -> DataFrame:
    """One E-step over the distinct words: expected weights ('k') and corrections of the bigram counts ('b')."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((pairs, weights))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, w = shared.value
        model = Bigrams(p)
        for batch in batches:
            mass: dict[tuple[str, str], float] = defaultdict(float)
            grams: dict[tuple[str, str], float] = defaultdict(float)
            for word, source, n in zip(batch["a"], batch["b"], batch["n"], strict=True):
                options = swaps(word)
                post = _normal(posterior(word, options, model, w.get(source, {}), FLOOR))
                was = _SCRAP not in word and not any("utf-8" in k for k in options)
                for k, v in post.items():
                    mass[source, k] += n * v
                    if v < 1e-3:
                        continue
                    for g in bigrams(word if k == NONE else options[k]):
                        grams[g] += n * v
                if was:
                    for g in bigrams(word):
                        grams[g] -= n
            rows = [("k", s, k, v) for (s, k), v in mass.items()] + [("b", a, b, v) for (a, b), v in grams.items() if abs(v) > 1e-9]
            yield pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

    return words.mapInPandas(step, "kind string, a string, b string, n double")


def restored(df: DataFrame, id_col: str, text_col: str, source_col: str, rounds: int = 3) -> DataFrame:
    """(id, found, text): every document with its restored text."""
    pairs, weights = learn(df, text_col, source_col, rounds)
    shared = df.sparkSession.sparkContext.broadcast((pairs, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*shared.value)
        for batch in batches:
            out = [judge.document(t if isinstance(t, str) else None, _source(s)) for t, s in zip(batch["t"], batch["s"], strict=True)]
            yield pd.DataFrame({"i": batch["i"], "found": [f for f, _ in out], "text": [t for _, t in out]})

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(
        F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(source_col).cast("string").alias("s")
    ).mapInPandas(run, f"i {kind}, found boolean, text string")
    return out.select(F.col("i").alias(id_col), "found", "text")
