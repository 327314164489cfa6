"""Problem 7: encoding with a public byte-level BPE vocabulary, by speculation and verification.

Texts are split by the vocabulary's pattern; every distinct word of a batch is encoded once. Greedy longest match
proposes its tokens, and all adjacent pairs of the proposals are tested together: a pair is compatible if merging its
two tokens' bytes from scratch gives just these two tokens. A sequence of valid tokens all of whose pairs are compatible
is the one that merging produces, so only words with a failing pair undergo exact merging. Words and pairs are kept per
worker in tables of bounded size.

Defined cases: null and empty texts have the empty list of ids. Texts of any length are encoded whole. Special tokens in
a text are ordinary text. Other columns are never read; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every operator.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern of the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pairs remembered by a worker.
CACHE = 200_000


class Encoder:
    """Exact BPE encoding of single words with memory."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(pattern)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.self_made: dict[int, bool] = {}
        self.merged = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost of equals."""
        n = len(word)
        if n == 1:
            return [self.rank[word]]
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                r = self.rank.get(word[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or end[i] != mid or end[j] != stop:
                continue
            end[i] = stop
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.rank[word[i : end[i]]] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = self.rank.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def _valid(self, token: int) -> bool:
        ok = self.self_made.get(token)
        if ok is None:
            ok = self.self_made[token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code a << 32 | b: whether merging from scratch keeps a and b apart."""
        distinct, back = np.unique(codes, return_inverse=True)
        known = np.empty(len(distinct), dtype=bool)
        for k, code in enumerate(distinct.tolist()):
            ok = self.pairs.get(code)
            if ok is None:
                a, b = code >> 32, code & 0xFFFFFFFF
                ok = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
                if len(self.pairs) >= CACHE:
                    self.pairs.clear()
                self.pairs[code] = ok
            known[k] = ok
        return known[back]

    def learn(self, words: set[str]) -> None:
        """Encode new words together: propose, test every adjacent pair, merge only what fails."""
        if len(self.words) + len(words) > CACHE:
            self.words.clear()
        todo = [w for w in words if w not in self.words]
        if not todo:
            return
        raw = [w.encode("utf-8", "replace") for w in todo]
        guess = [self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(guess)), sizes)
        good = np.ones(len(guess), dtype=bool)
        for t in np.unique(flat).tolist():
            if not self._valid(t):
                good[np.unique(owner[flat == t])] = False
        inner = owner[:-1] == owner[1:]
        if inner.any():
            apart = self._compatible((flat[:-1][inner] << 32) | flat[1:][inner])
            good[np.unique(owner[:-1][inner][~apart])] = False
        for w, b, g, ok in zip(todo, raw, guess, good.tolist(), strict=True):
            if not ok:
                self.merged += 1
                g = self.merge(b)
            self.words[w] = tuple(g)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split.findall(t) if t else [] for t in texts]
        distinct = {w for p in pieces for w in p}
        if len(distinct) > CACHE:
            out = []
            for p in pieces:
                self.learn(set(p))
                out.append([i for w in p for i in self.words[w]])
            return out
        self.learn(distinct)
        known = self.words
        return [[i for w in p for i in known[w]] for p in pieces]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)


def _vocabulary(folder: str, name: str) -> str:
    return os.path.join(folder, name)


def encode_column(
    df: DataFrame, id_col: str, text_col: str, folder: str = VOCABULARIES, name: str = BYTE_BPE_50K, sizes: bool = False
) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens) with ``sizes``: one narrow stage of Arrow batches."""
    path = _vocabulary(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = enc.encode(batch.column(1).to_pylist())
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "v"])
                continue
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = pa.array(np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1])), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["id", "v"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, v {'bigint' if sizes else 'array<int>'}"
    )
    return out.select(F.col("id").alias(id_col), F.col("v").alias("n_tokens" if sizes else "ids"))
