import base64
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import formatting, incremental, ledger, mojibake, packing, pairs, tokens

VOCAB = os.path.join(tokens.VOCABULARIES, tokens.BYTE_BPE_50K)
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")


# --- 1: copies hidden by formatting ----------------------------------------------------------------------------------

MATH = "example_id long, operation string, solution string, key string, id long, h1 int"


def brute_key(op, sol):
    """Independent canonical form in plain Python."""

    def canon(t):
        t = re.sub(r"[\s​⁠﻿ ]", "", t or "").lower()
        t = t.translate(str.maketrans({"×": "*", "÷": "/", "−": "-", "＋": "+", ";": ",", "'": None, "“": None, "”": None, "`": None, "_": None, "$": None}))
        for _ in range(5):
            t = re.sub(r"^[=>:#•|]+|[=?.:,]+$", "", t)
            t = re.sub(r"^\*+|\*+$", "", t)
            if t[:1] in "([" and t[-1:] in ")]" and t:
                depth, cut = 0, True
                for i, c in enumerate(t):
                    depth += (c in "([") - (c in ")]")
                    if depth == 0 and i < len(t) - 1:
                        cut = False
                if cut:
                    t = t[1:-1]
        t = t.replace("**", "^")
        if "(" not in t:
            t = re.sub(r"(?<=\d),(?=\d{3}(\D|$))", "", t)
        return t.lstrip("+")

    a, b = canon(op), canon(sol)
    return None if not a else tuple(sorted([a, b or "\0"]))


def test_formatting_copies_against_brute_force(spark):
    rng = random.Random(3)
    ops = [f"{rng.choice(['gcd', 'max'])}({rng.randint(1, 9)},{rng.randint(1, 9)})*{rng.randint(1, 30)}" for _ in range(40)] + [f"{rng.randint(1000, 1020)}" for _ in range(10)]
    dress = [
        lambda s: s, str.upper, lambda s: f" {s} ", lambda s: f"“{s}”", lambda s: f"({s})", lambda s: f"= {s}.", lambda s: s.replace("*", "×").replace(",", "; "), lambda s: f"**{s}** = ?",
        lambda s: f"# [{s}]", lambda s: "​" + s + " ", lambda s: re.sub(r"^(\d)(\d{3})$", r"\1,\2", s),
    ]
    rows = []
    for i in range(600):
        op, sol = rng.choice(ops), rng.choice(["12", "-12", "", None, "1.5"])
        a, b = rng.choice(dress)(op), (rng.choice(dress)(sol) if sol else rng.choice([None, "", "  "]))
        rows.append((i, *((b, a) if sol and rng.random() < 0.2 else (a, b)), "clash", 5, 1))
    rows += [(i, op, "1", None, None, None) for i, op in ((700, None), (701, " "), (702, "``"))]
    first, want = {}, set()
    for i, a, b, *_ in rows:
        k = brute_key(a, b)
        if k is None:
            continue
        if k in first:
            want.add((first[k], i))
        first.setdefault(k, i)
    df = spark.createDataFrame(rows, MATH).repartition(5)
    got = {tuple(r) for r in formatting.formatting_copies(df, "example_id", ["operation", "solution"]).collect()}
    assert got == want
    counts = formatting.formatting_counts(df, "example_id", ["operation", "solution"]).collect()
    assert sum(r["n_rows"] for r in counts) == 600 and len(counts) == len(first)


def test_formatting_survives_hash_collisions(spark):
    rows = [(i, str(i % 7), "1", None, None, None) for i in range(70)]
    df = spark.createDataFrame(rows, MATH)
    weak = lambda c: (F.lit(1).cast("long"), (F.xxhash64(c) % 2).cast("long"))
    bad = {tuple(r) for r in formatting.formatting_copies(df, "example_id", ["operation", "solution"], hasher=weak).collect()}
    good = {tuple(r) for r in formatting.formatting_copies(df, "example_id", ["operation", "solution"]).collect()}
    assert bad == good and len(good) == 63


def test_formatting_edge_cases(spark):
    empty = spark.createDataFrame([], MATH)
    assert formatting.formatting_copies(empty, "example_id", ["operation", "solution"]).count() == 0
    long = "1+" * 50000 + "1"
    df = spark.createDataFrame([(1, long, None, None, None, None), (2, f"({long})", " ", None, None, None), (2, long, None, None, None, None)], MATH)
    assert sorted(tuple(r) for r in formatting.formatting_copies(df, "example_id", ["operation", "solution"]).collect()) == [(1, 2), (1, 2)]


# --- 3: ledger -------------------------------------------------------------------------------------------------------


def ledger_rows(spark, upto, parts=3):
    rows = [(s, f" op{s}-{i % 40} " if i % 3 else f"op{s}-{i % 40}", "x") for s in range(upto + 1) for i in range(60)] + [(0, None, "x"), (1, "  ", "x")]
    return spark.createDataFrame(rows, "snapshot int, operation string, track string").repartition(parts)


def test_ledger_is_stable(spark):
    run = lambda upto, parts: {(r["track"], r["operation"]): r["snapshot"] for r in ledger.stable_sample({"t": ledger_rows(spark, upto, parts)}, "operation", "snapshot", share=0.3, least=5).collect()}
    three, again, two = run(3, 3), run(3, 7), run(2, 2)
    assert three == again and two.items() <= three.items()
    assert len(three) == 48 and len(two) == 36  # 30 % of 160 and of 120 distinct operations
    assert not any(k[1] != k[1].strip() for k in three)


def test_ledger_of_nothing(spark):
    empty = ledger_rows(spark, 0).limit(0)
    assert ledger.stable_sample({"t": empty}, "operation", "snapshot").count() == 0


def test_ledger_is_continued_by_a_later_run(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = lambda df: {(r["operation"], r["snapshot"]) for r in df.collect()}
    run = lambda upto, **kw: rows(ledger.stable_sample({"t": ledger_rows(spark, upto)}, "operation", "snapshot", share=0.3, least=5, **kw))
    first = run(1, path=path)
    later = run(3, path=path)
    assert first < later == run(3)
    with pytest.raises(ValueError):
        ledger.Ledger(spark, path, share=0.5)


def test_cut_is_exact(spark):
    assert ledger.cut_of({"0a": 3, "00": 2, "ff": 9}, 4) == ("0a", 2)
    keys = spark.createDataFrame([("a", f"k{i}") for i in range(1000)] + [("b", f"k{i}") for i in range(50)], "track string, key string")
    book = ledger.Ledger(spark, share=0.02, least=9)
    book.grow(keys, 0)
    got = {(r["track"], r["key"]) for r in book.members().collect()}
    order = lambda t, n: sorted((hashlib.md5(f"ledger-1\x01{t}\x01k{i}".encode()).hexdigest(), f"k{i}") for i in range(n))
    assert got == {("a", k) for _, k in order("a", 1000)[:20]} | {("b", k) for _, k in order("b", 50)[:9]}


# --- 5: incremental deduplication ------------------------------------------------------------------------------------


def test_incremental_against_brute_force(spark):
    from quillstone.llm.opkey import operation_keys

    rng = random.Random(9)
    forms = [lambda a, b: f"{a}+{b}", lambda a, b: f"{b} + {a}", lambda a, b: f"What is ({a}.0+{b})?", lambda a, b: f"{a}-{b}", lambda a, b: f"gcd({a},{b})", lambda a, b: f"GCD({b};{a})"]
    ops = [rng.choice(forms)(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(400)] + [None, " ", "plain words", "Plain  words!"] * 3
    rng.shuffle(ops)
    rows = [(i, o, "clash", i) for i, o in enumerate(ops)]
    schema = "example_id long, operation string, key string, id long"
    history = spark.createDataFrame(rows[:150], schema)
    batches = spark.createDataFrame([(*r, (r[0] - 150) // 40 if r[0] < 380 else None) for r in rows[150:]], schema + ", batch_no int")
    first, want = {}, set()
    for i, o, *_ in rows:
        tree, text = operation_keys(o)
        k = tree or text
        if k is None:
            continue
        if k in first and i >= 150:
            want.add((first[k], i))
        first.setdefault(k, i)
    got = incremental.repeats_of_history(history, batches, "example_id", "operation", "batch_no", fan=3, range_rows=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_incremental_with_empty_sides(spark):
    schema = "example_id long, operation string, batch_no int"
    some = spark.createDataFrame([(1, "1+1", 0), (2, "1 + 1", 1), (2, "1 + 1", 1)], schema)
    none = some.limit(0)
    run = lambda h, b: sorted(tuple(r) for r in incremental.repeats_of_history(h, b, "example_id", "operation", "batch_no").collect())
    assert run(some, none) == []
    assert run(none, some) == [(1, 2)]


def test_store_is_continued_by_a_later_session(spark, tmp_path):
    rows = [(i, f"{i % 50}+{i % 7 + 1}") for i in range(300)]
    df = spark.createDataFrame(rows, "example_id long, operation string")
    path = f"file://{tmp_path}/store"
    keyed = lambda a, b: incremental.keyed_rows(df.where(f"example_id >= {a} and example_id < {b}"), "example_id", "operation")
    incremental.AcceptedRuns(spark, path, fan=2, range_rows=20).merge(keyed(0, 100))
    got = set()
    for a in (100, 150, 200, 250):
        store = incremental.AcceptedRuns(spark, path, fan=2, range_rows=20)
        assert store.runs and store.splits
        got |= {(r["first_id"], r["id"]) for r in store.check(keyed(a, a + 50)).collect()}
        store.vacuum()
    first, want = {}, set()
    for i, o in rows:
        k = tuple(sorted(map(int, o.split("+"))))
        if k in first and i >= 100:
            want.add((first[k], i))
        first.setdefault(k, i)
    assert got == want
    assert len(incremental.AcceptedRuns(spark, path).runs) <= 4


def test_store_takes_an_empty_batch(spark):
    df = spark.createDataFrame([(1, "1+1"), (2, "1 + 1")], "id long, t string")
    store = incremental.AcceptedRuns(spark)
    store.merge(incremental.keyed_rows(df.where("id = 1"), "id", "t"))
    none = spark.createDataFrame([], "id long, t string")
    assert store.check(incremental.keyed_rows(none, "id", "t")).count() == 0
    assert [tuple(r) for r in store.check(incremental.keyed_rows(df.where("id = 2"), "id", "t")).collect()] == [(2, 1)]


def test_only_touched_ranges_and_blocks_are_read(spark):
    old = spark.createDataFrame([(i, f"{i}+1") for i in range(1000, 3000)], "id long, t string")
    store = incremental.AcceptedRuns(spark, range_rows=100)
    store.merge(incremental.keyed_rows(old, "id", "t"))
    assert len(store.splits) > 10
    new = incremental.keyed_rows(spark.createDataFrame([(5000, "1 + 2500.0")], "id long, t string"), "id", "t")
    assert [tuple(r) for r in store.check(new).collect()] == [(5000, 2500)]
    at = {r["r"] for r in new.select(F.explode("keys").alias("key")).select(store._range(F.col("key")).alias("r")).collect()}
    assert len(at) <= 2
    keys = [r["key"] for r in store.read(["000000"]).select("key").collect()]
    by_range = {r["key"]: r["r"] for r in store.read(["000000"]).select("key", "r").collect()}
    in_order = [by_range[k] for k in sorted(keys, key=str.encode)]
    assert in_order == sorted(in_order)


def test_near_duplicates_of_texts(spark):
    base = "please work through the whole of this exercise and write down every single step of the way to the end"
    rows = [(1, base), (2, base + " now"), (3, "well " + base), (4, "an entirely different text about something that nobody ever asked for at all"), (5, base.upper() + "!")]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "example_id long, operation string, batch_no int")
    got = incremental.repeats_of_history(df.where("example_id = 1"), df.where("example_id > 1"), "example_id", "operation", "batch_no")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (1, 3), (1, 5)]


def test_batches_named_by_text(spark):
    df = spark.createDataFrame([(1, "1+1", "b"), (2, "1 + 1", "a"), (3, "2+2", "10"), (4, "2+2", None)], "example_id long, operation string, batch_no string")
    got = incremental.repeats_of_history(df.limit(0), df, "example_id", "operation", "batch_no")
    assert sorted(tuple(r) for r in got.collect()) == [(3, 4)]


# --- 6: broken pairs -------------------------------------------------------------------------------------------------

PAIRS = [
    ("1+2", None, "empty"), ("1+2", " \\n ", "empty"), ("1+2", "``", "empty"), ("1+2", "3", None), ("1+2", "99", None), ("1+2", "**3**", None), ("1+2", "1 + 2", "copy"), ("1+2", "What is (1+2)?", "copy"),
    ("7", "7", None), ("7", "Answer: 7", None), ("1+2", "1+2 = 3", None), ("1+2", "Le résultat est 3.", "language"), ("1+2", "答えは 3 です。", "language"), ("1+2", "Using the naïve order of operations, the result is 3.", None),
    ("1+2", "Vastaus on 3", "language"), ("1+2", "Step 1: add.\\nResult: 3", None),
]


def test_pairs_one_by_one():
    for q, o, want in PAIRS:
        kind = pairs.read_pair(q, o)[0]
        assert (kind if kind not in ("value", "open", "bare") else None) == want, (q, o, kind)


def test_opening_clusters_against_all_pairs(spark):
    rng = random.Random(4)
    words = "we must now decline this one since no rule of ours allows any such answer here today".split()
    openings = set()
    for _ in range(60):
        base = [rng.choice(words) for _ in range(12)]
        for cut in (12, 11, 10):
            openings.add(" ".join(base[:cut]))
            openings.add(" ".join([rng.choice(words), *base[: cut - 1]]))
    openings = sorted(openings)
    got = {r["opening"]: r["cluster"] for r in pairs.opening_clusters(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    up = {o: o for o in openings}

    def root(o):
        while up[o] != o:
            o = up[o]
        return o

    alike = [(a, b) for i, a in enumerate(openings) for b in openings[:i] if pairs._jaccard(a, b) >= 0.8]
    for a, b in alike:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    assert len(alike) > 50 and sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)
    assert all(root(got[o]) == root(o) for o in openings)


def test_pairs_by_templates(spark):
    rows, want = [], {}
    template = "To evaluate {q}, I take the parts one after another, which leaves {v} at the end."
    for i in range(30):
        q = f"{i + 10}*{i + 3}"
        rows.append((len(rows), q, template.format(q=q, v=(i + 10) * (i + 3))))
    for i in range(30):
        q, n = f"{i + 5}-{i + 9}", len(rows)
        text = template.format(q=q, v=1)[: 25 + 2 * i]
        if "which leaves 1" in text:
            continue
        rows.append((n, q, text))
        want[n] = "truncated"
    for i, say in enumerate(["I must decline to answer.", "I cannot help with this calculation!", "Unfortunately I must decline to answer", "Denied."] * 4):
        want[len(rows)] = "refusal"
        rows.append((len(rows), f"{i}+1", say))
    want[len(rows)] = "truncated"  # said once
    rows.append((len(rows), "8+9", "Adding the two parts together gives the total."))
    for i in range(6):
        want[len(rows)] = "truncated"
        rows.append((len(rows), f"{i}+2", "So the final result is equal to"))
    for q, o, d in PAIRS:
        if d:
            want[len(rows)] = d
        rows.append((len(rows), q, o))
    rows.append((len(rows), None, "3"))
    rows.append((len(rows), "1+1", "word " * 20000 + "2"))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "answer_id long, operation string, output string, words string")
    got = {r["answer_id"]: r["defect"] for r in pairs.defects(df, "answer_id", "operation", "output").collect()}
    got.pop(len(rows) - 1, None)  # a sentence of one repeated word: any verdict on its language will do
    assert got == want
    assert pairs.defects(df.limit(0), "answer_id", "operation", "output").count() == 0


def test_pairs_by_recurrence(spark):
    value = "Well, here I take the parts one after another, which leaves {v} at the end."
    rows = [(i, f"{i}+3", value.format(v=i + 3)) for i in range(10)]
    want = {}
    for q, say, defect in [
        # told like a value, broken off after a full stop, once
        ("5*8", "Now I take the parts one after another.", "truncated"),
        # the same shingle with one question only, however written, carries nothing
        ("5 * 8", "Look, I take the parts one after another, and", "truncated"),
        # said to one question only: recurrence alone reveals a refusal
        ("6*8", "This is not for me to work out.", "truncated"),
        ("7*8", "So this is not for me to work out and", "truncated"),
        ("1*8", "Regrettably I must decline to answer this.", "refusal"),
        ("2*8", "Sadly I must decline to answer this.", "refusal"),
        ("3*8", "My friend, I must decline to answer this because", "refusal"),
    ]:
        want[len(rows)] = defect
        rows.append((len(rows), q, say))
    df = spark.createDataFrame(rows, "answer_id long, operation string, output string")
    got = {r["answer_id"]: r["defect"] for r in pairs.defects(df, "answer_id", "operation", "output").collect()}
    assert got == want


def test_pairs_plans_stay_small(spark, monkeypatch):
    plans, cut = [], pairs.cut

    def recorded(df, name, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, *args)

    monkeypatch.setattr(pairs, "cut", recorded)
    rows = [
        (0, "1+1", "I think 2 and no more"),
        # one template; where others have a value a bare number is one, an operation is none
        (1, "7", "I think 7 and no more"), (2, "3+4", "I think 3+4 and no more"),
        (3, "5*8", "I must decline to answer this."), (4, "6*8", "I must decline to answer this."),
    ]
    out = pairs.defects(spark.createDataFrame(rows, "answer_id long, operation string, output string"), "answer_id", "operation", "output")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["answer_id"]: r["defect"] for r in out.collect()} == {2: "truncated", 3: "refusal", 4: "refusal"}
    # one join to groups is five joins; the driver keeps every plan and each of its broadcasts
    assert max(len(re.findall(r"\w+Join\b", p)) for p in plans) <= 6


# --- 7: tokens -------------------------------------------------------------------------------------------------------


@needs_vocab
def test_tokens_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = "abcdefgh  \n\t'sßéж数🙂0123456789.,;()+-_=<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += [None, "", " ", "<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 4000, "The theatre's theology, thereafter."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_column(df, "doc_id", "text").collect()}
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.encode_column(df, "doc_id", "text", sizes=True).collect()}
    assert all(sizes[i] == len(got[i]) for i in sizes)


@needs_vocab
def test_small_cache_gives_the_same(monkeypatch):
    texts = ["one two three four five six seven", "eight nine ten one two", "x y z"]
    want = tokens.Encoder(VOCAB).encode(texts)
    monkeypatch.setattr(tokens, "CACHE", 4)
    assert tokens.Encoder(VOCAB).encode(texts) == want


# --- 8: packing ------------------------------------------------------------------------------------------------------


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(10):
        sizes = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
        counts = rng.integers(1, 20, 9)
        pad = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes, counts, strict=True))
        from itertools import combinations

        best = min(pad([*c, int(sizes[-1])]) for k in range(3) for c in combinations(map(int, sizes[:-1]), k))
        assert pad(packing.bucket_bounds(sizes, counts, 3)) == best


def best_fit(sizes, cap):
    """Number of containers of best-fit decreasing."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(cap - s)
    return len(rooms)


@pytest.mark.parametrize("buckets", [4, 128])
def test_packing_is_whole_and_fits(spark, buckets):
    rng = random.Random(4)
    sizes = [rng.choice([rng.randint(1, 60), 100, 101, 250, 7]) for _ in range(700)] + [0, None, 5, 5, 5]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    rows = packing.pack_all(df, "doc_id", "n_tokens", [100, 300, None], buckets=buckets).collect()
    for cap in (100, 300):
        mine = [r for r in rows if r["capacity"] == cap]
        load, parts = {}, {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["size"]
            parts.setdefault(r["doc_id"], []).append(r)
        assert max(load.values()) <= cap
        for i, s in enumerate(sizes):
            assert sum(r["size"] for r in parts[i]) == (s or 0)
            assert len({r["part"] for r in parts[i]}) == len(parts[i]) == max(1, -(-(s or 0) // cap))
        if buckets == 128:
            assert len(load) <= 1.03 * best_fit([r["size"] for r in mine], cap) + 1
    assert packing.pack_all(df.limit(0), "doc_id", "n_tokens", [100]).count() == 0


# --- 9: wrong encodings ----------------------------------------------------------------------------------------------

CLEAN = {
    "fr": "La référence déplace le numérateur. Élève et modèle ont répondu différemment à la question très pénible de l’été.",
    "de": "Größere Stichproben kosten mehr, verkürzen aber das gewählte Maß über alle Übungen hinweg während der Prüfung.",
    "ru": "Каждая строка повторяет знак числа. Внешний цикл подтверждает половину запаса до конца обучения и скрывает вывод.",
}


def wrong(text, true, read):
    return "".join(ch if raw is None else raw for ch, raw in ((c, _reread(c, true, read)) for c in text))


def _reread(c, true, read):
    if c.isascii():
        return None
    try:
        return c.encode(true).decode(read)
    except UnicodeError:
        return None


def test_wrong_encodings_are_found_and_restored(spark):
    rows, bad = [], {}
    for i in range(240):
        lang = ["fr", "de", "ru"][i % 3]
        rows.append((i, CLEAN[lang], "s"))
    swaps = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "mac-roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "koi8-r", "cp1251"), ("de", "utf-8", "cp850"), ("ru", "cp866", "cp1251")]
    for k, (lang, true, read) in enumerate(swaps):
        n = len(rows)
        rows.append((n, wrong(CLEAN[lang], true, read), "s"))
        bad[n] = CLEAN[lang]
    for t in (None, "", "  ", "plain ASCII only", "Matrix Ã is the closure of A", "À L’ÂGE DE 5 ANS, L’ÉLÈVE COMPTE DÉJÀ."):
        rows.append((len(rows), t, None))
    lossy = len(rows)
    rows.append((lossy, "La r�f�rence est l�", "s"))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, found string")
    out = {r["doc_id"]: r for r in mojibake.restored(df, "doc_id", "text", "source").collect()}
    assert {i for i, r in out.items() if r["found"]} == {*bad, lossy}
    same = sum(out[i]["text"] == t for i, t in bad.items())
    assert same >= len(bad) - 2
    assert mojibake.restored(df.limit(0), "doc_id", "text", "source").count() == 0


# --- the queries run on the smallest tables ---------------------------------------------------------------------------


@needs_vocab
def test_queries(spark, small):
    from quillstone.llm import queries

    for name, query in queries.QUERIES.items():
        df = query(spark, small)
        assert df.count() >= 0 and df.columns, name


def test_too_many_capacities_are_an_error(spark, tmp_path):
    from quillstone.llm import queries

    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1, queries.MAX_CAPACITIES + 2).withColumnRenamed("id", "capacity").write.parquet(f"{tmp_path}/pack_capacity.parquet")
    with pytest.raises(ValueError):
        queries.p8_packed(spark, str(tmp_path))
