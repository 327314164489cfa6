import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import corpus as C
from quillstone.operators import drift as D
from quillstone.operators import evals as E
from quillstone.operators import nested as N
from quillstone.operators import runlog as R
from quillstone.operators import sampling as S
from quillstone.operators import tables as TB
from quillstone.operators.skew import balanced_rank, join_to_groups

# --- problem 2 ------------------------------------------------------------------------------------------------------


def brute_elements(records, roots):
    """(id, path, ordinal) by plain recursion."""
    arrays = set()

    def inner(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, (dict, list, str)):
                return v
            v = w
        return v

    def scan(name, v):
        v = inner(v)
        if isinstance(v, list):
            arrays.add(name)
            for x in v:
                scan("", x)
        elif isinstance(v, dict):
            for k, x in v.items():
                scan(k, x)

    out = []

    def walk(rid, path, name, v):
        v = inner(v)
        if isinstance(v, dict) and name in arrays:
            v = [v]
        if isinstance(v, list):
            for k, x in enumerate(v):
                x = inner(x)
                if isinstance(x, dict):
                    out.append((rid, path, k))
                    for a, b in x.items():
                        walk(rid, f"{path}[{k}].{a}", a, b)
                elif isinstance(x, list):
                    walk(rid, f"{path}[{k}]", "", x)
        elif isinstance(v, dict):
            for a, b in v.items():
                walk(rid, f"{path}.{a}", a, b)

    parsed = []
    for rid, text in records:
        try:
            v = json.loads(text)
        except (TypeError, ValueError):
            continue
        if isinstance(v, dict):
            parsed.append((rid, v))
    for _, v in parsed:
        for r in roots:
            if r in v:
                scan(r, v[r])
    for rid, v in parsed:
        for r in roots:
            if r in v:
                walk(rid, r, r, v[r])
    return sorted(out)


def random_value(rng, depth):
    kind = rng.choice(["obj", "arr", "text", "num", "null"]) if depth else "num"
    if kind == "obj":
        return {k: random_value(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    if kind == "arr":
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind == "text":
        return json.dumps(random_value(rng, depth - 1))
    return None if kind == "null" else rng.randint(0, 9)


def test_nested_elements(spark):
    rng = random.Random(1)
    rows = [(i, json.dumps({"h": random_value(rng, 5), "t": random_value(rng, 4), "x": [1]})) for i in range(150)]
    rows += [(900, None), (901, '{"h": [1, '), (902, "[]"), (903, ""), (904, '{"h": [{"a": null}, null, {}]}'), (904, '{"h": [{"a": null}, null, {}]}')]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "history_id long, record string, path string, ordinal int")
    got = N.object_elements(df, "history_id", "record", ["h", "t"])
    assert sorted(tuple(r) for r in got.collect()) == brute_elements(rows, ["h", "t"])
    assert N.object_elements(df.limit(0), "history_id", "record", ["h"]).count() == 0


def test_nested_keys_and_child_table(spark):
    rows = [(1, '{"t": {"c": [{"n": "x", "r": [{"s": 1}, {"s": 2}]}, {"n": "y", "r": {"s": 3}}]}}')]
    df = spark.createDataFrame(rows, "history_id long, record string")
    nodes = N.explode_nested(df, "history_id", "record", ["t"]).cache()
    parents = N.child_table(nodes, "t.c", "n string")
    kids = N.child_table(nodes, "t.c[].r", "s int")
    j = kids.alias("k").join(parents.alias("p"), F.col("k.parent_id") == F.col("p.node_id"))
    assert sorted((r["n"], r["s"]) for r in j.select("p.n", "k.s").collect()) == [("x", 1), ("x", 2), ("y", 3)]
    schema = N.merged_schema(df, "record", ["t"])
    assert ("t.c", "array") in {(r["path"], r["kind"]) for r in schema.collect()}
    with pytest.raises(ValueError):
        N.array_names(schema, 1)


def test_nested_values(spark):
    rows = [
        (1, '{"t": {"a": {"x": 0.5}, "c": [{"n": "x", "d": {"e": 1}, "r": [{"s": 1}, {"s": "2"}], "i": [7, null, 8]}, {"n": "y", "r": {"s": 3}}]}}'),
        (2, '{"t": "{\\"a\\": {\\"x\\": 2, \\"z\\": true}, \\"c\\": null}"}'),
        (3, "[1"),
        (4, '{"t": {"a": {"x": "none"}}}'),
    ]
    df = spark.createDataFrame(rows, "history_id long, record string")
    table = lambda name: TB.typed_table(df, "history_id", "record", ["t"], name).cache()
    root, c, r, i = table(""), table("t.c"), table("t.c[].r"), table("t.c[].i")
    assert sorted((x["record_id"], x["t_a_x"], x["t_a_z"], x["extras"]) for x in root.collect()) == [
        (1, 0.5, None, {}), (2, 2.0, True, {}), (4, None, None, {"t.a.x": '"none"'})
    ]
    assert sorted((x["ordinal"], x["n"], x["d_e"]) for x in c.collect()) == [(0, "x", 1), (1, "y", None)]
    ups = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.parent_id") == F.col("b.node_id"))
    assert sorted(map(tuple, ups(r, c).select("b.n", "a.s").collect())) == [("x", 1), ("x", 2), ("y", 3)]
    assert sorted(map(tuple, ups(i, c).select("b.n", "a.ordinal", "a.value").collect())) == [("x", 0, 7), ("x", 2, 8)]
    assert ups(c, root).select("b.record_id").distinct().collect() == [(1,)]
    # the same nodes as the explosion, and the records
    old = N.explode_nested(df, "history_id", "record", ["t"]).select("table", "node_id", "parent_id", "path", "ordinal", "kind")
    new = TB.all_rows(df, "history_id", "record", ["t"])
    assert sorted(map(tuple, old.collect())) == sorted(tuple(x) for x in new.where("table <> ''").select(old.columns).collect())
    assert {x["body"] for x in new.where("table = 't.c'").collect()} == {'{"d.e": 1, "n": "x"}', '{"n": "y"}'}


# --- problem 4 ------------------------------------------------------------------------------------------------------


def lines(*records, run="r", seq=0):
    return [(i, run, seq, i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(records)]


def changes(spark, *files, run="r"):
    rows = [x for s, f in files for x in lines(*f, seq=s, run=run)]
    df = spark.createDataFrame(rows, "id long, run_id string, file_seq int, line_no int, record string")
    out = D.schema_changes(df, "run_id", "file_seq", "record", ["iteration"])
    return sorted((r["file_seq"], r["change"], r["old_field"], r["new_field"]) for r in out.collect())


OBJ = {"total": 4, "correct": 3, "instant": {"accuracy": 0.5, "effort": "low"}}


def test_drift_kinds(spark):
    got = changes(
        spark,
        (0, [{"iteration": 1, "pre": OBJ, "post_train": OBJ}]),
        (1, [{"pre": {**OBJ, "total": "4"}, "post_train": OBJ, "iteration": 2}]),
        (2, [{"prePhase": {**OBJ, "total": "4"}, "post_train": 0.5}]),
        (5, [{"prePhase": {"total": "4", "correct": 3, "instant": {"acc": 0.5, "effort": "low"}}, "note": "x"}, '{"torn": ']),
    )
    assert got == [
        (1, "retyped", "pre.total", "pre.total"),
        (2, "renamed", "pre", "prePhase"),
        (2, "retyped", "post_train", "post_train"),
        (5, "added", "", "note"),
        (5, "removed", "post_train", ""),
        (5, "renamed", "prePhase.instant.accuracy", "prePhase.instant.acc"),
    ]


def test_drift_of_nulls_and_swaps(spark):
    assert changes(spark, (0, [{"a": None}]), (1, [{"a": 3}])) == []
    assert changes(spark, (0, [{"a": 1, "b": "x"}]), (1, [{"c": "x", "d": 1}])) == [(1, "renamed", "a", "d"), (1, "renamed", "b", "c")]
    assert changes(spark, (0, [{"pre": OBJ}]), (1, ['{"pre'])) == []
    assert changes(spark, (0, [None, "", "[1]"])) == []


def test_united_keeps_every_field(spark):
    full = {"pre": {"n": 4, "acc": 0.5, "low": {"effort": "low", "right": 1}, "top": {"effort": "top", "right": 2}}}
    records = [full] * 6 + [
        {"pre": {"n": "4", "acc": "12.5%", "retries": 3, "low": {"effort": "low", "hits": 7}}},
        {"before": {"n": [5], "share": 0.25, "low": {"effort": "low", "right": 8.0}}},
        {"pre": [{"effort": "low", "right": 5}, {"effort": "top", "right": 6}]},
        {"pre": "59/120"},
        {"pre": {"n": 4.5, "note": ["a", "b"], "Acc": 1, "acc": 0.75}},
        {"pre": {"n": 4, "retries": 9}, "other": True},
        {},
    ]
    rows = [(i, "r", i, json.dumps(x)) for i, x in enumerate(records)] + [(99, "r", 99, '{"pre": {')]
    df = spark.createDataFrame(rows, "id long, run string, seq int, rec string")
    got = {r["id"]: r for r in D.united(df, ["id"], "run", "seq", "rec", ["pre"], []).collect()}
    assert sorted(got) == list(range(13))
    said = lambda i: {k: v for k, v in got[i].asDict().items() if v is not None and k not in ("id", "extras")}
    assert said(0) == {"pre_n": 4, "pre_acc": 0.5, "pre_low_effort": "low", "pre_low_right": 1, "pre_top_effort": "top", "pre_top_right": 2}
    assert said(6) == {"pre_n": 4, "pre_acc": 0.125, "pre_retries": 3, "pre_low_effort": "low", "pre_low_right": 7}
    assert said(7) == {"pre_n": 5, "pre_acc": 0.25, "pre_low_effort": "low", "pre_low_right": 8}
    assert said(8) == {"pre_low_effort": "low", "pre_low_right": 5, "pre_top_effort": "top", "pre_top_right": 6}
    assert said(9) == {"pre": 59 / 120} and got[9]["extras"] == {"pre": '"59/120"'}
    # names that differ in case only, and two spellings in one object
    assert said(10) == {"pre_n": 4.5, "pre_Acc_2": 1, "pre_acc": 0.75, "pre_note": '["a", "b"]'}
    assert said(11) == {"pre_n": 4, "pre_retries": 9, "other": True} and said(12) == {}
    with pytest.raises(ValueError):
        D.united(df, ["id"], "run", "seq", "rec", ["pre"], [], max_fields=5)


def test_drift_predecessors(spark):
    rows = [("a", s) for s in (0, 5, 1023, 1024, 5000, 5001)] + [(None, 3), (None, 9)]
    df = spark.createDataFrame(rows, "run string, seq int")
    got = {(r["run"], r["seq"]): r["prev"] for r in D.with_predecessor(df, "run", "seq").collect()}
    assert got == {("a", 0): None, ("a", 5): 0, ("a", 1023): 5, ("a", 1024): 1023, ("a", 5000): 1024, ("a", 5001): 5000, (None, 3): None, (None, 9): 3}


def test_united_table(spark):
    rows = [x for s, f in ((0, [{"pre": OBJ}] * 2), (1, [{"prePhase": {**OBJ, "total": "7"}}]), (2, [{"pre": OBJ}, "torn{"])) for x in lines(*f, seq=s)]
    df = spark.createDataFrame(rows, "id long, run_id string, file_seq int, line_no int, record string")
    out = D.united(df, ["id", "file_seq"], "run_id", "file_seq", "record", ["pre"], ["iteration"])
    assert sorted((r["file_seq"], r["pre_total"], r["pre_instant_accuracy"]) for r in out.collect()) == [(0, 4, 0.5), (0, 4, 0.5), (1, 7, 0.5), (2, 4, 0.5)]


# --- skew -------------------------------------------------------------------------------------------------------------


def test_join_to_groups_with_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    got = join_to_groups(rows, groups.where("n > 1"), ["k"], "n", hot=2)
    assert got.count() == 1000 and got.where("low <> 0").count() == 0


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("id"), (F.col("id") % 3).alias("g"))
    got = balanced_rank(df, ["g"], ["id"], "rk").groupBy("g").agg(F.count_distinct("rk").alias("d"), F.min("rk"), F.max("rk").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["d"] == r["n"] == r["m"] + 1 for r in got)
    ranked = S.dense_rank_by_id(df, "id", width=100).orderBy("id").collect()
    assert [r["ord"] for r in ranked] == list(range(1000))


# --- corpus, sampling -----------------------------------------------------------------------------------------------


def test_sampling(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r["k"] for r in S.exact_sample(df, 37, 1, "k").collect()}
    b = {r["k"] for r in S.exact_sample(df.repartition(7), 37, 1, "k").collect()}
    assert len(a) == 37 and a == b
    assert S.exact_sample(df, 0, 1, "k").count() == 0 and S.exact_sample(df, 999, 1, "k").count() == 500
    parts = S.split(df, 0.1, 3, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"heldout": 50, "train": 450}
    assert S.held_out_size(100, 0.1) == 10 and S.held_out_size(2, 0.01) == 1
    with pytest.raises(ValueError):
        S.split(df, 1.0, 3, "k")
    assert S.prefer_first(df, F.col("k") < 3).count() == 3 and S.prefer_first(df, F.col("k") < 0).count() == 500


def test_corpus(spark):
    base = spark.createDataFrame([(1, "12+34", "a"), (2, "12+34", "a")], "ord int, operation string, key string")
    extra = spark.createDataFrame([(3, "34+12", "a"), (4, "5*5", "b"), (5, "5 * 5", "b"), (6, "", "")], "ord int, operation string, key string")
    assert sorted(r["ord"] for r in C.merge_unique(base, extra, "key", "ord").collect()) == [1, 2, 4]
    assert [r["ord"] for r in C.last_per_key(extra.where("key = 'b'"), "key", "ord").collect()] == [5]
    with pytest.raises(ValueError, match="1 keys"):
        C.assert_disjoint(base, extra, "key")
    assert C.without_keys(extra, base, "key").count() == 3
    ops = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord int, operation string")
    ans = spark.createDataFrame([("a", "1")], "operation string, output string")
    assert [r["output"] for r in C.answers_in_order(ops, ans, "operation", "output").orderBy("ord").collect()] == ["1", "", "1"]
    rows = spark.createDataFrame(
        [("2", "2", True, True), ("3", "2", True, True), ("", "2", False, False), ("5", None, True, True), ("5", None, True, False)],
        "claim string, value string, keep boolean, conf boolean",
    ).withColumn("prop", F.lit(None).cast("string"))
    got = [(r["stage"], r["kept"], r["final_solution"]) for r in C.validation_stages(rows, "claim", "value", "keep", "conf", "prop").collect()]
    assert got == [("agreed", True, "2"), ("mismatch", False, "2"), ("filled", True, "2"), ("verdict", True, "5"), ("verdict", False, "5")]


# --- evaluation -----------------------------------------------------------------------------------------------------


def test_metrics_and_intervals(spark):
    df = spark.createDataFrame([("a", "2+2", "true"), ("a", "3*3", "false"), ("a", "4*4", "incomplete"), ("a", " ", "true")], "g string, operation string, correct string")
    m = E.with_proportion_ci(E.metrics(df, ["g"]), E.z_critical(0.05)).collect()[0]
    assert (m["total"], m["completed"], m["correct"], m["incomplete"]) == (3, 2, 1, 1) and abs(m["accuracy"] - 1 / 3) < 1e-12
    d = spark.createDataFrame([(5, 10, 4, 10), (500, 1000, 480, 1000), (0, 0, 1, 2)], "correct_a long, n_a long, correct_b long, n_b long")
    small, large, none = E.with_diff_ci(d, "a", "b", E.z_critical(0.05), 0.05).collect()
    assert not small["meets_target"] and large["meets_target"] and (none["half_width"], none["low"], none["high"]) == (1.0, -1.0, 1.0)
    assert abs(E.z_critical(0.05) - 1.9599639845400536) < 1e-12
    n = spark.range(1).select(E.required_n(F.lit(0.5), F.lit(0.02), E.z_critical(0.05)).alias("a"), E.required_n(F.lit(0.5), F.lit(0.0), 2.0).alias("b")).collect()[0]
    assert (n["a"], n["b"]) == (2401, 10**9)


def test_marginal_and_streak(spark):
    def flags(posts, n, z):
        df = spark.createDataFrame([(i, p / n, n, p) for i, p in enumerate(posts)], "i int, post double, n long, correct long")
        return E.with_marginal(df, "post", "n", "correct", "i", 0.005, z)

    assert flags([100, 103], 200, 1.0).orderBy("i").collect()[1]["marginal"]
    assert not flags([100, 103], 200, 0.0).orderBy("i").collect()[1]["marginal"]
    assert not flags([100, 124], 200, 1.0).orderBy("i").collect()[1]["marginal"]
    f = spark.createDataFrame([(0, False), (1, True), (2, True)], "i int, m boolean")
    assert E.trailing_streak(f, "m", "i").collect()[0]["streak"] == 2


def test_sequential_stop(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), F.col("id").alias("ord"), F.lit(1).alias("correct_a"), F.lit(1).alias("correct_b"))
    r = E.sequential_stop(df, ["g"], E.StopRule()).collect()[0]
    assert (r["n_used"], r["target_met"], r["exhausted"]) == (40, True, False)
    mixed = df.withColumn("correct_a", F.col("ord") % 2)
    r = E.sequential_stop(mixed, ["g"], E.StopRule()).collect()[0]
    assert (r["n_used"], r["target_met"], r["exhausted"]) == (200, False, True)
    r = E.sequential_stop(mixed.limit(0), ["g"], E.StopRule()).count()
    assert r == 0


# --- run log --------------------------------------------------------------------------------------------------------


def test_runlog(spark):
    cp = spark.createDataFrame([(0, 10, "000010"), (0, 20, "000020"), (1, None, "a"), (None, 1, "z")], "iteration int, batch int, name string")
    roles = {(r["iteration"], r["name"]): r["role"] for r in R.checkpoint_roles(cp, ["iteration"], "batch", "name").collect()}
    assert roles == {(0, "000010"): "intermediate", (0, "000020"): "finalized", (1, "a"): "finalized"}
    base = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 1, "old")], "ord long, iteration int, v string")
    new = spark.createDataFrame([(0, 1, "A"), (1, 3, "C")], "ord long, iteration int, v string")
    got = [(r["ord"], r["iteration"], r["v"]) for r in R.upsert(base, new, "iteration", "ord").orderBy("ord").collect()]
    assert got == [(0, 1, "A"), (1, 2, "b"), (4, 3, "C")]
    again = R.upsert(R.upsert(base, new, "iteration", "ord"), new, "iteration", "ord").orderBy("ord").collect()
    assert [r["v"] for r in again] == ["A", "b", "C"]
    h = spark.createDataFrame([(1, 100, 0.5), (2, 100, 0.6)], "g int, n long, acc double")
    late = spark.createDataFrame([(1, 50, 0.9), (2, 200, 0.7)], "g int, n long, acc double")
    assert [(r["acc"], r["refined"]) for r in R.refine(h, late, "g", "n", ["acc"]).orderBy("g").collect()] == [(0.5, False), (0.7, True)]
    z = spark.createDataFrame([(0.0, 0.4)], "a double, b double").select(R.headline(F.col("a"), F.col("b")).alias("x"), R.headline(F.col("a"), F.col("b"), True).alias("y")).collect()[0]
    assert (z["x"], z["y"]) == (0.4, 0.0)
    g = spark.createDataFrame([(None, 0, None), (7, 0, None), (None, None, None), (None, -1, None)], "g int, i int, k string")
    out = g.select(R.generation(F.col("g"), R.is_imported(F.col("k"), F.col("k"), F.col("i")), F.col("i"), F.lit(True)).alias("x")).collect()
    assert [r["x"] for r in out] == [2, 7, 1, 1]
    assert spark.range(1).select(R.is_interim(F.lit(None).cast("boolean"), F.lit("final"), F.lit("Interim value, CI refine to come")).alias("x")).collect()[0]["x"]


def test_remote_boundary(spark):
    from quillstone.operators import remote

    waits, seen = [], []

    def flaky(content):
        seen.append(content)
        if len(seen) < 3:
            raise OSError("busy")
        return content.upper()

    assert remote.attempt(flaky, "a", pause=waits.append) == "A" and waits == [1.0, 2.0]

    def call(content):
        if content == "bad":
            raise OSError("no")
        return content + "!"

    requests = spark.createDataFrame([(1, "x"), (2, "bad")], "key long, user_content string")
    got = remote.ask(requests, call, tries=1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x!", False), (2, "", True)]
    assert not remote.all_failed(got) and remote.all_failed(got.where("failed")) and not remote.all_failed(got.limit(0))


def test_init_run(spark):
    from quillstone.plans import pipelines

    df = spark.createDataFrame([(i, f"{i % 20}+1", f"{i % 20}+1") for i in range(100)], "id int, operation string, key string")
    parts = pipelines.init_run(df, 0.1, 3, 5, id_col="id", key="key")
    C.assert_disjoint(parts["train"], parts["heldout"], "key")
    assert parts["heldout"].count() == 10 and parts["train_sample"].count() == 5 and parts["heldout_sample"].count() == 5


def test_generation_without_target_keeps_every_candidate(spark):
    from quillstone.plans.pipelines import generated

    text = "<example>operation: {0}+1 solution: {0}</example>"
    replies = spark.createDataFrame([(i, text.format(i)) for i in range(20)], "key long, text string")
    none = spark.createDataFrame([], "key string")
    assert generated(replies, none, none, None).count() == 20
    assert generated(replies, none, none, 5).count() == 5


def test_optional_split_may_hold_nothing_out(spark):
    from quillstone.operators.sampling import split

    df = spark.range(10)
    assert {r["split"] for r in split(df, 0, 1, "id", optional=True).collect()} == {"train"}
    assert {r["split"] for r in split(df.limit(1), 0.5, 1, "id", optional=True).collect()} == {"train"}
    with pytest.raises(ValueError):
        split(df, 0, 1, "id")
