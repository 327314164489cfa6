"""Composite pipelines: run initialisation, generation with validation, the dashboard's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import evaluator
from quillstone.functions import text as T
from quillstone.operators import corpus as C
from quillstone.operators import evals as E
from quillstone.operators import runlog as R
from quillstone.operators import sampling as S
from quillstone.plans import runlog as Q


def init_run(examples: DataFrame, fraction: float, seed: int, sample: int, *, id_col: str, key: str) -> dict[str, DataFrame]:
    """Split, leak guard on the training side, and the two evaluation samples."""
    parts = S.split(examples, fraction, seed, id_col)
    held = parts.where("split = 'heldout'")
    train = C.without_keys(parts.where("split = 'train'"), held, key)
    return {
        "train": train,
        "heldout": held,
        "train_sample": S.exact_sample(train, sample, seed + 1, id_col),
        "heldout_sample": S.exact_sample(held, sample, seed + 2, id_col),
    }


def generated(responses: DataFrame, seeds: DataFrame, heldout: DataFrame, target: int | None) -> DataFrame:
    """Candidates (src, ord, operation, solution, key) parsed from responses (key, text): new against seeds, held-out rows and
    each other, in the order of the responses, at most ``target`` (None: all)."""
    pairs = responses.select(F.col("key").alias("src"), F.posexplode(T.generated_pairs(F.col("text"))).alias("ord", "p"))
    rows = pairs.select("src", "ord", "p.operation", "p.solution").withColumn("key", evaluator.canonical_key(F.col("operation")))
    new = C.first_per_key(rows.where("key <> ''"), "key", "src", "ord")
    new = C.without_keys(C.without_keys(new, seeds, "key"), heldout, "key")
    return new if target is None else new.orderBy("src", "ord").limit(target)


def generate_and_validate(pool: DataFrame, heldout: DataFrame, responses: DataFrame, verdicts: DataFrame, target: int | None) -> dict[str, DataFrame]:
    """The pool (operation, solution, key) after one round, with the audit of all candidates.

    ``verdicts`` are judge responses (operation, text); operations without one are discarded unless the evaluator decides.
    """
    candidates = generated(responses, pool, heldout, target)
    v = verdicts.select("operation", T.verdict(F.col("text")).alias("v"))
    rows = candidates.withColumn("computed", evaluator.programmatic_solution(F.col("operation"))).join(v, "operation", "left")
    rows = rows.withColumns(
        {"keep": F.coalesce("v.keep", F.lit(False)), "confident": T.confidence_is_high(F.col("v.confidence")), "proposed": F.col("v.solution")}
    )
    audit = C.validation_stages(rows, "solution", "computed", "keep", "confident", "proposed")
    kept = audit.where("kept").select("operation", F.col("final_solution").alias("solution"), "key", "src", "ord")
    merged = C.merge_unique(pool.select("operation", "solution", "key").withColumns({"src": F.lit(None).cast("string"), "ord": F.lit(None).cast("int")}), kept.withColumn("src", F.col("src").cast("string")), "key", "src", "ord")
    return {"audit": audit.drop("v"), "pool": merged.select("operation", "solution", "key")}


def snapshot(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The dashboard's tables by name."""
    names = ("history_series", "latest_eval", "chart_points", "checkpoint_roles", "events_tail", "status_last_value", "baseline_view", "list_runs")
    return {n: Q.QUERIES[n](spark, sf) for n in names}


# --- queries ----------------------------------------------------------------------------------------------------------


def run_init(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows that are neither held out nor share a key with a held-out row."""
    rows = spark.read.parquet(f"{sf}/train_data.parquet").select("example_id", "operation")
    parts = init_run(rows.withColumn("key", T.text_key(F.col("operation"))), 0.1, 7, 200, id_col="example_id", key="key")
    return parts["train"].select("example_id")


def generation_round(spark: SparkSession, sf: str) -> DataFrame:
    """One round: validated rows as model replies, the training data as pool; stages of the audit."""
    key = evaluator.canonical_key(F.col("operation"))
    pool = spark.read.parquet(f"{sf}/train_data.parquet").where("operation is not null").select("operation", "solution", key.alias("key"))
    held = spark.read.parquet(f"{sf}/eval_heldout_sample.parquet").where("operation is not null").select(key.alias("key"))
    v = spark.read.parquet(f"{sf}/validated.parquet").where("operation is not null")
    text = F.concat(F.lit("<example> operation: "), "operation", F.lit(" solution: "), F.coalesce("solution", F.lit("")), F.lit(" </example>"))
    responses = v.select(F.col("example_id").alias("key"), text.alias("text"))
    verdicts = v.groupBy("operation").agg(F.max("confidence").alias("c")).select("operation", F.concat(F.lit("<verdict>keep</verdict><confidence>"), F.coalesce("c", F.lit("low")), F.lit("</confidence>")).alias("text"))
    out = generate_and_validate(pool, held, responses, verdicts, None)
    return out["audit"].groupBy("stage").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of three months of orders as high, instant and previous side, per priority."""
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("m", F.month("o_orderdate"))
    cols = []
    for m, x in ((3, "high"), (2, "instant"), (1, "previous")):
        here = F.col("m") == m
        cols += [F.count_if(here & (F.col("o_orderstatus") == "F")).alias(f"correct_{x}"), F.count_if(here).alias(f"n_{x}")]
    return o.groupBy("o_orderpriority").agg(*cols)


Z = E.z_critical(0.05)


def eval_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return E.comparisons(_sides(spark, sf), ["o_orderpriority"], Z, 0.1)


def eval_all_met(spark: SparkSession, sf: str) -> DataFrame:
    sides = _sides(spark, sf)
    both = E.comparisons(sides, ["o_orderpriority"], Z, 0.1)
    return E.all_required_met(sides, both, ["o_orderpriority"], ["high_minus_instant", "instant_minus_previous"])


def generation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The records of generation 2 or iteration 0 of all runs collapse into one correction."""
    h = Q._history(spark, sf).select(F.col("history_id").alias("ord"), "iteration", "generation", "train_pool_size")
    new = spark.createDataFrame([(0, 0, 2, -1)], "ord long, iteration int, generation int, train_pool_size int")
    return R.upsert_where(h, new, (F.col("iteration") == 0) | (F.col("generation") == 2), "ord")


def finished_records(spark: SparkSession, sf: str) -> DataFrame:
    """History blocks per month from two priorities as splits and two statuses as stages."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    split = F.when(F.col("o_orderkey") % 2 == 0, "train_seed").otherwise("heldout")
    stage = F.when(F.col("o_custkey") % 2 == 0, "pre").otherwise("post")
    ev = o.groupBy(F.month("o_orderdate").alias("iteration"), split.alias("split"), stage.alias("stage")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"))
    r = R.finished_record(ev, ["iteration"])
    return r.select("iteration", F.round("train_seed.delta", 9).alias("train_delta"), F.round("heldout.delta", 9).alias("heldout_delta"), F.round("delta.overfit_gap", 9).alias("overfit_gap"))


_SIDES_SQL = """sides as (select o_orderpriority, """ + ", ".join(
    f"count(*) filter (where month(o_orderdate) = {m} and o_orderstatus = 'F') as c{x}, count(*) filter (where month(o_orderdate) = {m}) as n{x}" for m, x in ((3, "h"), (2, "i"), (1, "p"))
) + " from orders group by 1)"


def _cmp(name: str, a: str, b: str) -> str:
    d, h = f"(c{a}/n{a} - c{b}/n{b})", f"({Z!r} * sqrt((c{a}/n{a})*(1-c{a}/n{a})/n{a} + (c{b}/n{b})*(1-c{b}/n{b})/n{b}))"
    return f"select o_orderpriority, '{name}' as name, {d} as diff, {h} as half_width, {d} - {h} as low, {d} + {h} as high, {h} <= 0.1 + 1e-15 as meets_target from sides where n{a} > 0 and n{b} > 0"


_CMP_SQL = f"with {_SIDES_SQL}, cmp as ({_cmp('high_minus_instant', 'h', 'i')} union all {_cmp('instant_minus_previous', 'i', 'p')})"
_TEXT_KEY = r"lower(regexp_replace(operation, '[ \t\r\n\v\f]', '', 'g'))"

QUERIES = {f.__name__: f for f in (run_init, generation_round, eval_comparisons, eval_all_met, generation_upsert, finished_records)}
SQL = {
    "run_init": f"""with r as (select example_id, {_TEXT_KEY} as key, row_number() over (order by md5(concat_ws(':', '7', cast(example_id as varchar))), example_id) as rk,
count(*) over () as total from train_data), s as (select *, rk <= least(greatest(round_even(total * 0.1, 0), 1), total - 1) as held from r)
select example_id from s where not held and (key is null or key not in (select key from s where held and key is not null))""",
    "eval_comparisons": f"{_CMP_SQL} select * from cmp",
    "eval_all_met": f"{_CMP_SQL} select s.o_orderpriority, coalesce(bool_and(c.meets_target), true) as met from sides s left join cmp c on s.o_orderpriority = c.o_orderpriority group by 1",
    "generation_upsert": f"""with {Q._H}, x as (select history_id as ord, iteration, generation, train_pool_size, coalesce(iteration = 0 or generation = 2, false) as m from h)
select ord, iteration, generation, train_pool_size from x where not m union all
select coalesce(min(ord) filter (where m), max(ord) + 1, 0), 0, 2, -1 from x""",
    "finished_records": """with e as (select month(o_orderdate) as iteration, o_orderkey % 2 = 0 as train, o_custkey % 2 = 0 as pre, avg(case when o_orderstatus = 'F' then 1.0::double else 0.0 end) as a from orders group by 1, 2, 3),
w as (select iteration, max(a) filter (where train and pre) as tp, max(a) filter (where train and not pre) as tq, max(a) filter (where not train and pre) as hp, max(a) filter (where not train and not pre) as hq from e group by 1)
select cast(iteration as int) as iteration, round(tq - tp, 9) as train_delta, round(hq - hp, 9) as heldout_delta, round(tq - hq, 9) as overfit_gap from w""",
}
