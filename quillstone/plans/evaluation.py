"""Evaluation queries. Answers come from ``lineitem``: the operation ``quantity*line`` is answered right, wrong or not at
all by return flag, odd lines belong to the instant policy and even ones to the high one, the split is the line status.
Iterations come from ``orders``: a month is an iteration and the share of status F its accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import evaluator
from quillstone.functions import text as T
from quillstone.operators import evals as E
from quillstone.operators.sampling import dense_rank_by_id, priority

Z = E.z_critical(0.05)
TARGET = 0.02
RULE = E.StopRule(batch=40, least=40, most=4000, target=0.02)

SCORED_SQL = """scored as (
  select l_linestatus as split, case when l_linenumber % 2 = 1 then 'instant' else 'high' end as effort,
         concat(cast(cast(l_quantity as bigint) as varchar), '*', cast(l_linenumber as varchar)) as operation,
         case l_returnflag when 'A' then cast(cast(l_quantity as bigint) * l_linenumber as varchar)
                           when 'N' then cast(cast(l_quantity as bigint) + l_linenumber as varchar) else '' end as output,
         case when l_returnflag = 'R' then 'incomplete' when l_returnflag = 'A' or
              cast(l_quantity as bigint) * l_linenumber = cast(l_quantity as bigint) + l_linenumber
              then 'true' else 'false' end as correct, l_orderkey, l_linenumber from lineitem)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(split, effort, operation, expected, output) of every line."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_linestatus").alias("split"),
        F.when(n % 2 == 1, "instant").otherwise("high").alias("effort"),
        F.concat(q.cast("string"), F.lit("*"), n.cast("string")).alias("operation"),
        (q * n).cast("string").alias("expected"),
        F.when(F.col("l_returnflag") == "A", (q * n).cast("string")).when(F.col("l_returnflag") == "N", (q + n).cast("string")).otherwise("").alias("output"),
        "l_orderkey",
        "l_linenumber",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    df = answers(spark, sf)
    right = T.numbers_equal(T.numeric_answer(F.col("output")), F.col("expected").cast("double"))
    flag = F.when(~T.is_completed(F.col("output")), "incomplete").when(right, "true").otherwise("false")
    return df.withColumn("correct", flag)


def eval_metrics_ci(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_proportion_ci(E.metrics(scored(spark, sf), ["split"]), Z)


def _both(spark: SparkSession, sf: str) -> DataFrame:
    m = E.metrics(scored(spark, sf), ["split", "effort"])
    side = lambda e, c: F.max(F.when(F.col("effort") == e, F.col(c)))
    return m.groupBy("split").agg(
        *[side(e, c).alias(f"{e}_{name}") for e in ("instant", "high") for c, name in (("correct", "correct"), ("total", "n"), ("completed", "completed"), ("accuracy", "accuracy"))]
    )


def eval_differential(spark: SparkSession, sf: str) -> DataFrame:
    """high minus instant with its interval; no gap if the high side was skipped."""
    both = _both(spark, sf).withColumn(
        "accuracy_gap", F.when(F.col("high_completed") > 0, F.col("high_accuracy") - F.col("instant_accuracy"))
    )
    both = both.withColumnsRenamed({f"{e}_{x}": f"{e[0]}_{x}" for e in ("instant", "high") for x in ("correct", "n")})
    both = both.withColumnsRenamed({"h_correct": "correct_h", "h_n": "n_h", "i_correct": "correct_i", "i_n": "n_i"})
    both = both.withColumnsRenamed({"correct_h": "correct_h", "n_h": "n_h"})
    out = E.with_diff_ci(both, "h", "i", Z, TARGET)
    return out.select("split", "n_h", "correct_h", "n_i", "correct_i", "accuracy_gap", "diff", "half_width", "low", "high", "meets_target")


def eval_coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    asked = rows.groupBy("split").agg(F.count("*").alias("sample"))
    m = E.metrics(rows, ["split"]).join(asked, "split")
    return m.select("split", (F.col("total") == F.col("sample")).alias("scored_all"), (F.col("completed") + F.col("incomplete") == F.col("total")).alias("adds_up"))


def overfit_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Instant accuracy of the training side (F) minus that of the held-out side (O)."""
    m = E.metrics(scored(spark, sf).where("effort = 'instant'"), ["split"])
    side = lambda s: F.max(F.when(F.col("split") == s, F.col("accuracy")))
    return m.agg(side("F").alias("train_seed"), side("O").alias("heldout")).withColumn("overfit_gap", F.col("train_seed") - F.col("heldout"))


def delta_block(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas from the instant (pre) to the high (post) side for both splits."""
    m = _both(spark, sf)
    side = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    w = m.agg(*[side(s, f"{e}_accuracy").alias(f"{n}_{e}") for s, n in (("F", "train"), ("O", "heldout")) for e in ("instant", "high")])
    return w.select(
        (F.col("train_high") - F.col("train_instant")).alias("train_delta"),
        (F.col("heldout_high") - F.col("heldout_instant")).alias("heldout_delta"),
        ((F.col("train_high") - F.col("heldout_high")) - (F.col("train_instant") - F.col("heldout_instant"))).alias("gap_delta"),
    )


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order with 0/1 results of two policies, ranked by key within the status."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("split"),
        (F.col("o_totalprice") > 100000).cast("long").alias("correct_a"),
        (F.col("o_orderstatus") == "F").cast("long").alias("correct_b"),
    )
    parts = [dense_rank_by_id(o.where(F.col("split") == s), "o_orderkey") for s in ("even", "odd")]
    return parts[0].unionByName(parts[1])


_POOL_SQL = """pool as (select case when o_orderkey % 2 = 0 then 'even' else 'odd' end as split,
  cast(o_totalprice > 100000 as bigint) as a, cast(o_orderstatus = 'F' as bigint) as b,
  row_number() over (partition by o_orderkey % 2 order by o_orderkey) as n from orders),
run as (select split, n as n_used, sum(a) over w as correct_a, sum(b) over w as correct_b, count(*) over (partition by split) as n_pool
  from pool window w as (partition by split order by n))"""


def _stop_sql(rule: E.StopRule) -> str:
    z = repr(E.z_critical(rule.p_value))
    return f"""with {_POOL_SQL}, cut as (select *, least(n_pool, {rule.most}) as most,
  {z} * sqrt((correct_a/n_used)*(1-correct_a/n_used)/n_used + (correct_b/n_used)*(1-correct_b/n_used)/n_used) as half_width from run
  where n_used <= {rule.most} and (n_used % {rule.batch} = 0 or n_used = n_pool)),
ok as (select *, half_width <= {rule.target} + 1e-15 as target_met from cut where n_used >= least({max(rule.least, rule.batch)}, most)),
first as (select *, row_number() over (partition by split order by n_used) as rn from ok where target_met or n_used >= most)
select split, n_used, cast(correct_a as bigint) as correct_a, cast(correct_b as bigint) as correct_b, half_width, target_met, n_pool,
  not target_met as exhausted from first where rn = 1"""


def sequential_stop(spark: SparkSession, sf: str) -> DataFrame:
    return E.sequential_stop(_pool(spark, sf), ["split"], RULE)


SMALL = E.StopRule(batch=40, least=40, most=200, target=0.02)


def dual_eval_stop(spark: SparkSession, sf: str) -> DataFrame:
    """The required split runs to its cap, the other one is capped at the least sample."""
    pool = _pool(spark, sf)
    main = E.sequential_stop(pool.where("split = 'even'"), ["split"], SMALL)
    side = E.sequential_stop(pool.where("split = 'odd'"), ["split"], E.StopRule(batch=40, least=40, most=40))
    return main.unionByName(side)


def required_n(spark: SparkSession, sf: str) -> DataFrame:
    m = E.metrics(scored(spark, sf), ["split", "effort"])
    return m.select("split", "effort", E.required_n(F.col("accuracy"), F.lit(0.02), Z).alias("n_for_2pp"))


def _months(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    m = o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("iteration")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("correct")
    )
    return m.withColumn("post", E.share(F.col("correct"), F.col("n")))


_MONTHS_SQL = """months as (select cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as iteration, count(*) as n,
  count(*) filter (where o_orderstatus = 'F') as correct from orders group by 1),
steps as (select *, correct / n as post from months),
flags as (select iteration, n, correct, post, post - lag(post) over w as gain,
  case when lag(post) over w is null then 0.0 else 1.0 * sqrt(0.0 + post*(1-post)/n + (lag(post) over w)*(1-(lag(post) over w))/(lag(n) over w)) end as band
  from steps window w as (order by iteration)),
marks as (select *, coalesce(gain < greatest(0.005, band), false) as marginal from flags)"""


def noise_band(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_marginal(_months(spark, sf), "post", "n", "correct", "iteration", 0.005, 1.0)
    return m.select("iteration", F.round("band", 9).alias("band"))


def marginal_flags(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_marginal(_months(spark, sf), "post", "n", "correct", "iteration", 0.005, 1.0)
    return m.select("iteration", "n", "correct", "marginal")


def marginal_streak(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_marginal(_months(spark, sf), "post", "n", "correct", "iteration", 0.005, 1.0)
    return E.trailing_streak(m, "marginal", "iteration")


def number_only(spark: SparkSession, sf: str) -> DataFrame:
    """Which outputs are plain numbers, and their canonical text."""
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet").select("answer_id", F.col("output").alias("o"))
    ok = T.is_number_only(F.col("o"))
    return a.select("answer_id", ok.alias("number_only"), F.when(ok, T.canonical_number(F.col("o"))).alias("value"))


_NUM = r"[+-]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)"


def last_number(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet")
    return a.select("answer_id", T.last_number(F.col("output")).alias("last_number"))


def newline_escape(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", T.escape_newlines(F.col("text")).alias("escaped"), (T.unescape_newlines(T.escape_newlines(F.col("text"))) == F.col("text")).alias("round_trip"))


def numeric_match(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of line items compared with the expected product by numeric rules."""
    a = answers(spark, sf)
    return a.groupBy("split", T.solutions_match(F.concat(F.lit("The result is "), F.col("output")), F.col("expected")).alias("matches")).agg(F.count("*").alias("n"))


def evaluator_basic(spark: SparkSession, sf: str) -> DataFrame:
    """Values of generated operations by the bounded evaluator."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    op = F.concat(F.lit("("), q, F.lit("+"), n, F.lit(")^2 - max("), q, F.lit(","), n, F.lit(")*"), n, F.lit(" + "), n, F.lit("!")).alias("operation")
    distinct = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(op).agg(F.count("*").alias("n_rows"))
    return distinct.select("operation", "n_rows", evaluator.value(F.col("operation")).alias("value"))


def scored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer of the run, scored with the evaluator; each distinct operation is evaluated once."""
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet").select("answer_id", "operation", "output")
    values = a.select("operation").distinct().withColumn("value", evaluator.value(F.col("operation")))
    j = a.join(values, "operation", "left")
    flag = F.when(~T.is_completed(F.col("output")), "incomplete").when(T.numbers_equal(T.numeric_answer(F.col("output")), F.col("value")), "true").otherwise("false")
    return j.select("answer_id", "operation", flag.alias("correct"))


def scored_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_proportion_ci(E.metrics(scored_answers(spark, sf).withColumn("run", F.lit("all")), ["run"]), Z)


def judge_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Rewards of judge texts made of the confidence of validated rows."""
    v = spark.read.parquet(f"{sf}/validated.parquet")
    score = F.when(F.col("confidence") == "high", "1").when(F.col("confidence") == "medium", "0.5").otherwise("0")
    text = F.concat(F.lit("I checked it. <score>"), score, F.lit("</score>"))
    s = T.judge_score(text)
    return v.select("example_id", T.judge_reward(s, F.col("confidence").isNotNull()).alias("reward"))


_M = "count(*) as total, count(*) filter (where correct <> 'incomplete') as completed, count(*) filter (where correct = 'true') as correct, count(*) filter (where correct = 'incomplete') as incomplete"
_BOTH_SQL = f"""with {SCORED_SQL}, m as (select split, effort, {_M}, count(*) filter (where correct = 'true') / count(*) as accuracy from scored group by 1, 2),
sides as (select i.split, h.correct as correct_h, h.total as n_h, h.completed as done_h, h.accuracy as acc_h, i.correct as correct_i, i.total as n_i, i.accuracy as acc_i
  from m i join m h on i.split = h.split and i.effort = 'instant' and h.effort = 'high')"""
_HALF = f"{Z!r} * sqrt((correct_h/n_h)*(1-correct_h/n_h)/n_h + (correct_i/n_i)*(1-correct_i/n_i)/n_i)"

QUERIES = {
    f.__name__: f
    for f in (
        eval_metrics_ci, eval_differential, eval_coverage_check, overfit_gap, delta_block, sequential_stop, dual_eval_stop, required_n,
        noise_band, marginal_flags, marginal_streak, number_only, last_number, newline_escape, numeric_match, evaluator_basic,
        scored_answers, scored_metrics, judge_reward,
    )
}
SQL = {
    "eval_metrics_ci": f"""with {SCORED_SQL}, m as (select split, {_M} from scored group by 1), a as (select *, correct / total as accuracy from m),
h as (select *, {Z!r} * sqrt(accuracy * (1 - accuracy) / total) as half_width from a)
select *, greatest(0.0, accuracy - half_width) as low, least(1.0, accuracy + half_width) as high from h""",
    "eval_differential": f"""{_BOTH_SQL} select split, n_h, correct_h, n_i, correct_i, case when done_h > 0 then acc_h - acc_i end as accuracy_gap,
correct_h/n_h - correct_i/n_i as diff, {_HALF} as half_width, correct_h/n_h - correct_i/n_i - {_HALF} as low, correct_h/n_h - correct_i/n_i + {_HALF} as high,
{_HALF} <= {TARGET} + 1e-15 as meets_target from sides""",
    "eval_coverage_check": f"""with {SCORED_SQL} select split, count(*) filter (where trim(operation) <> '') = count(*) as scored_all,
count(*) filter (where correct <> 'incomplete') + count(*) filter (where correct = 'incomplete') = count(*) as adds_up from scored group by 1""",
    "overfit_gap": f"""with {SCORED_SQL}, m as (select split, count(*) filter (where correct = 'true') / count(*) as accuracy from scored where effort = 'instant' group by 1),
w as (select max(accuracy) filter (where split = 'F') as train_seed, max(accuracy) filter (where split = 'O') as heldout from m)
select train_seed, heldout, train_seed - heldout as overfit_gap from w""",
    "delta_block": f"""{_BOTH_SQL}, w as (select max(acc_h) filter (where split='F') as fh, max(acc_i) filter (where split='F') as fi,
max(acc_h) filter (where split='O') as oh, max(acc_i) filter (where split='O') as oi from sides)
select fh - fi as train_delta, oh - oi as heldout_delta, (fh - oh) - (fi - oi) as gap_delta from w""",
    "sequential_stop": _stop_sql(RULE),
    "dual_eval_stop": f"""select * from ({_stop_sql(SMALL)}) where split = 'even' union all
select * from ({_stop_sql(E.StopRule(batch=40, least=40, most=40))}) where split = 'odd'""",
    "required_n": f"""with {SCORED_SQL}, m as (select split, effort, count(*) filter (where correct = 'true') / count(*) as p from scored group by 1, 2)
select split, effort, cast(ceil({Z * Z!r} * p * (1 - p) / (0.02::double * 0.02::double)) as bigint) as n_for_2pp from m""",
    "noise_band": f"with {_MONTHS_SQL} select iteration, round(band, 9) as band from marks",
    "marginal_flags": f"with {_MONTHS_SQL} select iteration, n, correct, marginal from marks",
    "marginal_streak": f"""with {_MONTHS_SQL} select count(*) as streak from marks
where iteration > coalesce((select max(iteration) from marks where not marginal), -1)""",
    "number_only": r"""with a as (select answer_id, trim(output) as o, coalesce(regexp_full_match(trim(output), '[+-]?([0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)'), false) as ok from arithmetic_run_instant),
v as (select *, case when ok then cast(o as double) end as d from a)
select answer_id, ok as number_only, case when not ok then null when d = floor(d) and abs(d) <= 9007199254740992 then cast(cast(d as decimal(20,0)) as varchar)
else regexp_replace(o, '^\++', '') end as value from v""",
    "last_number": rf"select answer_id, regexp_extract_all(output, '{_NUM}')[-1] as last_number from arithmetic_run_instant",
    "newline_escape": r"""with e as (select doc_id, text, replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '\n') as escaped from documents)
select doc_id, escaped, replace(replace(escaped, '\n', chr(10)), '\r', chr(13)) = text as round_trip from e""",
    "numeric_match": f"""with {SCORED_SQL} select split, correct = 'true' as matches, count(*) as n from scored group by 1, 2""",
    "evaluator_basic": """with a as (select cast(l_quantity as bigint) as q, cast(l_linenumber as bigint) as n from lineitem),
g as (select q, n, count(*) as n_rows from a group by 1, 2)
select concat('(', q, '+', n, ')^2 - max(', q, ',', n, ')*', n, ' + ', n, '!') as operation, n_rows,
cast((q + n) * (q + n) - greatest(q, n) * n + factorial(cast(n as int)) as double) as value from g""",
    "judge_reward": """select example_id, 0.1::double * (case when confidence is null then -1.0 else 0.0 end)::double
+ (case confidence when 'high' then 1.0 when 'medium' then 0.5 else 0.0 end)::double as reward from validated""",
}
