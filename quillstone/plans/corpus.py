"""Corpus queries over the project's own tables. Keys of operations are the plain text keys (lower case without white
space), which SQL can state too; ``corpus_tree_keys`` shows the syntax keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import evaluator
from quillstone.functions import text as T
from quillstone.operators import corpus as C
from quillstone.operators import sampling as S

SEED = 7
_KEY = r"lower(regexp_replace(operation, '[ \t\r\n\v\f]', '', 'g'))"


def _examples(spark: SparkSession, sf: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet").select("example_id", "operation", "solution")
    return df.withColumn("key", T.text_key(F.col("operation")))


def _operations(spark: SparkSession, sf: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet").select("example_id", "operation")
    return df.withColumn("key", T.text_key(F.col("operation")))


def _heldout(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/eval_heldout_sample.parquet").select("row_id", "operation")
    return df.withColumn("key", T.text_key(F.col("operation")))


def corpus_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys of the documents' texts."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.select(F.lower(F.regexp_replace("text", r"[ \t\r\n]", "")).alias("key")).distinct().agg(F.count("*").alias("n_keys"))


def corpus_tree_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per syntax key; each distinct operation is parsed once."""
    ops = spark.read.parquet(f"{sf}/train_data.parquet").where("operation is not null").groupBy("operation").agg(F.count("*").alias("n"))
    return ops.select(evaluator.canonical_key(F.col("operation")).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n_rows"))


def commutative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """q*n and n*q share a key: the number of rows of each."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = T.commutative_pair_key(F.col("l_quantity").cast("long"), "Mult", F.col("l_linenumber"))
    return li.groupBy(key.alias("key")).agg(F.count("*").alias("n_rows"))


def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_per_key(_examples(spark, sf, "math_example"), "key", "example_id").select("example_id", "key")


def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The last answered row of every operation, among answers that are plain numbers."""
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet").where(T.is_number_only(F.col("output")))
    last = C.last_per_key(a.select("answer_id", "operation", "output"), "operation", "answer_id")
    return last.select("answer_id", "operation", F.trim("output").alias("output"))


def merge_unique(spark: SparkSession, sf: str) -> DataFrame:
    base, extra = _operations(spark, sf, "train_data"), _operations(spark, sf, "validated")
    return C.merge_unique(base, extra, "key", "example_id").select("example_id", "key")


def leak_guard_anti(spark: SparkSession, sf: str) -> DataFrame:
    return C.without_keys(_operations(spark, sf, "train_data"), _heldout(spark, sf), "key").select("example_id", "operation")


def leak_overlap(spark: SparkSession, sf: str) -> DataFrame:
    both = C.overlap(_operations(spark, sf, "validated").where("key is not null"), _operations(spark, sf, "train_data"), "key")
    return both.agg(F.count("*").alias("n_shared"), F.min("key").alias("smallest"))


def new_key_count(spark: SparkSession, sf: str) -> DataFrame:
    new = C.new_keys(_operations(spark, sf, "validated").where("key is not null"), _operations(spark, sf, "train_data"), "key")
    return new.agg(F.count("*").alias("n_new"))


def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.exact_sample(_examples(spark, sf, "math_example"), 200, SEED, "example_id").select("example_id", "operation")


def train_heldout_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split(_operations(spark, sf, "train_data").select("example_id"), 0.1, SEED, "example_id")


def trainer_split(spark: SparkSession, sf: str) -> DataFrame:
    """The trainer's own split uses another seed namespace."""
    return S.split(_operations(spark, sf, "train_data").select("example_id"), 0.25, "trainer:3", "example_id", optional=True)


def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    parts = train_heldout_split(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("example_id").alias("first"), F.max("example_id").alias("last"))
    return parts


def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 64 rows in id order; the last one may be short."""
    ranked = S.dense_rank_by_id(_operations(spark, sf, "train_data").select("example_id"), "example_id")
    return ranked.groupBy(F.floor(F.col("ord") / 64).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("example_id").alias("first"), F.max("example_id").alias("last"))


def seed_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _operations(spark, sf, "train_data").select("example_id")
    return S.seeded_batches(rows, 4, 20, SEED, 17, "example_id")


def replicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every held-out row four times."""
    return S.replicate(_heldout(spark, sf).select("row_id"), 4)


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """Training operations without a finished answer."""
    done = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet").where(T.is_number_only(F.col("output")))
    return C.pending(_operations(spark, sf, "train_data").where("operation is not null"), done, "operation").select("example_id")


def answered_work(spark: SparkSession, sf: str) -> DataFrame:
    """Training operations with a finished answer."""
    done = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet").where(T.is_number_only(F.col("output")))
    return C.finished(_operations(spark, sf, "train_data"), done, "operation").select("example_id")


def ordered_answers(spark: SparkSession, sf: str) -> DataFrame:
    ops = _operations(spark, sf, "train_data").where("operation is not null").select("example_id", "operation")
    return C.answers_in_order(ops, dedup_last_wins(spark, sf), "operation", "output").select("example_id", "output")


def order_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Positions at which two readings of the training rows differ (one is trimmed)."""
    a = _operations(spark, sf, "train_data").select("example_id", "operation")
    return C.order_mismatches(a, a.withColumn("operation", F.trim("operation")), "example_id", "operation")


def prefer_solved(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a solution, or all if none has one."""
    rows = _examples(spark, sf, "math_example")
    return S.prefer_first(rows, F.length(F.trim("solution")) > 0).select("example_id")


def target_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 400 new operations of validated in arrival order, none of which is in the training data."""
    new = C.first_per_key(_operations(spark, sf, "validated").where("key <> ''"), "key", "example_id")
    return C.without_keys(new, _operations(spark, sf, "train_data"), "key").orderBy("example_id").limit(400).select("example_id", "key")


def validation_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of the validation of math_example: claims against the evaluator, the rest by a verdict on the source."""
    m = _examples(spark, sf, "math_example").where("key <> ''")
    vals = m.select("operation").distinct().withColumn("computed", evaluator.programmatic_solution(F.col("operation")))
    rows = m.join(vals, "operation", "left").withColumns(
        {"keep": F.col("example_id") % 2 == 0, "confident": T.confidence_is_high(F.lit("high")), "proposed": F.lit(None).cast("string")}
    )
    out = C.validation_stages(rows, "solution", "computed", "keep", "confident", "proposed")
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


def data_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows by iteration."""
    t = spark.read.parquet(f"{sf}/train_data.parquet")
    return t.groupBy("iteration").agg(F.count("*").alias("n_rows"), F.count_distinct("operation").alias("n_operations"))


_T = f"(select example_id, operation, {_KEY} as key from train_data)"
_V = f"(select example_id, operation, {_KEY} as key from validated)"
_H = f"(select row_id, {_KEY} as key from eval_heldout_sample)"


def _ranked(seed: str, table: str, key: str = "example_id") -> str:
    return f"(select *, row_number() over (order by md5(concat_ws(':', '{seed}', cast({key} as varchar))), {key}) as rk, count(*) over () as total from {table})"


_DONE = r"regexp_full_match(trim(output), '[+-]?([0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)')"
_SPLIT = f"select example_id, case when rk <= least(greatest(round_even(total * 0.1, 0), 1), total - 1) then 'heldout' else 'train' end as split from {_ranked('7', 'train_data')}"

QUERIES = {
    f.__name__: f
    for f in (
        corpus_keys, corpus_tree_keys, commutative_pairs, dedup_first_wins, dedup_last_wins, merge_unique, leak_guard_anti, leak_overlap,
        new_key_count, exact_sample, train_heldout_split, trainer_split, split_manifest, batch_ids, seed_batches, replicate_groups,
        pending_work, answered_work, ordered_answers, order_mismatches, prefer_solved, target_capped, validation_funnel, data_growth,
    )
}
SQL = {
    "corpus_keys": r"select count(distinct lower(regexp_replace(text, '[ \t\r\n]', '', 'g'))) as n_keys from documents where text is not null",
    "commutative_pairs": """with a as (select cast(cast(l_quantity as bigint) as varchar) as q, cast(l_linenumber as varchar) as n from lineitem)
select concat(least(q, n), '|Mult|', greatest(q, n)) as key, count(*) as n_rows from a group by 1""",
    "dedup_first_wins": f"select min(example_id) as example_id, key from (select example_id, {_KEY} as key from math_example) where key is not null group by key",
    "dedup_last_wins": f"""select answer_id, operation, trim(output) as output from (select *, row_number() over (partition by operation order by answer_id desc) as rn
from arithmetic_run_instant where {_DONE}) where rn = 1""",
    "merge_unique": f"""select example_id, key from {_T} union all select min(example_id), key from {_V}
where key <> '' and key not in (select key from {_T} where key is not null) group by key""",
    "leak_guard_anti": f"select example_id, operation from {_T} where key is null or key not in (select key from {_H} where key is not null)",
    "leak_overlap": f"select count(distinct key) as n_shared, min(key) as smallest from {_V} where key in (select key from {_T} where key is not null)",
    "new_key_count": f"select count(distinct key) as n_new from {_V} where key not in (select key from {_T} where key is not null)",
    "exact_sample": f"select example_id, operation from {_ranked('7', 'math_example')} where rk <= 200",
    "train_heldout_split": _SPLIT,
    "trainer_split": f"select example_id, case when rk <= least(greatest(round_even(total * 0.25, 0), 1), total - 1) then 'heldout' else 'train' end as split from {_ranked('trainer:3', 'train_data')}",
    "split_manifest": f"select split, count(*) as n, min(example_id) as first, max(example_id) as last from ({_SPLIT}) group by 1",
    "batch_ids": """select cast(floor((rn - 1) / 64) as bigint) as batch, count(*) as n, min(example_id) as first, max(example_id) as last
from (select example_id, row_number() over (order by example_id) as rn from train_data) group by 1""",
    "seed_batches": " union all ".join(f"select example_id, {b} as batch from {_ranked(str(7 + 17 * b), 'train_data')} where rk <= 20" for b in range(4)),
    "replicate_groups": "select row_id, cast(unnest([1, 2, 3, 4]) as int) as copy from eval_heldout_sample",
    "pending_work": f"select example_id from train_data where operation is not null and operation not in (select operation from arithmetic_run_instant where {_DONE})",
    "answered_work": f"select example_id from train_data where operation in (select operation from arithmetic_run_instant where {_DONE})",
    "ordered_answers": f"""with d as (select operation, trim(output) as output from (select *, row_number() over (partition by operation order by answer_id desc) as rn
from arithmetic_run_instant where {_DONE}) where rn = 1) select example_id, coalesce(d.output, '') as output from train_data t left join d on t.operation = d.operation where t.operation is not null""",
    "order_mismatches": "select count(*) filter (where operation is distinct from trim(operation, ' ')) as mismatches from train_data",
    "prefer_solved": "select example_id from math_example where length(trim(solution)) > 0 or not exists (select 1 from math_example where length(trim(solution)) > 0)",
    "target_capped": f"""select min(example_id) as example_id, key from {_V} where key <> '' and key not in (select key from {_T} where key is not null)
group by key order by 1 limit 400""",
    "data_growth": "select iteration, count(*) as n_rows, count(distinct operation) as n_operations from train_data group by 1",
}
