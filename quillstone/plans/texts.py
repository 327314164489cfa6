"""Queries over free text: pairs, verdicts, scores and numbers, on golden cases and on whole real columns; the evaluator's functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import evaluator
from quillstone.functions import text as T
from quillstone.session import scratch
from quillstone.sources import readers, writers

# --- golden cases ---------------------------------------------------------------------------------------------------

PARSED = [
    ('Here are problems:\n[\n {"operation": "2+2", "solution": "4"},\n {"operation": "3*5", "solution": "15"}\n]\n', [("2+2", "4"), ("3*5", "15")]),
    ('[{"expr": "1+1", "answer": 2.0}, 7, {"operation": "", "solution": 3}, {"operation": "5-5", "solution": 0}]', [("1+1", "2")]),
    ("<example>\noperation: 10-3\nsolution: 7\n</example>\n<EXAMPLE> operation: gcd(12,8) solution: +4.0 </EXAMPLE>", [("10-3", "7"), ("gcd(12,8)", "4")]),
    ("1. 6*7 = 42\n- fib(7) -> 13\n", [("6*7", "42"), ("fib(7)", "13")]),
    ("operation, solution\ngcd(4,6) = 2\n2+2 => 4\nsee a = some words\n* 7/2, 3.5", [("gcd(4,6)", "2"), ("2+2", "4"), ("7/2", "3.5")]),
    ("[1] and [not json]\r\n3) 8/4 = 2.000", [("8/4", "2")]),
    ("Expression = 5\nexpr, 3\n1e3 = 1000", [("1e3", "1000")]),
    ("", []),
    ("nothing to see", []),
]
VERDICTS = [
    ("Looks correct.\n<verdict>keep</verdict>\n<confidence>high</confidence>\n<solution>42</solution>\n", None, True, "high", "42", True),
    ("<VERDICT> Discard </VERDICT><confidence>0.85</confidence>", "9", False, "0.85", "9", True),
    ("<verdict>keep</verdict><confidence>quite sure</confidence><solution>4.0</solution>", None, True, "low", "4", False),
    ("<verdict>maybe</verdict><confidence>Medium</confidence><solution>1 2</solution>", "", False, "medium", None, False),
    ("", "7", False, "low", "7", False),
]
SCORES = [
    ("<score>1</score>", 1.0), ("<score>0</score>", 0.0), ("ok <SCORE> 0.5 </SCORE>", 0.5), ("<score>1.5</score>", 1.0), ("yes", 1.0), ("The answer is correct.", 1.0),
    ("incorrect", 0.0), ("First no, in the end it is TRUE.", 1.0), ("yes … false", 0.0), ("", 0.0), ("nothing", 0.0), ("<score>2</score> know", 0.0), ("<score>.25</score>", 0.25),
]
NUMBERS = [
    ("5 3", "3"), ("1'000", "0"), ("**4.0**", "4"), ("`-7`", "-7"), ("+2.50", "2.50"), ("The result is 12.", "12"), ("3\\n", "3"), ("x = 4\\ry", "4"), ("1e5", "5"), ("none", None), ("", None),
    ("\"+8.0\"", "8"), ("12,345", "345"), (".5", ".5"),
]
#: Every function of the evaluator, both sides of its caps, and the rules of ``!``.
VALUES: list[tuple[str, float | None]] = [
    ("factorial(5)", 120.0), ("factorial(21)", None), ("fact(3)", 6.0), ("fact(-1)", None), ("comb(5,2)", 10.0), ("comb(10000,1)", 10000.0), ("comb(10001,1)", None), ("C(6,3)", 20.0),
    ("perm(5,2)", 20.0), ("perm(10001,1)", None), ("P(4,4)", 24.0), ("gcd(48,18,27)", 3.0), ("gcd(1.5,3)", None), ("lcm(4,6)", 12.0), ("lcm(0,5)", 0.0), ("abs(-3.5)", 3.5),
    ("floor(-2.5)", -3.0), ("ceil(-2.5)", -2.0), ("round(2.5)", 2.0), ("round(3.5)", 4.0), ("sqrt(144)", 12.0), ("sqrt(-1)", None), ("isqrt(17)", 4.0), ("isqrt(2.5)", None),
    ("fib(10)", 55.0), ("fib(70)", 190392490709135.0), ("fib(71)", None), ("digit_sum(-907)", 16.0), ("digit_product(234)", 24.0), ("digit_product(0)", 0.0), ("reverse_digits(-120)", -21.0),
    ("sigma(12)", 28.0), ("sigma(0)", None), ("sigma(1000000000001)", None), ("phi(36)", 12.0), ("phi(1000000000001)", None), ("totient(7)", 6.0), ("prime_count(100)", 25.0),
    ("prime_count(1)", 0.0), ("prime_count(200001)", None), ("nth_prime(1)", 2.0), ("nth_prime(10000)", 104729.0), ("nth_prime(10001)", None), ("pow(2,10)", 1024.0), ("pow(2,-1)", None),
    ("2^0.5^2", 1.189207115002721), ("10^16", 1e16), ("10^17", None), ("mod(-7,3)", 2.0), ("mod(7,0)", None), ("max(1,9,3)", 9.0), ("min(4,2)", 2.0), ("max()", None), ("7//2", 3.0), ("-7//2", -4.0),
    ("-7%3", 2.0), ("1/0", None), ("5!", 120.0), ("5 !", 120.0), ("(1+2)!", 6.0), ("3!!", 720.0), ("fact(3)!", 720.0), ("fact (3)!", 720.0), ("4.0!", None), ("!5", None), ("5!=5", None), ("x!", None),
    ("2^3!", 64.0), ("", None), ("abc", None), ("1+", None), ("sin(1)", None), ("+".join(["1"] * 111), 111.0),
]
#: operation, solution by programme: only texts up to 200 characters have one.
SOLUTIONS = [("7/2", "3.5"), ("6/2", "3"), ("1/3", "0.333333333333"), ("+".join(["1"] * 100), "100"), ("+".join(["1"] * 101), None), ("1/0", None), ("2^0.5", "1.41421356237")]
ANSWERED = [
    ("2+2", "4", "true"), ("3*3", "8", "false"), ("4*4", "", "incomplete"), ("4*4", " \\n ", "incomplete"), ("7/2", "**3.5**", "true"), ("1/0", "0", "false"), ("6", "The answer is 6.", "true"),
    ("+".join(["1"] * 111), "111", "true"), ("2+2", "no idea", "false"),
]


def _values(rows: Sequence[tuple], names: Sequence[str]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::double" if isinstance(v, float) else f"{v}::int"

    return "select * from (values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") as t({', '.join(names)})"


def _cases(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")


def parse_cases(spark: SparkSession, sf: str) -> DataFrame:
    df = _cases(spark, [(t,) for t, _ in PARSED], "t string")
    pairs = df.select("id", F.posexplode(T.generated_pairs(F.col("t"))).alias("place", "p"))
    return pairs.select("id", "place", "p.operation", "p.solution")


def verdict_cases(spark: SparkSession, sf: str) -> DataFrame:
    df = _cases(spark, [r[:2] for r in VERDICTS], "t string, f string").withColumn("v", T.verdict(F.col("t"), F.col("f")))
    return df.select("id", "v.keep", "v.confidence", "v.solution", T.confidence_is_high(F.col("v.confidence")).alias("high"))


def judge_score_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, [(t,) for t, _ in SCORES], "t string").select("id", T.judge_score(F.col("t")).alias("score"))


def number_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, [(t,) for t, _ in NUMBERS], "t string").select("id", T.to_number_only(F.col("t")).alias("number"))


def evaluator_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, [(t,) for t, _ in VALUES], "operation string").select("operation", evaluator.value(F.col("operation")).alias("value"))


def programmatic_solutions(spark: SparkSession, sf: str) -> DataFrame:
    df = _cases(spark, [(t,) for t, _ in SOLUTIONS], "operation string")
    return df.select("operation", evaluator.programmatic_solution(F.col("operation")).alias("solution"))


def correct_cases(spark: SparkSession, sf: str) -> DataFrame:
    df = _cases(spark, [r[:2] for r in ANSWERED], "operation string, output string")
    ok = T.numbers_equal(T.numeric_answer(F.col("output")), evaluator.value(F.col("operation")))
    return df.select("id", F.when(~T.is_completed(F.col("output")), "incomplete").when(ok, "true").otherwise("false").alias("correct"))


# --- whole columns --------------------------------------------------------------------------------------------------


def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in all outputs of the run."""
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet")
    pairs = a.select("answer_id", F.explode(T.generated_pairs(T.unescape_newlines(F.col("output")))).alias("p"))
    return pairs.groupBy("p.operation", "p.solution").agg(F.count("*").alias("n"), F.min("answer_id").alias("first_id"))


def number_answers(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/arithmetic_run_instant.parquet")
    return a.select("answer_id", T.to_number_only(F.col("output")).alias("number"))


def verdict_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").withColumn("v", T.verdict(F.col("text")))
    return d.select("doc_id", "v.keep", "v.confidence", "v.solution")


def judge_score_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.select("doc_id", T.judge_score(F.col("text")).alias("score"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The question of every held-out operation, and the one put to the judge of an answer."""
    h = spark.read.parquet(f"{sf}/eval_heldout_sample.parquet").where("operation is not null")
    return h.select("row_id", T.operation_prompt(F.col("operation")).alias("prompt"), T.judge_prompt(F.col("operation"), F.lit("7")).alias("judged"))


def age_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the training data by their age at the time of the latest one."""
    t = spark.read.parquet(f"{sf}/train_data.parquet").groupBy("added_at").agg(F.count("*").alias("n"))
    at = t.crossJoin(F.broadcast(t.agg(F.max("added_at").alias("now"))))
    return at.groupBy(T.age_label(F.col("added_at"), F.col("now")).alias("age")).agg(F.sum("n").alias("n"))


def _examples(spark: SparkSession, sf: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.where(F.length(T.strip(F.col("operation"))) > 0).select("example_id", "operation", "solution")


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The training data written as ordered CSV and read again: with optional solutions, with required ones, operations alone."""
    rows = _examples(spark, sf, "train_data")
    path = scratch(spark, "csv")
    writers.write_csv(rows, f"{path}/all", "example_id")
    writers.write_csv(rows.where(F.length(T.strip(F.col("solution"))) > 0), f"{path}/solved", "example_id")
    sides = {
        "all": readers.math_csv(spark, f"{path}/all"),
        "solved": readers.training_csv(spark, f"{path}/solved"),
        "operations": readers.operations_csv(spark, f"{path}/all").withColumn("solution", F.lit("-")),
    }
    counts = [df.groupBy(F.lit(n).alias("side"), "operation", "solution").agg(F.count("*").alias("n")) for n, df in sides.items()]
    return reduce(DataFrame.unionByName, counts)


def json_lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of history as text files: readable records and raw lines; a file that is missing has no count."""
    h = spark.read.parquet(f"{sf}/history.parquet").where("record is not null")
    path = scratch(spark, "lines")
    h.select(F.regexp_replace("record", r"[\r\n]", " ").alias("value")).write.mode("overwrite").text(f"{path}/records")
    ok = readers.json_lines(spark, f"{path}/records").agg(F.count("*").alias("readable"))
    raw = readers.lines(spark, f"{path}/records").agg(F.count("*").alias("lines"))
    none = readers.physical_rows(spark, f"{path}/missing").select(F.col("n").alias("missing"))
    return ok.crossJoin(raw).crossJoin(none)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"


def _canonical(x: str, tolerance: str = "1e-9") -> str:
    """Canonical text of the stripped text x without leading plus."""
    d = f"case when regexp_full_match({x}, '{T.WHOLE_FLOAT}') then try_cast({x} as double) end"
    near = f"round_even({d}, 0)"
    return f"case when abs({d} - {near}) <= {tolerance} and abs({d}) <= 9007199254740992 then cast(cast({near} as decimal(20,0)) as varchar) else ltrim({x}, '+') end"


_OUT = _strip(r"replace(replace(output, '\n', chr(10)), '\r', chr(13))")
_N = T.NUMBER_IN_TEXT
QUERIES = {
    f.__name__: f
    for f in (
        parse_cases, verdict_cases, judge_score_cases, number_cases, evaluator_functions, programmatic_solutions, correct_cases, parse_answers,
        number_answers, verdict_texts, judge_score_texts, prompts, age_labels, csv_round_trip, json_lines_round_trip,
    )
}
_OK = f"{_strip('operation')} <> ''"
SQL = {
    "age_labels": """with m as (select max(added_at) as now from train_data), t as (select added_at, round_even(epoch_us(now) / 1e6 - epoch_us(added_at) / 1e6, 0) as s from train_data, m)
select case when added_at is null then '' when s < 60 then concat(cast(floor(s) as bigint), 's ago') when s < 3600 then concat(cast(floor(s / 60) as bigint), 'm ago')
when s < 86400 then concat(cast(floor(s / 3600) as bigint), 'h ago') else strftime(added_at at time zone 'UTC', '%Y-%m-%d %H:%M:%SZ') end as age, cast(count(*) as bigint) as n from t group by 1""",
    "csv_round_trip": f"""with t as (select {_strip('operation')} as operation, coalesce({_strip('solution')}, '') as solution from train_data where {_OK})
select 'all' as side, operation, solution, count(*) as n from t group by all union all select 'solved', operation, solution, count(*) from t where solution <> '' group by all
union all select 'operations', operation, '-', count(*) from t group by all""",
    "json_lines_round_trip": """select count(*) filter (where case when json_valid(record) then json_type(record) = 'OBJECT' else false end) as readable, count(*) as lines, cast(null as bigint) as missing
from history where record is not null""",
    "parse_cases": _values([(i, k, o, s) for i, (_, ps) in enumerate(PARSED) for k, (o, s) in enumerate(ps)], ["id", "place", "operation", "solution"]),
    "verdict_cases": _values([(i, *r[2:]) for i, r in enumerate(VERDICTS)], ["id", "keep", "confidence", "solution", "high"]),
    "judge_score_cases": _values([(i, s) for i, (_, s) in enumerate(SCORES)], ["id", "score"]),
    "number_cases": _values([(i, s) for i, (_, s) in enumerate(NUMBERS)], ["id", "number"]),
    "evaluator_functions": _values(VALUES, ["operation", "value"]),
    "programmatic_solutions": _values(SOLUTIONS, ["operation", "solution"]),
    "correct_cases": _values([(i, r[2]) for i, r in enumerate(ANSWERED)], ["id", "correct"]),
    "parse_answers": rf"""with l as (select answer_id, unnest(regexp_split_to_array({_OUT}, '\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}\x1c-\x1e]')) as line from arithmetic_run_instant),
m as (select answer_id, {_strip(f"regexp_extract(line, '{T.LINE_PAIR}', 1)")} as operation, ltrim(regexp_extract(line, '{T.LINE_PAIR}', 2), '+') as s from l)
select operation, {_canonical('s')} as solution, count(*) as n, min(answer_id) as first_id from m where s <> '' and lower(operation) not in {T.LINE_HEADERS} group by 1, 2""",
    "number_answers": f"""with a as (select answer_id, {_OUT} as bare from arithmetic_run_instant),
b as (select *, {_strip("regexp_replace(bare, '^[*`\"'']+|[*`\"'']+$', '', 'g')")} as inside from a),
n as (select answer_id, case when regexp_full_match(bare, '{_N}') then bare when regexp_full_match(inside, '{_N}') then inside else regexp_extract_all(bare, '{_N}')[-1] end as x from b)
select answer_id, {_canonical('x', '0')} as number from n""",
    "verdict_texts": f"""with d as (select doc_id, lower(regexp_extract(text, '{T.VERDICT}', 1)) as v, lower(regexp_extract(text, '{T.CONFIDENCE}', 1)) as c,
ltrim(regexp_extract(text, '{T.FIXED_SOLUTION}', 1), '+') as s from documents where text is not null)
select doc_id, v = 'keep' as keep, case when c <> '' then c else 'low' end as confidence, case when s <> '' then {_canonical('s')} end as solution from d""",
    "judge_score_texts": rf"""with d as (select doc_id, regexp_extract(text, '{T.SCORE}', 1) as s,
list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w in {tuple(T.SCORE_WORDS)})[-1] as w from documents where text is not null)
select doc_id, cast(case when s <> '' then least(1.0, greatest(0.0, cast(s as double))) when w in ('yes', 'correct', 'true') then 1.0 else 0.0 end as double) as score from d""",
    "prompts": """with h as (select row_id, operation, concat('What is the result of ', operation, '? Give only the result.') as prompt from eval_heldout_sample where operation is not null)
select row_id, prompt, concat('You are grading a model''s answer to an arithmetic problem.
Solve the problem yourself, then decide whether the model''s answer is correct.
You are not given a reference answer — verify the result independently.
Ignore minor formatting differences (whitespace, trailing zeros, signs like +42).
If the model output contains reasoning, grade only the final numeric result.

Problem prompt: ', prompt, '
Expression: ', operation, '
Model answer: 7

Respond with <score>1</score> if the answer is correct, or <score>0</score> if incorrect.
Do not wrap any other text inside the score tags.') as judged from h""",
}
