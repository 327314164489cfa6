import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import evaluator as E
from quillstone.functions import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


GOLDEN_KEYS = [("12+34", "34+12", True), ("gcd(48,18)", "gcd(18,48)", True), ("3*4.0", "4*3", True), ("Fib(7)", "fib(7)", True), ("5!", "5 !", True), ("12-34", "34-12", False), ("comb(5,2)", "comb(2,5)", False)]


@pytest.mark.parametrize(("a", "b", "same"), GOLDEN_KEYS)
def test_syntax_keys(a, b, same):
    assert (E.syntax_key(a) == E.syntax_key(b)) == same


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("2+2", 4), ("5!", 120), ("(2+1)!", 6), ("fib(10)!", None), ("3!!", 720), ("7//2", 3), ("-7%3", 2), ("2^10", 1024), ("comb(5,2)+C(5,2)", 20), ("gcd(12,18,8)", 2),
        ("lcm(4,0)", 0), ("round(2.5)", 2), ("sigma(6)", 12), ("phi(10)+totient(9)", 10), ("prime_count(10)", 4), ("nth_prime(5)", 11), ("digit_product(0)", 0), ("reverse_digits(-120)", -21),
        ("sqrt(2)^2", None), ("1/0", None), ("max()", None), ("__import__('os')", None), ("a+1", None), ("", None), ("9" * 201, 1e201), ("1" * 400, None), ("4.0!", None), ("fact (3)!", 720), ("sigma(" + "9" * 30 + ")", None), ("factorial(21)", None),
        ("2^41", None), ("(-8)^0.5", None), ("isqrt(17)", 4), ("mod(7,-3)", -2),
    ],
)
def test_evaluator(text, value):
    got = E.evaluate(text)
    if text == "sqrt(2)^2":
        assert math.isclose(got, 2.0)
    elif value is None:
        assert got is None
    else:
        assert got == value


def test_evaluator_against_python(spark):
    rng = random.Random(5)
    ops = []
    for _ in range(200):
        a, b, c = (rng.randint(1, 50) for _ in range(3))
        ops.append(f"({a}{rng.choice('+-*')}{b}){rng.choice('+-*/')}{c}")
    df = spark.createDataFrame([(o,) for o in ops], "o string")
    got = {r["o"]: r["v"] for r in df.select("o", E.value(F.col("o")).alias("v")).collect()}
    assert all(math.isclose(got[o], eval(o)) for o in ops)


def test_numbers_in_text(spark):
    assert one(spark, T.last_number, "the answer is 1,000", "5-3", "none", None) == ["000", "-3", None, None]
    assert one(spark, T.to_number_only, "**42**", " 7 ", "1e5", "about 3.5 or 4") == ["42", "7", "5", "4"]
    assert one(spark, T.numeric_answer, "42d", "1e5", "3.", "x 2.5 y 7") == [42.0, 100000.0, 3.0, 7.0]
    assert one(spark, T.canonical_solution, "+4.0", "2.50", "abc", "4.0000000001") == ["4", "2.50", "abc", "4"]
    assert one(spark, T.is_completed, "", " \\n ", None, "x") == [False, False, False, True]
    assert one(spark, T.confidence_is_high, " HIGH", "0.8", "0.79", "8d", None) == [True, True, False, False, False]
    assert one(spark, T.judge_score, "<score>1</score>", "<score>0.5</score>", "yes", "incorrect", "", "<score>1.5</score>", "no, then Yes") == [1, 0.5, 1, 0, 0, 1, 1]
    assert one(spark, lambda c: T.unescape_newlines(T.escape_newlines(c)), "a\r\nb\rc\n") == ["a\nb\nc\n"]


def test_verdict_and_pairs(spark):
    v = one(spark, T.verdict, "<verdict>KEEP</verdict><confidence> High </confidence><solution> 42.0 </solution>", "nothing")
    assert [tuple(x) for x in v] == [(True, "high", "42"), (False, "low", None)]
    js = one(spark, T.generated_pairs, 'x [{"operation":"5-5","solution":0},{"expr":"1+1","answer":"2"},3] y', "<example>operation: 1+2 solution: 3.0</example>", "- 3+4 = 7\noperation, solution", "nothing")
    assert [[tuple(p) for p in x] for x in js] == [[("1+1", "2")], [("1+2", "3")], [("3+4", "7")], []]


def test_labels_and_prompts(spark):
    at = lambda c: F.to_timestamp(c)
    label = lambda c: T.age_label(at(c), F.lit("2024-05-02 00:00:00").cast("timestamp"))
    got = one(spark, label, "2024-05-01 23:59:30", "2024-05-01 23:01:00", "2024-05-01 01:00:00", "2024-04-01 01:02:03", None)
    assert got == ["30s ago", "59m ago", "23h ago", "2024-04-01 01:02:03Z", ""]
    assert one(spark, T.operation_prompt, "1+2") == ["What is the result of 1+2? Give only the result."]
    assert "Expression: 1+2\nModel answer: 3\n\nRespond" in one(spark, lambda c: T.judge_prompt(c, F.lit("3")), "1+2")[0]
