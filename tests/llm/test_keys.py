import pytest

from quillstone.llm.opkey import operation_keys
from quillstone.llm.spelling import with_spelling

SAME_SPELLING = [
    ("fib(7)*3", " FIB ( 7 ) × 3 "), ("1592", "1,592"), ("2887", "2'887"), ("3+4", "**3 ＋ 4**"), ("3^4", "3**4"), ("max(3371,33757)", "'max(3371; 33757)'"),
    ("22758", "= 22758."), ("(1+2)*3", "\\((1+2)*3\\)"), ("5+6", "[(5+6)] = ?"), ("7", "+7"), ("8/2", "8÷2 …"), ("digit_sum(12_345)", "digit_sum(12345)﻿"),
    ("", "``"), ("-5", "−5"), ("7+1", "=(=(=(=(7+1)=)=)=)="), ("7+1", "((((([[7+1]]))=)=)?)"), ("9614", "9 614"),
]
OTHER_SPELLING = [("3+4", "4+3"), ("4", "4.0"), ("max(12,3)", "max(1,23)"), ("5-3", "5+3"), ("1.5", "15"), ("(1+2)*(3+4)", "1+2)*(3+4"), ("-5", "5"), ("5!", "5"), ("max(1,234)", "max(1234)")]


def test_spelling(spark):
    rows = [*SAME_SPELLING, *OTHER_SPELLING]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    got = {r["i"]: (r["x"], r["y"]) for r in with_spelling(df, {"x": "a", "y": "b"}).collect()}
    for i, (a, b) in enumerate(rows):
        assert (got[i][0] == got[i][1]) == (i < len(SAME_SPELLING)), (a, b, got[i])


def test_spelling_of_null_and_very_long(spark):
    long = "(" + "+".join(["1"] * 30000) + ")"
    df = spark.createDataFrame([(None,), (long,)], "a string")
    got = [r["x"] for r in with_spelling(df, {"x": "a"}).collect()]
    assert got == ["", long[1:-1]]


SAME_COMPUTATION = [
    ("12+34", "34 + 12"), ("gcd(48,18)", "gcd(18;48)"), ("2^10", "2**10"), ("3*4.0", "4*3"), ("(a)", "A"), ("What is (3+(4*5))?", "5*4+3"), ("1_000", "1,000.00"),
    ("min(3,1,2)", "MIN(1, 2, 3)"), ("-(5)", "-5"), ("Work out 5!-2", "(5)! − 2"), ("((2-3)-4)", "2-3-4"), ("2^3^2", "2^(3^2)"), ("-2^2", "-(2^2)"),
]
OTHER_COMPUTATION = [
    ("12-34", "34-12"), ("comb(5,2)", "comb(2,5)"), ("2^10", "10^2"), ("(1+2)+3", "1+(2+3)"), ("2-(3-4)", "2-3-4"), ("C(5,2)", "comb(5,2)"), ("5!", "factorial(5)"), ("(2^3)^2", "2^3^2"),
    ("12+34", "12+35"), ("6/3", "6//3"),
]


@pytest.mark.parametrize(("pair", "same"), [*((p, True) for p in SAME_COMPUTATION), *((p, False) for p in OTHER_COMPUTATION)])
def test_operation_keys(pair, same):
    a, b = (operation_keys(x) for x in pair)
    assert ((a[0] or a[1]) == (b[0] or b[1])) == same


def test_operation_keys_without_operation():
    assert operation_keys(None) == operation_keys("  ") == operation_keys("``") == (None, None)
    deep = "(" * 3000 + "1" + ")" * 3000 + "+2"
    assert operation_keys(deep)[0] == operation_keys("2+1")[0]
    assert len(operation_keys("+".join(["12"] * 20000))[0]) < 300
