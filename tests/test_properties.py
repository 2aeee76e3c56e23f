import pytest

from evalloom.operators import properties as P


def test_checks_and_errors(spark):
    df = spark.createDataFrame([(1, "p", "def f(x):\n    return (x)"), (2, "p", "def f(x:"), (3, "same  text", "Same text"), (4, None, None)], "i long, prompt string, c string")
    got = {(r.ident, r.property): r.verdict for r in P.apply_checks(df, "i", "prompt", "c").collect()}
    assert (got[1, "parses"], got[2, "parses"], got[2, "brackets_balance"], got[3, "not_the_prompt"], got[4, "not_empty"]) == ("PASS", "FAIL", "FAIL", "FAIL", "FAIL")
    with pytest.raises(KeyError):
        P.apply_checks(df, "i", "prompt", "c", ["no such check"])


def test_coercion_and_registration():
    assert [P.coerce(x) for x in (True, (False, "r"), "pass", ("ERROR", 1), 7)] == [("PASS", ""), ("FAIL", "r"), ("PASS", ""), ("ERROR", "1"), ("ERROR", "unrecognised result of type int")]
    with pytest.raises(ValueError):
        P.register("parses", "x")(lambda p, c: True)


def test_equivalence_of_expressions():
    assert P.equivalent("2*(x+1)", "2x+2") is None  # no arithmetic expression as written
    assert P.equivalent("2*(x+1)", "2*x + 2") is True
    assert P.equivalent("x^2", "x*x") is True and P.equivalent("x", "y") is False
    assert P.equivalent("sqrt(x^2)", "x") is False and P.equivalent("1/0", "1/0") is None
    assert P.equivalent("__import__('os')", "1") is None and P.equivalent(None, "1") is None
    assert P.equivalent("9**9**9**9", "1") is None or P.equivalent("9**9**9**9", "1") is False
