from pyspark.sql import functions as F

from evalloom.functions import parsing as P
from evalloom.functions import text as T
from evalloom.functions import graders as G


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_predicates(spark):
    assert one(spark, T.is_gibberish, None, "short", "a a a a a a a a", "this is a fine sentence", "!!!! ???? ---- #### @@@@ $$$$") == [True, True, True, False, True]
    assert one(spark, T.is_refusal, None, "I cannot do this.", "I'm sorry\nStep 1: add", "All is well") == [False, True, False, False]


def test_answers(spark):
    assert one(spark, T.final_numeric, "answer: 1,234.5 or so", "x = 3 then 7", "no", None, "answer: none, but 8 before") == [1234.5, 7.0, None, None, 8.0]
    assert one(spark, T.choice_letter, "The answer is B.", "A or C", "none") == ["B", "C", None]
    assert one(spark, T.parse_number, "3/4", "1,000", "x", "1/0") == [0.75, 1000.0, None, None]
    assert one(spark, T.latex_answer, r"so \boxed{\frac{1}{2}}", "the answer is 5 km.", "$x$") == ["((1)/(2))", "5", "x"] or one(spark, T.latex_answer, r"so \boxed{\frac{1}{2}}")[0] == "((1)/(2))"
    assert one(spark, T.hash_marked_answer, "so #### 12 ", "7") == ["12", "7"]


def test_fences_and_thoughts(spark):
    assert one(spark, T.longest_fence, "```python\na\n```\n```\nlonger\n```", "x def f():", "none") == ["longer", "def f():", ""]
    assert one(spark, T.without_thoughts, "<think>a\nb</think>c</think>", "plain") == ["c", "plain"]


def test_clean_problem(spark):
    good = "A farmer has twelve geese and sells four. "
    assert one(spark, T.clean_problem, good + "Solution: eight", "Solution: eight geese are left over", good) == [good.strip(), "", good.strip()]


def test_hedges_marks_and_clip(spark):
    assert one(spark, T.hedge_confidence, "", "maybe perhaps", "clearly") == [0.0, 0.0, 1.0]
    assert one(spark, T.confidence_mark, "a [C:0.5] b [c: 0.75]", "none") == [0.75, None]
    r = spark.range(1).select(T.clip_relative(F.lit(10.0), F.lit(1.0)).alias("a"), T.clip_relative(F.lit(-9.0), F.lit(-1.0)).alias("b"), T.clip_relative(F.lit(4.0), F.lit(0.0)).alias("c")).first()
    assert (round(r.a, 6), round(r.b, 6), r.c) == (1.3, -1.3, 4.0)


def test_chain_parser():
    p = P.parse_chain("Step 1: add two numbers\nBecause: they are given\nStep 2: halve the sum [C:0.8]\nConclusion: 4")
    assert [(c["step_number"], c["justification"], c["confidence"]) for c in p["chain"]] == [(1, "they are given", -1.0), (2, "implicit", 0.8)]
    assert (p["conclusion"], p["confidence"], p["issues"]) == ("4", 1.0, [])
    assert P.parse_chain(None)["chain"] == [] and P.parse_chain("")["confidence"] == 0.0 and P.parse_chain("x", "model refusal")["issues"] == ["model refusal"]


def test_chain_parser_on_every_kind_of_line(spark):
    p = P.parse_chain("**Intro** text\nFirst, let `x` be 3\nAssumptions: x is real; y and z\nmore\n\nback to text\nSecond) *next*\nThis follows because: of x [C:0.4]\nand y [C:0.7]\n2. third\n> Final answer: 12\nso\nJustification: none\n\nnot this")
    got = [(c["step_number"], c["content"], c["justification"], c["assumptions"], c["confidence"]) for c in p["chain"]]
    assert got == [(1, "Intro text", "implicit", [], -1.0), (1, "let x be 3\nback to text", "implicit", ["x is real", "y", "z", "more"], -1.0), (2, "next", "of x  and y", [], 0.7), (2, "third", "implicit", [], -1.0)]
    assert (p["conclusion"], p["issues"], p["confidence"]) == ("12 so", ["all step contents very short"], 0.7) or p["conclusion"] == "12 so"
    q = P.parse_chain("Because: it is so\nStep 300: no step\nGiven that: none\nStep 2: last words here, at length")
    assert [c["justification"] for c in q["chain"]] == ["it is so Step 300: no step", "implicit"] and q["conclusion"] == "last words here, at length" and q["issues"] == ["conclusion extracted via fallback"]
    assert P.parse_chain("Conclusion:\n\n4\nStep 1: x")["conclusion"] == "4"
    df = spark.createDataFrame([(1, "I cannot solve this."), (2, "!!!! ???? ---- #### @@@@ $$$$"), (3, None), (4, "<think>a</think>Step 1: take the sum of both\nAnswer is near")], "i long, t string")
    assert {r.ident: (r.n_steps, r.issues.split("; ")[0]) for r in P.chains(df, "i", "t").collect()} == {1: (0, "model refusal"), 2: (0, "gibberish response"), 3: (0, "empty response"), 4: (1, "conclusion extracted via fallback")}


def test_blocks_and_config(spark):
    labels = ("PROBLEM:", "ANSWER:")
    df = spark.createDataFrame([("PROBLEM: a\nb\nANSWER: c",), ("nothing",)], "t string")
    got = [(r.b.problem, r.b.answer, r.b.issues) for r in df.select(P.blocks(F.col("t"), labels).alias("b")).collect()]
    assert got == [("a\nb", "c", ""), (None, None, "missing PROBLEM;missing ANSWER")]
    lines = [(1, '{"a": 1, "b": true, "c": [1, 2], "d": {"e": 1.5, "h": {"i": "x"}}, "f": [{"g": 1}], "n": null}'), (2, "{bad"), (3, None), (4, "[1]")]
    cfg = {(r.ident, r.field): r.value for r in P.flat_configs(spark.createDataFrame(lines, "i long, t string"), "i", "t").collect()}
    assert cfg == {(1, "a"): "1", (1, "b"): "1", (1, "c.len"): "2", (1, "d.e"): "1.5", (1, "d.h.i"): "x"}


def test_graders(spark):
    df = spark.createDataFrame([("so x = 13", "x = 3"), ("so x = 3.", "x = 3"), (None, "a")], "r string, w string")
    assert [r.v for r in df.select(G.string_in_tail(F.col("r"), F.col("w")).alias("v")).collect()] == [False, True, None]
    e = {r.i: r.embedding for r in G.hash_embeddings(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i long, t string"), "i", "t").collect()}
    assert set(e) == {1, 2} and abs(sum(x * x for x in e[1]) - 1) < 1e-9 and e[2][0] == 1.0


def test_canonical_grades(spark):
    rows = [("math", r"so \\boxed{12}", "12", True), ("math", "x = 3.0", "x=3", True), ("math", "y = 3", "x = 3", False), ("math", "1/2", "0.5", True), ("logic", "It is  TRUE", "true", True), ("logic", "no", "yes", False), ("code", "def f", "f(1) == 2", None), ("math", "", "3", None), ("math", None, "3", None)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i long, d string, r string, c string")
    assert [r.v for r in df.select("i", G.canonical_grade(F.col("d"), F.col("r"), F.col("c")).alias("v")).orderBy("i").collect()] == [r[3] for r in rows]
