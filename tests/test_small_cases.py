from pyspark.sql import functions as F

from evalloom.functions import graders as G
from evalloom.functions import text as T
from evalloom.operators.totals import with_totals
from evalloom.sources import logs as L
from evalloom.streaming import live


def test_name_lines(spark):
    df = spark.createDataFrame([("- Graph Theory\n2) graph theory\n* Number-Theory\n!!\nx",), (None,), ("",)], "t string")
    assert [r.v for r in df.select(T.name_lines(F.col("t")).alias("v")).collect()] == [["graph_theory", "number_theory"], None, []]


def test_text_corruptions_are_deterministic(spark):
    df = spark.createDataFrame([("a", "Yes it is so"), ("b", "no"), ("c", "well then")], "i string, t string").select("i", F.inline(G.text_corruptions(F.col("t"), F.col("i"))))
    got = {(r.i, r.kind): r.mutated for r in df.collect()}
    assert got["a", "negated"] == "no Yes it is so" and got["b", "negated"] == "yes no" and got["c", "negated"] == "not well then"
    assert got["a", "reversed"] == "so is it Yes" and got["a", "empty"] == "" and sorted(got["a", "shuffled"].split()) == sorted("Yes it is so".split()) and ("b", "shuffled") not in got
    assert got == {(r.i, r.kind): r.mutated for r in df.repartition(3).collect()}


def test_contradictions(spark):
    df = spark.createDataFrame([(1, "The list is always sorted here. The list is never sorted here."), (2, "The list is sorted. A tree is wide."), (3, None)], "doc_id long, t string")
    assert {r.doc_id: r.conflicts for r in G.contradictions(df, "doc_id", "t").collect()} == {1: 1, 2: 0, 3: None}


def test_contradictions_of_any_two_sentences_names_and_steps(spark):
    far = "The list is always sorted here. A tree is wide. Nothing else matters; pi is 3.14 or so. The list is never sorted here. The list is never sorted here."
    quantified = "Every prime number divides it. Look closer. Some prime number does not divide it."
    values = "Let x = 3.5, y = 2 and z = 1/2.\nThen z = 0.5, y = 2 + 0, n == 4 and x = 3.25."
    chain = "Step 1: The sum of angles equals 180 degrees\nJustification: the sum of angles equals 180 degrees\nStep 2: Of 180 the third leaves 60\nJustification: subtract both\nStep 3: Bananas ripen quickly"
    df = spark.createDataFrame([(1, far), (2, quantified), (3, values), (4, chain), (5, None), (6, "")], "doc_id long, t string")
    got = {r.doc_id: (r.conflicts, r.reassigned, r.circular, r.ungrounded) for r in G.contradictions(df, "doc_id", "t").collect()}
    assert got == {1: (2, 0, 0, 0), 2: (1, 0, 0, 0), 3: (0, 1, 0, 0), 4: (0, 0, 1, 1), 5: (None,) * 4, 6: (0, 0, 0, 0)}


def test_bank_prefers_curated_and_holds_out_by_hash(spark):
    cur = spark.createDataFrame([("a", 2), ("b", 1), ("a", 3)], "prompt string, o long")
    gen = spark.createDataFrame([("b", 0, "easy")] + [(f"{d}{i}", i, d) for d in ("easy", "medium", "hard", "expert") for i in range(30)], "prompt string, o long, difficulty string")
    rows = L.difficulty_bank(cur, gen, "prompt", "o", 22, 0.0, 1).collect()
    assert {(r.prompt, r.tier) for r in rows if r.tier == 0} == {("a", 0), ("b", 0)} and len(rows) == 22
    made = [r.difficulty for r in rows if r.tier == 1]
    assert {d: made.count(d) for d in set(made)} == {"easy": 5, "medium": 8, "hard": 5, "expert": 2}
    held = L.difficulty_bank(cur, gen, "prompt", "o", 22, 0.6, 1).collect()
    assert {r.prompt: r.heldout for r in held} == {r.prompt: r.heldout for r in L.difficulty_bank(cur.repartition(3), gen, "prompt", "o", 22, 0.6, 1).collect()}
    assert sum(not r.heldout for r in held) == 22 and all(r.tier == 0 for r in held if r.heldout)
    assert len(L.difficulty_bank(cur, gen.limit(0), "prompt", "o", 22, 0.0, 1).collect()) == 2 and len(L.difficulty_bank(cur, gen, "prompt", "o", 1, 0.0, 1).collect()) == 1


def test_totals_beside_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert [(r.x, r.n, r.s) for r in with_totals(df, df.agg(F.count("*").alias("n"), F.sum("x").alias("s"))).orderBy("x").collect()] == [(1, 2, 3), (2, 2, 3)]
    assert with_totals(df.limit(0), df.agg(F.count("*").alias("n"))).count() == 0


def test_looks_stop_once_and_none_after(spark, tmp_path):
    rows = [("up", float(i % 3) + 5.0) for i in range(60)] + [("flat", float(i % 2) - 0.5) for i in range(60)] + [("few", 1.0)]
    spark.createDataFrame(rows, "run string, d double").write.parquet(str(tmp_path / "in"))
    s = live.follow(spark, str(tmp_path / "in"), "run string, d double")
    got = live.run_to_end(live.sequential_looks(s, "run", "d", 20), "looks", "append", str(tmp_path)).collect()
    assert sorted((r.run, r.look, r.decision) for r in got) == [("flat", 1, "continue"), ("flat", 2, "continue"), ("flat", 3, "continue"), ("up", 1, "stop_reject_null")]


def test_sessions_of_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 1L as u union all select timestamp'2024-01-01 00:10:00', 1 union all select timestamp'2024-01-01 02:00:00', 1").write.parquet(str(tmp_path / "in"))
    s = live.sessions(live.follow(spark, str(tmp_path / "in"), "ts timestamp, u long"), "ts", "u")
    assert sorted(r.n for r in live.run_to_end(s, "sessions_of_test", "complete", str(tmp_path)).collect()) == [1, 2]


def test_benchmarks_come_from_the_cache_then_the_source_then_the_fixture(spark, tmp_path):
    fixture = spark.createDataFrame([("f",)], "item string")
    source = spark.createDataFrame([("s",)], "item string")
    path = str(tmp_path / "c.jsonl")
    got = lambda load: [r.item for r in L.first_available(spark, path, "item string", load, fixture).collect()]
    assert got(lambda: source) == ["s"] and got(lambda: None) == ["f"]
    (tmp_path / "c.jsonl").write_text('{"item": "c"}\n{bad\n')
    assert got(lambda: source) == ["c"]


def test_intermediates_are_removed_on_release(spark):
    from pathlib import Path

    from evalloom import session

    t = session.materialize(spark.range(3).toDF("x"), "some")
    folder = Path(session.run_dir(spark).removeprefix("file://"))
    assert t.count() == 3 and any(folder.glob("some-*"))
    session.release(spark)
    assert not folder.exists()


def test_programs_are_edited_once_per_kind_and_never_run(spark):
    import ast

    source = "def f(x, n=3):\n    if x < n and n > 0:\n        return x + 1\n    return None"
    got = dict(G.edited_programs(source, 0))
    assert set(got) == {"comparison", "operator", "constant", "return"}
    plain = ast.unparse(ast.parse(source)).split("\n")
    for kind, new in got.items():
        assert sum(a != b for a, b in zip(plain, new.split("\n"), strict=True)) == 1, kind
    assert got == dict(G.edited_programs(source, 0)) and G.edited_programs("no program at all", 0) == [] == G.edited_programs(None, 1) and G.edited_programs("x", 0) == []
    df = spark.createDataFrame([(1, source), (2, None), (3, "raise SystemExit(1 +")], "i long, t string")
    assert {(r.i, r.kind) for r in G.program_corruptions(df, "i", F.col("t")).collect()} == {(1, k) for k in got}
