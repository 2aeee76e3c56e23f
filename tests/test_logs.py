import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalloom.sources import logs as L
from evalloom.sources import sinks as W


def test_policies_for_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": NaN}\n{"x": 2, "more": 1}\n')
    assert L.read_lines(spark, str(tmp_path / "a.jsonl"), "x double").count() == 3
    assert L.read_lines(spark, str(tmp_path / "none.jsonl"), "x double").count() == 0
    rows = spark.createDataFrame([("f", 1, '{"x": 1}'), ("f", 2, "{bad"), ("f", 3, '{"x": 3}'), ("g", 1, '{"x": 4}')], "f string, n int, body string")
    assert {(r.f, r.x) for r in L.read_prefix(rows, "body", "x int", "n", "f").collect()} == {("f", 1), ("g", 4)}
    assert [r.x for r in L.typed(rows.filter("f = 'g'"), "body", {"x": "int"}, ["x"]).collect()] == [4]


def test_folder_layouts(spark, tmp_path):
    assert L.latest_folder(spark, str(tmp_path)) == (None, str(tmp_path))
    for n in ("cycle_2", "cycles/10", "cycles/3"):
        (tmp_path / n).mkdir(parents=True)
    assert L.latest_folder(spark, str(tmp_path))[0] == 10 and L.latest_folder(spark, str(tmp_path), 3)[1].endswith("cycles/3")


def test_guard_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "i long, ok boolean")
    with pytest.raises(PySparkException):
        W.append_guarded(df, str(tmp_path / "g"), "ok")
    W.snapshot(df, str(tmp_path / "s"))
    W.snapshot(df.filter("ok"), str(tmp_path / "s"))
    assert W.read_snapshot(spark, str(tmp_path / "s")).count() == 1
    with pytest.raises(ValueError):
        W.append_log(df, str(tmp_path), "no_such_sink")
    assert "| 1 | True |" in W.markdown("t", {"s": df})


def test_fresh_and_cutoff(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 900.0)], "i long, at double")
    none = df.limit(0)
    assert [r.i for r in L.fresh_or_fallback(df, "at", 1000.0, 200 / 86400, none).collect()] == [2]
    assert L.fresh_or_fallback(df, "at", 1e9, 1, none).count() == 2
    assert [r.i for r in L.fresh_or_fallback(none, "at", 1000.0, 1, df.filter("i = 1")).collect()] == [1]
    r = spark.createDataFrame([("2026-01-02",), ("2025-01-01",), ("soon",), (None,)], "t string").select(L.after_cutoff(F.col("t"), "2026-01-01").alias("v")).collect()
    assert [x.v for x in r] == [True, False, False, False]


def test_generators_are_deterministic(spark):
    assert L.generated(spark, 50, 1, 2).collect() == L.generated(spark, 50, 1, 2).repartition(5).orderBy("id").collect()
    assert L.generated(spark, 60, 1, 2).groupBy("category").count().filter("count = 10").count() == 6
