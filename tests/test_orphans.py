import random

from evalloom.operators import orphans as O

REFS = "src_table string, ref_field string, src_seq long, target string, key string, t double, spread int, part string"
PARENTS = "target string, key string, first double, gone double, salt int"


def brute(refs, parents):
    known = {(p[0], p[1]): p for p in parents if p[1] is not None}
    out = []
    for r in refs:
        if r[4] is None:
            continue
        p = known.get((r[3], r[4]))
        kind = "missing" if p is None else "deleted" if None not in (p[3], r[5]) and p[3] <= r[5] else "late" if None not in (p[2], r[5]) and p[2] > r[5] else None
        if kind:
            out.append((r[0], r[1], r[2], kind))
    return sorted(out)


def test_against_brute_force_with_hot_key_nulls_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(O, "PROBES", 50)
    rnd = random.Random(1)
    parents = [("p", f"k{i}", rnd.choice([1.0, 5.0, 9.0, None]), rnd.choice([None, 4.0, 5.0]), 0) for i in range(150)]
    refs = [("s", "f", n, "p", rnd.choice(["k7", f"k{rnd.randrange(300)}", None, ""]), rnd.choice([5.0, None, 3.0]), 1, "x") for n in range(600)]
    refs += [("s", "f", n, "q", "k1", 5.0, 1, "x") for n in range(600, 610)]
    got = O.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted((r.src_table, r.ref_field, r.src_seq, r.orphan_kind) for r in got.collect()) == brute(refs, parents)


def test_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    assert O.orphans(none, spark.createDataFrame([], PARENTS)).count() == 0
    one = spark.createDataFrame([("s", "f", 1, "p", "k", 5.0, 1, "x")], REFS)
    assert [r.orphan_kind for r in O.orphans(one, spark.createDataFrame([], PARENTS)).collect()] == ["missing"]


def test_month_is_utc_and_report_counts(spark):
    df = spark.createDataFrame([("s", "f", "late", 1769903999.5), ("s", "f", "late", 1769904000.0), ("s", "f", "late", None)], "src_table string, ref_field string, orphan_kind string, t double")
    r = O.report(df.withColumn("ref_month", O.month(df["t"]))).collect()
    assert {(x.ref_month, x.n) for x in r} == {("2026-01", 1), ("2026-02", 1), (None, 1)}
