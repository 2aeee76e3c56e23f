import random

from pyspark.sql import functions as F

from evalloom.operators import keyed as K
from evalloom.operators.ordered import fold_column
from evalloom.operators.ranked import greedily_distinct, near_pairs, nearest, without_earlier_like


def test_latest_loses_and_fold_keeps_fields(spark):
    rows = [("k", 1, "a", None, False), ("k", 2, None, 5.0, True), ("p", 1, None, 7.0, True), ("p", 2, "b", None, None), ("r", 1, None, 1.0, True), ("r", 2, None, None, True), (None, 9, "z", None, False)]
    df = spark.createDataFrame(rows, "key string, seq long, name string, retired double, _patch boolean")
    assert {r.key: (r.name, r.retired) for r in K.latest(df, "key", "seq").collect()} == {"k": (None, 5.0), "p": ("b", None), "r": (None, None)}
    assert {r.key: (r.name, r.retired) for r in K.folded(df, "key", "seq", F.col("_patch"), ["retired"]).collect()} == {"k": ("a", 5.0), "p": ("b", None)}


def test_later_full_row_resets(spark):
    df = spark.createDataFrame([("k", 1, "a", None, False), ("k", 2, None, 5.0, True), ("k", 3, "c", None, False)], "key string, seq long, name string, retired double, _patch boolean")
    (r,) = K.folded(df, "key", "seq", F.col("_patch"), ["retired"]).collect()
    assert (r.name, r.retired) == ("c", None)


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 5, "z")], "k string, t long, n string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90)], "k string, t long, v long")
    assert {(r.n, r.v) for r in K.as_of_join(left, right, "k", "t", "v").collect()} == {("x", None), ("y", 50), ("z", None)}


def test_insert_if_absent_and_missing(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v long")
    rows = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5)], "k string, v long")
    assert {(r.k, r.v) for r in K.insert_if_absent(known, rows, "k", "v").collect()} == {("a", 1), ("b", 2)}
    assert K.missing(rows, known, "k").count() == 3


def test_preference_pairs_are_the_first_ones(spark):
    rows = [("p", i, i % 2 == 0, f"t{i // 4}") for i in range(12)]
    df = spark.createDataFrame(rows, "g string, o long, ok boolean, t string")
    got = [(r.chosen, r.rejected) for r in K.preference_pairs(df, "g", "o", "ok", "t").orderBy("pair_no").collect()]
    assert got == [("t0", "t1"), ("t0", "t2"), ("t1", "t0"), ("t1", "t2")]


def test_ordered_fold(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 5.0), ("a", 2, None)], "k string, o long, x double")
    r = fold_column(df, "k", "o", "x", F.lit(0.0), lambda acc, x: acc * 10 + F.coalesce(x, F.lit(2.0)), "f").first()
    assert r.f == 521.0


def test_near_pairs_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    sets = {i: sorted({rnd.randrange(12 if i % 3 else 40) for _ in range(rnd.randrange(0, 12))}) for i in range(80)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "i long, t array<string>")
    for t in (0.5, 0.85):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b])) - 1e-12}
        assert {(r.a, r.b) for r in near_pairs(df, "i", "t", t).collect()} == want


def test_ranked_pairs_against_all_pairs_whatever_the_groups(spark):
    rnd = random.Random(18)
    hot = [(k, 0, 1000.0 - k) for k in range(210)] + [(k, 1 + k % 2, 700.0 - k) for k in range(210, 220)]
    mixed = [(k, rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([None, 1.0, 2.0, 3.0])) for k in range(40)]
    for rows in (hot, mixed, [(k, k, float(k)) for k in range(30)], [(k, 7, float(k)) for k in range(9)], hot[:1], []):
        df = spark.createDataFrame(rows, "k long, g int, s double")
        order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        pairs = [(x[0], y[0], x[1] == y[1], i + 1, j + 1) for i, x in enumerate(order) for j, y in enumerate(order) if i < j]
        for most in (1, 6, 50):
            want = sorted(pairs, key=lambda p: p[2:])[:most]
            assert [tuple(r) for r in K.ranked_pairs(df, "k", "g", "s", most).collect()] == want, (len(rows), most)


def test_greedy_and_order_free_filters_against_brute_force(spark):
    rnd = random.Random(5)
    sets = {i: sorted({rnd.randrange(8) for _ in range(rnd.randrange(0, 9))}) for i in range(90)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()] + [(90, None)], "i long, t array<string>")
    like = lambda a, b: bool(a) and bool(b) and len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) - 1e-12
    kept = []
    for i in sets:
        if not any(like(sets[i], sets[j]) for j in kept):
            kept.append(i)
    assert sorted(r.i for r in greedily_distinct(df, "i", "t", 0.6).collect()) == [*kept, 90]
    free = [i for i in sets if not any(like(sets[i], sets[j]) for j in range(i))]
    assert sorted(r.i for r in without_earlier_like(df, "i", "t", 0.6).collect()) == [*free, 90] and len(free) < len(kept)


def test_nearest_in_blocks_and_before(spark, monkeypatch):
    from evalloom.operators import ranked

    rnd = random.Random(7)
    sets = {i: sorted({rnd.randrange(30) for _ in range(rnd.randrange(0, 12))}) for i in range(100)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "i long, t array<string>")
    bank = df.filter("i % 3 = 0").selectExpr("i", "t").unionByName(spark.createDataFrame([(None, ["1", "2"]), (None, None)], "i long, t array<string>"))
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    for size in (2000, 7):
        monkeypatch.setattr(ranked, "QUERY_BLOCK", size)
        got = {r.i: r.best for r in nearest(df.filter("i % 2 = 0"), bank, "i", "t", before="i").collect()}
        want = {i: max([sim(sets[i], [1, 2]), *[sim(sets[i], sets[j]) for j in range(0, i, 3)]]) for i in range(0, 100, 2)}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert nearest(df.limit(0), bank, "i", "t").count() == 0 and {r.best for r in nearest(df.limit(3), bank.limit(0), "i", "t").collect()} == {0.0}
