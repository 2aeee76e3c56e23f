from itertools import combinations

from evalloom.operators.pairs import pairs_within


def test_all_pairs_of_small_and_hot_groups_in_cells(spark):
    rows = [("hot", i) for i in range(90)] + [("two", 1000), ("two", 1001), ("one", 5), (None, 7), (None, 8)]
    df = spark.createDataFrame(rows + rows[:5], "k string, i long")
    got = {(r.a, r.b) for r in pairs_within(df, "k", "i", cell=7).collect()}
    assert got == set(combinations(range(90), 2)) | {(1000, 1001)}


def test_carried_columns_follow_their_side(spark):
    df = spark.createDataFrame([("g", 2, "x"), ("g", 1, "y")], "k string, i long, v string")
    (r,) = pairs_within(df, "k", "i", ("v",)).collect()
    assert (r.a, r.b, r.v_a, r.v_b) == (1, 2, "y", "x")


def test_empty_table(spark):
    assert pairs_within(spark.createDataFrame([], "k string, i long"), "k", "i").count() == 0
