from pyspark.sql import functions as F

from evalloom.operators import grouped as G
from evalloom.operators import ordered as O
from evalloom.operators.resampling import permutation_p, thompson


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "c string, verdict string, class string, author string")


def test_quorum_policies_and_gates(spark):
    rows = [("a", "PASS", "x", "m"), ("a", "PASS", "y", "n"), ("a", "FAIL", "x", "o"), ("b", "PASS", "x", "m"), ("b", "PASS", "y", "m"), ("c", "PASS", "x", "builtin:1"), ("c", "PASS", "y", "builtin:1"), ("d", "PASS", "x", "m"), ("e", "ERROR", None, None), ("e", "FAIL", None, None)]
    gate = lambda policy: {r.c: r.gate for r in G.policy_quorum(verdicts(spark, rows), "c", policy).collect()}
    assert gate("any_fail_veto") == {"a": "fails", "b": "duplicate_author", "c": "", "d": "too_few", "e": "fails"}
    assert gate("quorum_2of3")["a"] == "" and gate("majority")["a"] == "" and gate("majority")["e"] == "fails"


def test_strict_quorum_says_every_reason(spark):
    df = spark.createDataFrame([("a", True, "x"), ("a", False, ""), ("b", True, "x"), ("b", True, "y"), ("b", True, "z")], "c string, passed boolean, class string")
    got = {r.c: (r.accepted, r.reason) for r in G.strict_quorum(df, "c").collect()}
    assert got["b"] == (True, "accepted by quorum") and got["a"][0] is False and got["a"][1].count(";") == 3


def test_plurality_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("p", "x", 3), ("p", "y", 1), ("p", "x", 4), ("p", "y", 2), ("p", None, 0), ("q", "", 1)], "g string, a string, o long")
    (r,) = G.plurality(df, "g", "a", "o", intended=5).collect()
    assert (r.answer, r.votes, r.agreement) == ("y", 2, 0.4)


def test_mean_cosine_is_that_of_all_pairs(spark):
    v = [[1.0, 0.0], [0.6, 0.8], [0.0, 0.0], [1.0, 1.0]]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)] + [("h", 9, [1.0, 0.0]), ("g", 10, None)], "g string, i long, v array<double>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    pairs = [cos(v[i], v[j]) for i in range(4) for j in range(i)]
    (r,) = G.cosine_diversity(df, "g", "i", "v").collect()
    assert r.n == 4 and abs(r.mean_cosine - sum(pairs) / 6) < 1e-12
    (m,) = G.max_cosine(df.filter("v is not null"), "g", "i", "v").collect()
    assert abs(m.max_cosine - max(pairs)) < 1e-12


def test_streaks_and_recent(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, True), ("c", 1, False), ("c", 2, None)], "k string, o long, ok boolean")
    assert {r.k: r.streak for r in O.trailing_streak(df, "k", "o", "ok").collect()} == {"a": 2, "b": 0, "c": 2}
    assert {r.k for r in O.recent_all(df, "k", "o", "ok", 1).collect()} == {"b"}


def test_pooled_delta_equals_the_concatenation(spark):
    import statistics

    cycles = {1: [0.5, 1.0], 2: [], 3: [2.0, 2.5, 9.0], 4: [1.0]}
    rows = [(c, len(x), statistics.fmean(x) if x else 0.0, sum((v - statistics.fmean(x)) ** 2 for v in x) if x else 0.0) for c, x in cycles.items()]
    df = spark.createDataFrame(rows, "cycle long, n long, mean double, m2 double")
    for r in O.pooled_delta(df, "cycle", 3).collect():
        x = [v for c in range(r.cycle - 2, r.cycle + 1) for v in cycles.get(c, [])]
        assert r.n_total == len(x) and abs(r.delta - statistics.fmean(x)) < 1e-12 and abs(r.delta_se - (statistics.variance(x) / len(x)) ** 0.5) < 1e-12


def test_permutation_and_draws_are_deterministic(spark):
    rows = [("g", i >= 10, (5.0 if i >= 10 else 0.0) + i * 0.01, str(i)) for i in range(20)] + [("h", True, 1.0, "x")]
    df = spark.createDataFrame(rows, "g string, high boolean, v double, id string")
    one = {r.g: r.p_value for r in permutation_p(df, "g", "high", "v", "id", 500).collect()}
    assert one == {r.g: r.p_value for r in permutation_p(df.repartition(7), "g", "high", "v", "id", 500).collect()}
    assert one["g"] < 0.01 and one["h"] == 1.0
    c = spark.createDataFrame([("a", 100, 90), ("b", 100, 10)], "arm string, n long, wins long")
    assert {r.arm: r.picked for r in thompson(c, "arm", 1).collect()} == {"a": True, "b": False}


def test_calibration_of_a_perfect_and_a_useless_forecast(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, False), (None, True), (1.5, True)], "c double, y boolean")
    r = G.calibration(df, F.col("c"), F.col("y")).first()
    assert (r.n, r.ece, r.brier) == (2, 0.0, 0.0)


def test_percentiles_of_large_groups_are_exact(spark, monkeypatch):
    import random

    import numpy as np

    rnd = random.Random(6)
    groups = {"flat": [rnd.random() for _ in range(3000)], "hot": [7.0] * 2000 + [rnd.random() * 20 for _ in range(1500)], "few": [3.0, 1.0, None, 2.0], None: [5.0, 6.0]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    for small, accuracy in ((100_000, 10_000), (1000, 100)):
        monkeypatch.setattr(G, "SMALL", small)
        monkeypatch.setattr(G, "ACCURACY", accuracy)
        got = {r.g: r.q for r in G.percentiles(df, "g", "x", shares).collect()}
        for g, v in groups.items():
            assert np.allclose(got[g], np.quantile([x for x in v if x is not None], shares), atol=1e-12), (g, small)
    assert G.percentiles(df.limit(0), "g", "x", shares).count() == 0


def test_max_cosine_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 5))
    df = spark.createDataFrame([("a" if i < 100 else "b", i, x.tolist()) for i, x in enumerate(v)] + [("c", 500, [1.0] * 5), (None, 501, [1.0] * 5), ("a", 502, None)], "label string, id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = unit @ unit.T - 2 * np.eye(120)
    for block in (2048, 16):
        monkeypatch.setattr(G, "BLOCK", block)
        got = {r.label: r.max_cosine for r in G.max_cosine(df, "label", "id", "v").collect()}
        assert set(got) == {"a", "b"} and np.isclose(got["a"], c[:100, :100].max()) and np.isclose(got["b"], c[100:, 100:].max())


def test_trust_by_kills_references_and_bank(spark):
    rows = [("p", "reference", "r", True), ("p", "corruption", "c1", False), ("p", "corruption", "c2", True), ("q", "reference", "r", False), ("q", "corruption", "c2", False), ("s", "reference", "r", True), ("s", "bank", "b", True), ("s", "corruption", "c2", False), ("t", "reference", "r", True), ("t", "corruption", "c1", False), ("t", "bank", "b", False)]
    df = spark.createDataFrame(rows, "prop string, kind string, item string, passed boolean")
    got = {r.prop: (r.kill_rate, r.rejected != "", r.trust) for r in G.property_trust(df).collect()}
    assert got == {"p": (0.5, False, 0.5), "q": (1.0, True, 0.0), "s": (1.0, True, 0.0), "t": (1.0, False, 0.8)}
    r = G.collective_trust(df).first()
    assert (r.corruptions, r.caught_by_any, r.caught_by_trusted, r.kill_rate, r.trusted, r.passed) == (2, 2, 1, 0.5, 2, False)
