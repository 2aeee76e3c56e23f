import glob
import random
from itertools import combinations

from evalloom import session
from evalloom.operators import prefixes as P


def test_unlike_sets_of_common_tokens_are_no_candidates(spark, monkeypatch):
    """Every token is common here, so most sets share one of a prefix; only pairs near the threshold may be written."""
    rnd = random.Random(3)
    sets = {i: set(rnd.sample(range(60), rnd.randrange(15, 25))) for i in range(150)}
    sets |= {1000 + i: sets[i] - {min(sets[i])} for i in range(20)}
    df = spark.createDataFrame([(i, [str(x) for x in s], i % 2 == 0) for i, s in sets.items()], "i long, t array<string>, old boolean")
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for cell, chunk in ((4096, 60_000), (7, 50)):
        monkeypatch.setattr(P, "CELL", cell)
        monkeypatch.setattr(P, "CHUNK", chunk)
        got = {(r.a, r.b) for r in P.prefix_pairs(df, "i", "t", 0.85).collect()}
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if sim(a, b) >= 0.85}
        assert len(want) >= 20 and want <= got and len(got) < 2 * len(want)
        assert {(r.a, r.b) for r in P.prefix_pairs(df, "i", "t", 0.85, "old").collect()} == {(a, b) for a, b in got if a % 2 or b % 2}


def test_written_intermediates_leave_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folder for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    t = session.materialize(spark.range(20_000).repartition(5, "id").groupBy("id").count(), "some")
    left = files() - before
    assert t.count() == 20_000 and not left


def test_the_filter_leaves_only_its_own_last_shuffles(spark, monkeypatch):
    """The links are written before the result is asked for, so that candidates are not formed in the plan that is returned."""
    from evalloom.operators.ranked import without_earlier_like

    df = spark.createDataFrame([(i, [f"w{x}" for x in range(20) if x != i % 7]) for i in range(50)], "i long, t array<string>")
    kept = without_earlier_like(df, "i", "t", 0.85)
    assert "MapInArrow" not in kept._jdf.queryExecution().toString() and [r.i for r in kept.collect()] == [0]
