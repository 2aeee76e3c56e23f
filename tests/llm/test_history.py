import random

from evalloom.llm import history as H
from evalloom.llm.words import words

SCHEMA = "seq long, session_id string, problem_id string, problem_text string, proposed_at double, turn string, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], SCHEMA)


def sets(text):
    w = words(text or "")
    return frozenset(zip(w, w[1:], w[2:]))


def brute(rows, threshold):
    began = {}
    for s, _, _, at in rows:
        if s is not None:
            began[s] = min(began.get(s, float("inf")), float("inf") if at is None else at)
    accepted, cases = [], set()
    for s in sorted(began, key=lambda s: (began[s], s)):
        new = []
        for r in rows:
            if r[0] == s and sets(r[2]):
                x = sets(r[2])
                if any(len(x & y) >= threshold * len(x | y) for y in accepted):
                    cases.add((s, r[1]))
                else:
                    new.append(x)
        accepted += new
    return cases


def test_chains_of_copies_against_brute_force(spark):
    rnd = random.Random(4)
    texts = []
    rows = []
    for i in range(150):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(0, 7)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            t = " ".join(w)
        else:
            t = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(40))
        texts.append(t)
        rows.append((f"s{rnd.randrange(12)}", f"p{i}", t, float(rnd.randrange(100))))
    rows += [("s0", "n", None, 1.0), (None, "m", texts[0], 0.0), ("late", "q", texts[0], None), ("s1", "short", "two words", 3.0)]
    for n in (1, 3):
        got = {(r.session_id, r.problem_id) for r in H.repeated_problems(table(spark, rows), k=3, threshold=0.5, n_waves=n).collect()}
        assert got == brute(rows, 0.5)


def test_batches_one_by_one(spark, tmp_path):
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(16):
        w = list(base)
        for _ in range(rnd.randrange(0, 14)):
            w[rnd.randrange(40)] = f"n{rnd.randrange(10**6)}"
        rows.append((f"s{i // 4}", f"p{i}", " ".join(w).upper() if i % 3 else ", ".join(w), float(i)))
    x = H.HistoryIndex(spark, f"file://{tmp_path}", "one_by_one", buckets=2, k=3, threshold=0.5)
    t = table(spark, rows).drop("turn").join(H.batch_order(table(spark, rows)), "session_id")
    got = set()
    for s in ("s0", "s1", "s2", "s3"):
        got |= {(r.session_id, r.problem_id) for r in x.admit(t.filter(f"session_id = '{s}'"), s).collect()}
    assert got == brute(rows, 0.5) and got
    held = spark.table("one_by_one_sets").count()
    again = x.admit(t.filter("session_id = 's3'"), "again")
    assert again.count() == 4 and spark.table("one_by_one_sets").count() == held  # what was fed before is known and adds nothing


def test_a_barred_text_bars_nobody(spark):
    a = " ".join(f"ax{i}" for i in range(60))
    b = " ".join([*a.split()[:45], *(f"b{i}" for i in range(15))])
    c = " ".join([*b.split()[10:], *(f"c{i}" for i in range(10))])
    rows = [("s1", "a", a, 1.0), ("s2", "b", b, 2.0), ("s3", "c", c, 3.0), ("s4", "c2", c, 4.0)]
    got = {r.problem_id for r in H.repeated_problems(table(spark, rows), k=3, threshold=0.5).collect()}
    assert got == {x for _, x in brute(rows, 0.5)} == {"b", "c2"}


def test_coverage_and_empty(spark):
    rows = [("s1", "a", "One two three. Four five.", 1.0), ("s2", "b", "Four, FIVE! New words here.", 2.0), ("s2", "c", "one two three four five", 2.5), ("s3", "d", None, 3.0), ("s3", "e", "?!", 3.0)]
    got = {r.problem_id: (r.full_copy, r.n_words, r.seen_words) for r in H.coverage(table(spark, rows)).collect()}
    assert got == {"a": (False, 5, 0), "b": (False, 5, 2), "c": (True, 5, 0)}
    none = table(spark, [])
    assert H.coverage(none).count() == 0 and H.repeated_problems(none, k=3, threshold=0.5).count() == 0


def test_coverage_does_not_depend_on_the_waves(spark):
    rnd = random.Random(12)
    lines = [f"line {i} has its own words" for i in range(25)]
    rows = [(f"s{rnd.randrange(6)}", f"p{i}", ". ".join(rnd.sample(lines, rnd.randrange(1, 5))), float(rnd.randrange(9))) for i in range(60)]
    began = {}
    for s, _, _, at in rows:
        began[s] = min(began.get(s, at), at)
    turn = {s: (b, s) for s, b in began.items()}
    want = {}
    for s, p, t, _ in rows:
        before = [x for x in rows if turn[x[0]] < turn[s]]
        seen = {q for x in before for q in x[2].split(". ")}
        want[p] = (any(x[2] == t for x in before), 6 * len(t.split(". ")), 6 * sum(q in seen for q in t.split(". ")))
    for n in (1, 2, 5):
        assert {r.problem_id: (r.full_copy, r.n_words, r.seen_words) for r in H.coverage(table(spark, rows), n_waves=n).collect()} == want


def test_index_is_incremental_and_probes_without_shuffling_the_history(spark, tmp_path):
    x = H.HistoryIndex(spark, f"file://{tmp_path}", "h1", buckets=4)
    one = spark.createDataFrame([("a", "First line. Second line."), ("b", None)], "id string, t string")
    two = spark.createDataFrame([("c", "first line! third line"), ("d", "First line; second line")], "id string, t string")
    assert all(not r.full_copy and r.seen_words == 0 for r in x.probe(one, "id", "t").collect())
    for _ in range(2):
        x.append(one, "t", "one")
    assert spark.table("h1_content").count() == 1 and spark.table("h1_paragraphs").count() == 2
    got = {r.ident: (r.full_copy, r.n_words, r.seen_words) for r in x.probe(two, "id", "t").collect()}
    assert got == {"c": (False, 4, 2), "d": (True, 4, 0)}
    lines = x._known(two.select(H.content_hash("t").alias("hash")), "content")._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "h1_content" in line)
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    # the last shuffle is on the batch's side: its rows come from between it and the history's scan
    assert "Bucketed: true" in lines[at] and max(shuffles) < at and any("ExistingRDD" in line or "LocalTableScan" in line for line in lines[max(shuffles) : at])
    x.append(two, "t", "two")
    assert {r.batch for r in spark.table("h1_paragraphs").collect()} == {"one", "two"}
