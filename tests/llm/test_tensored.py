import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import tensored as X
from evalloom.llm.words import shingle_sets, words


def brute(rows, k, threshold):
    sets = {}
    for owner, text in rows:
        if owner is not None and text is not None:
            w = words(text)
            s = frozenset(zip(*(w[i:] for i in range(k))))
            if s:
                sets.setdefault(owner, set()).add(s)
    out = set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def corpus(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 90))]
        rows.append((f"o{i}", " ".join(w)))
        for j in range(rnd.randrange(3)):
            v = list(w)
            for _ in range(rnd.randrange(0, 6)):
                at = rnd.randrange(len(v))
                v[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [v[at], rnd.choice(vocab)]])
            rows.append((f"o{i}-{j}", ("  ,".join(v)).upper() if j else " ".join(v)))
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame([(o, t, "x", 1) for o, t in rows], "owner string, text string, a string, class_id int")
    return {(r.a, r.b) for r in X.similar_owners(df, "owner", "text", **kw).collect()}


def test_all_pairs_well_above_the_threshold_and_none_below(spark):
    rows = corpus(1, 120)
    got = found(spark, rows, k=3, threshold=0.5)
    assert got <= brute(rows, 3, 0.5)
    assert brute(rows, 3, 0.6) <= got


def test_defaults_are_five_words_and_four_fifths(spark):
    rows = corpus(2, 60)
    got = found(spark, rows)
    assert got <= brute(rows, 5, 0.8) and len(got) >= 0.99 * len(brute(rows, 5, 0.8))


def test_hot_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 8)
    monkeypatch.setattr(X, "CHUNK", 64)
    monkeypatch.setattr(X, "CELL", 6)
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(f"h{i}", f"{base} end{i} of{i} it{i}") for i in range(60)] + corpus(3, 20)
    whole = found(spark, rows, k=3, threshold=0.5)
    assert brute(rows, 3, 0.6) <= whole <= brute(rows, 3, 0.5)
    monkeypatch.setattr(X, "HOT_KEYS", 0)  # hot keys by a join instead of a broadcast
    assert found(spark, rows, k=3, threshold=0.5) == whole


def test_copies_nulls_short_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [("a", "one two three four"), ("b", "One, two THREE_four!"), ("b", "one two three four"), ("c", None), (None, "one two three four"), ("d", ""), ("e", "one two"), ("f", "one two"), ("l1", long), ("l2", long + " more")]
    assert found(spark, rows, k=3, threshold=0.5) == {("a", "b"), ("l1", "l2")}
    assert found(spark, [], k=3, threshold=0.5) == set()


def test_share_of_met_tables_follows_the_formula():
    rng = np.random.default_rng(5)
    m, met, n = 6, 0, 400
    for _ in range(n):
        shared = [f"s{x}" for x in rng.integers(0, 10**9, 60)]
        one, two = ([f"{p}{x}" for x in rng.integers(0, 10**9, 20)] for p in "pq")
        _, a, b = X.sign([" ".join(shared + one), " ".join(shared + two)], 1, m)
        met += bool((a[0] == a[1]).any() and (b[0] == b[1]).any())
    s = 60 / 100
    assert met / n == pytest.approx((1 - (1 - s * s) ** m) * (1 - (1 - s * s) ** X.N), abs=0.06)


def test_shingle_sets_of_a_batch_do_not_run_into_each_other():
    a, b, c = shingle_sets(["a b c d", None, "c d e"], 3)
    assert (len(a), len(b), len(c)) == (2, 0, 1) and not set(a.tolist()) & set(c.tolist())


def test_passes_and_sketches_lose_nothing_and_write_no_chance_meetings(spark, monkeypatch):
    rows = corpus(6, 80)
    whole = found(spark, rows, k=3, threshold=0.5)
    monkeypatch.setattr(X, "PASS", 900)
    assert found(spark, rows, k=3, threshold=0.5) == whole
    # texts that share two fifths of their words meet by chance, and are not written
    shared = [f"s{x}" for x in range(16)]
    texts = [" ".join([*shared, *(f"o{i}x{j}" for j in range(24))]) for i in range(200)]
    sigs = X.signatures(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), 1, 20)
    assert 4 * X.candidates(sigs, 0.5).count() < X.candidates(sigs, 0.0).count()
