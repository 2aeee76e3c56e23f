import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.just(50))
def test_first_fit_decreasing_is_the_plain_one(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    rooms, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(rooms) if r >= sizes[i]), None)
        if b is None:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        want[i] = b
    assert dict(enumerate(P.first_fit_decreasing(sizes, capacity).tolist())) == want if len(sizes) else True


def frames(spark, texts, caps):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, grp int")
    return docs, spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "budget_id int, capacity_tokens int")


def test_whole_assignment(spark):
    rnd = random.Random(6)
    texts = [" ".join("word" for _ in range(rnd.choice([1, 3, 9, 30, 70]))) for _ in range(300)] + [None, "", "a " * 5000]
    docs, budgets = frames(spark, texts, [16, 64])
    rows = P.pack(docs, budgets, group=80).collect()
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    for b, cap in ((0, 16), (1, 64)):
        mine = [r for r in rows if r.budget_id == b]
        room, got = {}, {}
        for r in mine:
            got.setdefault(r.doc_id, []).append(r)
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
        assert max(room.values()) <= cap and set(got) == set(counts)
        for d, parts in got.items():
            assert sum(p.n_tokens for p in parts) == counts[d] and len(parts) == max(1, -(-counts[d] // cap))
            assert [p.start_token for p in sorted(parts, key=lambda p: p.piece)] == [cap * i for i in range(len(parts))]
        assert sum(room.values()) / (len(room) * cap) > 0.85


def test_faults_are_seen(spark):
    docs, budgets = frames(spark, ["one two three", "four " * 30, None], [16])
    good = P.pack(docs, budgets)
    none = P.faults(good, docs, budgets).first()
    assert (none.wrong_tokens, none.split_without_need, none.over_full, none.texts) == (0, 0, 0, 2)
    moved = good.selectExpr("budget_id", "doc_id", "piece", "start_token", "n_tokens", "case when container_id is not null then 'one' end as container_id")
    assert P.faults(moved, docs, budgets).first().over_full == 1
    assert P.faults(good.filter("piece = 0"), docs, budgets).first().wrong_tokens == 1
    twice = good.unionByName(good.filter("doc_id = 0"))
    assert P.faults(twice, docs, budgets).first().split_without_need == 1


def test_empty_tables_and_special_strings(spark):
    docs, budgets = frames(spark, ["<|endoftext|>"], [8])
    assert P.pack(docs.limit(0), budgets).count() == 0 and P.pack(docs, budgets.limit(0)).count() == 0
    assert P.token_counts(docs).first().n_tokens > 1
