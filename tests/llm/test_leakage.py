import random

import numpy as np

from evalloom.llm import leakage as L
from evalloom.llm.skeleton import Skeleton, look_alikes

PLAIN = Skeleton({})

ITEMS = "item_id string, prompt string, answer string, doc_id string"


def test_edit_distances_against_the_textbook():
    rnd = random.Random(7)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    a = np.array([[rnd.randrange(4) for _ in range(7)] for _ in range(50)])
    b = np.array([[rnd.randrange(4) for _ in range(7)] for _ in range(50)])
    assert L.edit_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def words(rnd, n):
    return [f"w{rnd.randrange(3000)}" for _ in range(n)]


def test_exact_windows_against_brute_force(spark):
    rnd = random.Random(8)
    items = [(f"i{k}", " ".join(words(rnd, 30)), " ".join(words(rnd, rnd.choice([5, 25]))), "x") for k in range(30)] + [("i0", None, "", "x"), (None, "a", "b", "x")]
    docs = []
    for d in range(120):
        w = words(rnd, 40)
        src = rnd.choice(items[:30])[rnd.choice([1, 2])].split()
        at, n = rnd.randrange(0, 15), rnd.choice([9, 10, 14])
        docs.append((d, "\n".join([*w[:20], *src[at : at + n], *w[20:]]).upper().replace("W", "Ｗ" if d % 2 else "W").replace("\n", " **_ "), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " ".join(words(rnd, 9)), "x"), (0, docs[0][1], "x")]
    want = set()
    grams = {}
    for i, p, a, _ in items[:30]:
        for t in (p, a):
            w = t.split()
            for s in range(len(w) - 9):
                grams.setdefault(tuple(w[s : s + 10]), set()).add(i)
    for d, t, _ in docs:
        w = L.seen_words(t, Skeleton(look_alikes(spark)))
        for s in range(len(w) - 9):
            want |= {(d, i) for i in grams.get(tuple(w[s : s + 10]), ())}
    di, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, ITEMS)
    for block in (1000, 7):
        assert {(r.doc_id, r.item_id) for r in L.leaked_passages(di, it, block=block).collect()} == want
    assert L.leaked_passages(di.limit(0), it).count() == 0 and L.leaked_passages(di, it.limit(0)).count() == 0


def test_edits_reach_the_wanted_recall():
    rnd = random.Random(9)
    items = [(f"i{k}", [" ".join(words(rnd, 12))]) for k in range(400)]
    index = L.PassageIndex(items, 12, 1, 0.95, PLAIN)
    hit = 0
    for k, (_, (t,)) in enumerate(items):
        w = t.split()
        at = rnd.randrange(12)
        kind = rnd.randrange(3)
        w[at : at + 1] = [["zz"], [], [w[at], "zz"]][kind]
        text = " ".join([*words(rnd, 5), *w, *words(rnd, 5)])
        hit += any(o == k for _, o, _, _ in index.search([text]))
    assert hit >= 0.93 * len(items)
    swaps = sum(any(o == k for _, o, _, _ in index.search([" ".join([*t.split()[:6], "zz", *t.split()[7:]])])) for k, (_, (t,)) in enumerate(items))
    assert swaps >= 0.93 * len(items)


def test_nothing_beyond_the_allowed_edits():
    index = L.PassageIndex([("a", ["one two three four five six seven eight nine ten"])], 10, 1, 0.99, PLAIN)
    assert index.search(["one two three four X six seven Y nine ten"]) == []
    assert [x[2:] for x in index.search(["one two three four five six seven eight nine ten"])] == [(1, 0)]


def test_every_kind_and_place_of_an_edit_reaches_the_wanted_recall():
    rnd = random.Random(10)
    items = [(f"i{k}", [" ".join(words(rnd, 12))]) for k in range(150)]
    index = L.PassageIndex(items, 12, 1, 0.95, PLAIN)
    for kind in range(3):
        for at in range(12):
            texts = []
            for _, (t,) in items:
                w = t.split()
                w[at : at + 1] = [["zz"], [], ["zz", w[at]]][kind]
                texts.append(" ".join([*words(rnd, 5), *w, *words(rnd, 5)]))
            hit = sum(k == o for k, o, _, _ in index.search(texts))
            # 0.95 less three standard errors of 150 trials
            assert hit >= 0.896 * len(items), (kind, at, hit)


def test_a_passage_at_the_end_of_a_document_may_lack_a_word():
    index = L.PassageIndex([("a", ["one two three four five six seven eight nine ten"])], 10, 1, 0.999, PLAIN)
    assert [x[2:] for x in index.search(["one two three four six seven eight nine ten"])] == [(1, 1)]
    assert [x[2:] for x in index.search(["one two three four five X six seven eight nine ten"])] == [(1, 1)]
    assert index.search(["one two three four five six", "seven eight nine ten"]) == []
