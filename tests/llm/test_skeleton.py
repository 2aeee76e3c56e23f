import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import skeleton as S

SAME = ["naïve copy", "nai\u0308ve copy", "na\u00efve\u00a0copy", "nаïve cоpy", "ｎａïｖｅ　ｃｏｐｙ", "na\u200bïve co\u00adpy", "naïve\u2007copy\ufeff"]
OTHER = ["naive copy", "Naïve copy", "naïve copy.", "naïve  copy", "naïve\ncopy", "na1ve copy"]


@pytest.fixture(scope="module")
def skeleton(spark):
    return S.Skeleton(S.look_alikes(spark))


def test_same_and_different(skeleton):
    assert len({skeleton(t) for t in SAME}) == 1
    assert len({skeleton(t) for t in OTHER} | {skeleton(SAME[0])}) == len(OTHER) + 1
    assert skeleton("plain ascii 0O1lI") == "plain ascii 0O1lI"
    assert skeleton.canonical(None) is None and skeleton.canonical(SAME[1]) == SAME[0]


@settings(max_examples=200, deadline=None)
@given(text=st.text())
def test_a_skeleton_is_its_own_skeleton(skeleton, text):
    once = skeleton(text)
    assert skeleton(once) == once


def test_visible_forms_stay_apart(skeleton):
    for a, b in (("x²", "x2"), ("H₂O", "H2O"), ("™", "TM"), ("①", "1"), ("½", "1/2"), ("ﬁt", "fit"), ("ª", "a"), ("ﷺ", "x"), ("б", "6"), ("З", "3"), ("é", "e"), ("…", "...")):
        assert skeleton(a) != skeleton(b), (a, b)


def test_letters_of_many_alphabets(skeleton):
    # one Latin letter of each group, beside its look-alikes from Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, and signs of width and font
    for latin, others in (("p", "рρ"), ("o", "оοօⲟ"), ("v", "ν"), ("a", "аα"), ("i", "іıι"), ("g", "ɡ"), ("A", "АΑᎪꓮ"), ("B", "ВΒᏴꓐ"), ("I", "ІΙӀ"), ("W", "ԜᎳ"), ("Q", "Ԛ"), ("q", "ԛ"), ("K", "КΚKＫ𝐊"), ("h", "һհ"), ("s", "ѕ"), ("j", "јϳ")):
        assert {skeleton(c) for c in others} == {latin}, (latin, [(c, unicodedata.name(c), skeleton(c)) for c in others])
    assert skeleton("ё") == skeleton("ë") and skeleton("Ａ１％") == "A1%" and skeleton("ﾊﾟ") == skeleton("パ")


def test_memory_of_runs_is_bounded(skeleton):
    own = S.Skeleton(skeleton.letters)
    for i in range(2000):
        own("б" * 900 + chr(0x4E00 + i))
    assert sum(len(a) + len(b) for a, b in own.runs.items()) <= S._KEPT_CHARS


def found(spark, texts):
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, skeleton_hash binary")
    pairs = {(r.doc_id_a, r.doc_id_b) for r in S.look_alike_pairs(df).collect()}
    classes = {r.doc_id: (r.class_id, r.n_docs, r.n_texts) for r in S.look_alike_classes(df).collect()}
    return pairs, classes


def brute(texts, skeleton):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and skeleton(texts[i]) == skeleton(texts[j]) != ""}


def test_pairs_against_brute_force_with_copies_nulls_and_a_hot_text(spark, skeleton):
    rnd = random.Random(10)
    texts = [rnd.choice([*SAME, *OTHER, None, "", "\u200b", "\u200d"]) for _ in range(80)] + ["the same text"] * 40
    pairs, classes = found(spark, texts)
    assert pairs == brute(texts, skeleton)
    assert set(classes) == {x for p in pairs for x in p} and {c[0] for c in classes.values()} == {min(x for p in pairs for x in p)}


def test_empty_table_and_very_long_text(spark):
    assert found(spark, [])[0] == set()
    long = "а b " * 300_000
    assert found(spark, [long, long.replace("а", "a"), "x"])[0] == {(0, 1)}


def test_canonical_texts(spark):
    df = spark.createDataFrame([(1, "ｆｕｌｌ"), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.changed) for r in S.canonical_texts(df).collect()} == {1: ("full", True), 2: ("plain", False), 3: (None, None), 4: ("", False)}
