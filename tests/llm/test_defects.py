import random

import pytest

from evalloom.llm import defects as D

PROMPT = "Given a sorted list of twelve numbers, find the smallest step at which two of them add up to the target. Return the answer as a pair of indices and explain briefly why it is the first."
CODE = "def f(x, n=3):\n    out = {}\n    for v in x:\n        out[v % n] = out.get(v % n, 1) + 1\n    return sorted(out.items(), key=lambda kv: (kv[1], -kv[0]))[:3]"
GERMAN = "Zuerst teilt der Prozess die Länge der Folge und gibt das Ergebnis zurück. Danach prüft man die offenen Werte mit höherer Genauigkeit."
SPANISH = "Primero la búsqueda descarta un estado anterior como se indicó arriba. Al final el bucle cuenta todas las claves dentro del límite."


@pytest.mark.parametrize(
    "response, kind",
    [
        (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("\u200b", "empty"), ("```\n\n```", "empty"), ("```python\n```", "empty"), ("<think>\nwell</think>\n", "empty"), ("<answer></answer>", "empty"),
        ("...", "empty"), ("-", "empty"), ("N/A", "empty"), ("**None**", "empty"), ("0", None), ("-5", None),
        ("I'm sorry, but I cannot comply with the request.", "refusal"), ("**Regrettably, I must decline to answer.**", "refusal"), ("Not something I will take on, however odd the list may be.", "refusal"),
        ("After some thought, no answer can be provided by me.", "refusal"), ("Pass. The list question is beyond my remit.", "refusal"), ("I'd rather not. Ask somebody qualified.", "refusal"),
        ("Request declined. Policy does not permit an answer here.", "refusal"), ("<think>Hm.</think>\nThis assistant does not offer list solutions; sorry.", "refusal"),
        ("I cannot assume the list is sorted, so I copy it first.\n\n```python\n" + CODE + "\n```", None), ("Sorry for the long way round; this will match each number once.\n\n" + CODE, None),
        ("It is impossible to reach the target, so the answer is 198.", None), ("Step 1: add the two.\nIt is impossible to reach the target.\nAnswer: 4", None),
        (PROMPT, "copy"), (PROMPT.upper(), "copy"), ("> " + PROMPT.replace(". ", ".\n> "), "copy"), (PROMPT + "\n\n" + PROMPT, "copy"), ("Question: " + PROMPT.replace("smallest", "tiniest"), "copy"),
        (PROMPT.split(". ")[0] + ".\n\n4695", None), (PROMPT.split(". ")[0] + ".\n\n" + CODE, None),
        (GERMAN, "other_language"), (SPANISH + "\n\n```python\n" + CODE + "\n```", "other_language"), ("Для каждого случая поиск отбрасывает прежнее состояние без повторений.", "other_language"),
        (CODE, None), ("```python\n" + CODE + "\n```", None), (CODE + "\n```", None), ("```python\n" + CODE + "\n```\n\nIt runs in linear time over the list.", None),
        (CODE[:60], "truncated"), ("```python\n" + CODE, "truncated"), (CODE[: CODE.index("sorted")], "truncated"), (CODE[: CODE.index("    for")], "truncated"), (CODE[: CODE.index("kv: (")] + "…", "truncated"),
        ("Step 1: So the list is longer than the other.\nStep 2: Note that", "truncated"), ("So the list is [max tokens reached]", "truncated"), ("<think>still going", "truncated"),
        ("Step 1: So the list is longer than the other.\n#### 575", None), ("So it follows.\nHence the value equals \\boxed{12}.", None), ("So it follows.\nConclusion: True", None),
    ],
)
def test_kinds(response, kind):
    assert D.defect(PROMPT, response) == kind


def test_other_prompts():
    assert D.defect(None, None) is None
    assert D.defect(GERMAN, GERMAN.replace("Zuerst", "Dann").replace("Folge", "Liste") + " Dabei vergleicht man die größte Summe vor dem Abschluss.") != "other_language"
    assert D.defect(GERMAN, "So the list may absorb the other one in which all of the values are odd.\nAnswer: 5") == "other_language"
    assert D.defect("", "fine.") is None


def test_tiles_do_not_overlap_and_the_longest_come_first():
    a, b = "a b c d e f g".split(), "x a b c d e y a b c d e f g".split()
    assert D.tiles(a, b) == [(0, 7, 7)]  # the pattern's words are used up by the longer run
    marks, of_pattern = D.covered(a, b)
    assert list(marks) == [0, 1, 1, 1, 1, 1, 0, *[1] * 7] and of_pattern == 7
    assert D.tiles([], b) == [] and D.tiles(a, []) == []
    c = [f"w{i}" for i in range(40)]
    moved = c[20:] + ["new"] + c[:20]
    assert sorted(D.tiles(c, moved)) == [(0, 21, 20), (20, 0, 20)]
    rnd = random.Random(3)
    for _ in range(60):
        p, t = ([rnd.choice("abc") for _ in range(rnd.randrange(40))] for _ in range(2))
        found = D.tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in found)
        at_p, at_t = [x for i, _, n in found for x in range(i, i + n)], [x for _, j, n in found for x in range(j, j + n)]
        assert len(at_p) == len(set(at_p)) and len(at_t) == len(set(at_t)) and [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)
        free_p, free_t = (["-" if x in set(at) else w for x, w in enumerate(words)] for words, at in ((p, at_p), (t, at_t)))
        left = {tuple(free_p[i : i + 3]) for i in range(len(free_p) - 2)} & {tuple(free_t[j : j + 3]) for j in range(len(free_t) - 2)}
        assert all("-" in x for x in left)


@pytest.mark.parametrize(
    "response, kind",
    [
        ("As a language model, I have no way to solve this.", "refusal"), ("We lack the means to answer a question about lists.", "refusal"), ("I'm not in a position to help here.", "refusal"),
        ("Es tut mir leid, aber ich kann Ihnen bei dieser Aufgabe nicht helfen.", "refusal"), ("Leider darf ich diese Frage nicht beantworten.", "refusal"), ("Ich lehne es ab, diese Liste zu bearbeiten.", "refusal"),
        ("Lo siento, pero no puedo ayudarte con esa petición.", "refusal"), ("Me niego a responder a esta pregunta.", "refusal"), ("No me es posible resolver este problema.", "refusal"),
        ("Désolé, je ne peux pas répondre à cette question.", "refusal"), ("Je refuse de traiter cette demande.", "refusal"), ("Il m'est impossible de vous aider.", "refusal"),
        ("Desculpe, mas não posso ajudar com isso.", "refusal"), ("Recuso-me a resolver esta lista.", "refusal"), ("Mi dispiace, non posso aiutarti con questa lista.", "refusal"),
        ("Извините, я не могу помочь с этой задачей.", "refusal"), ("Я отказываюсь отвечать на этот вопрос.", "refusal"),
        ("Eerst deelt het proces de lengte van de reeks en dan worden alle waarden met elkaar vergeleken, zonder dat een stap wordt herhaald.", "other_language"),
        ("Prima la ricerca scarta uno stato precedente come indicato sopra, dopo il ciclo conta tutte le chiavi entro il limite della lista.", "other_language"),
        ("These are the steps:\n1. Sort the list.\n2. Take both ends.\n3.", "truncated"), ("These are the steps:\n1. Sort the list.\n2. Take both ends.", None),
        ("| a | b |\n|---|---|\n| 1 | 2 |", None), ("| a | b |\n|---|---|\n| 1 |", "truncated"), ("| a | b |\n|---|---|\n| 1 | 2", "truncated"),
        ("The rule is explained in full at https://example.org/rules/two-sum", None), ("It follows from the rule that (as was shown", "truncated"),
        ("Some cases cannot be solved in one pass. Two passes are enough, as the list is sorted.", None), ("No list is sorted twice, and no number can give two pairs.", None),
    ],
)
def test_cases_beyond_english_sentences(response, kind):
    assert D.defect(PROMPT, response) == kind


def test_pushdown_parser():
    assert D.parse_open("f(a[1], '(') # (", True) == [] and D.parse_open("f(a[1", True) == ["(", "["] and D.parse_open("x = 'ab", True) == ["'"]
    assert D.parse_open("see `a(b` and (c)", False) == [] and D.parse_open("<think>a", False) == ["<think>"] and D.parse_open("it's fine", False) == []


def test_records_once_with_nulls_and_extra_columns(spark):
    rows = [("a", PROMPT, None, "x"), ("a", PROMPT, None, "x"), ("b", None, None, "x"), (None, PROMPT, "", "x"), ("c", PROMPT, "4", "x"), ("d", PROMPT, "word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "i string, p string, r string, defect string")
    got = sorted((r.record_id, r.defect) for r in D.broken_pairs(df, "i", "p", "r").collect())
    assert got == [("a", "empty"), ("d", "truncated")]
    assert D.broken_pairs(df.limit(0), "i", "p", "r").count() == 0


def test_a_refusal_may_explain_itself_at_length():
    why = " ".join(["The matter touches on things that deserve the care of somebody who knows the whole background."] * 8)
    assert len(why.split()) > 80
    assert D.is_refusal(f"I'm sorry, but I cannot help with this request. {why}")
    assert D.is_refusal(f"{why} For these reasons I must decline to answer.")
    assert not D.is_refusal(why)
    assert not D.is_refusal(f"I cannot help with the first part. {why} The second part gives 3 * 4 = 12.")
