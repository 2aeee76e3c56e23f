"""Problem 4: prompt and response pairs that are useless for training, and why.

Per pair, in this order: empty, refusal, copy, other_language, truncated. A pushdown parser reads fences, brackets,
quotes, lists, tables and markup for truncation; greedy string tiling finds copies; scripts and function words tell languages;
a grammar of subject, refused ability or will, and act tells refusals in seven languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.words import words

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

# Placeholders that stand for no answer.
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "undefined", "no answer", "no response", "empty", "pending", "placeholder"}
_THOUGHT = re.compile(r"<think\b[^>]*>.*?</think\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]*/?>", re.I)
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*([\w+.-]*)[ \t]*$", re.M)
# all format characters, found by rule
_FORMAT = re.compile("[" + re.escape("".join(chr(c) for c in (*range(0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) == "Cf")) + "]+")
_CODE = re.compile(r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+", re.M)


@lru_cache(maxsize=16)  # each test of a row asks for it
def visible(text: str | None) -> str:
    """Without thoughts and characters that show nothing, stripped."""
    if not text:
        return ""
    t = _THOUGHT.sub("", text)
    return (t if t.isascii() else _FORMAT.sub("", t)).strip()


def is_empty(text: str | None) -> bool:
    """Nothing visible, only fences or tags, or only a placeholder."""
    t = _TAG.sub("", _FENCE.sub("", visible(text))).strip(" \t\r\n*_`~#>\"'")
    bare = t.strip("()[]{}<>.…-–—?!:;,/\\ \t\r\n")
    return not bare or t.lower() in PLACEHOLDERS or bare.lower() in PLACEHOLDERS


# -- refusals ---------------------------------------------------------------------------------------------------

_WHO = r"(?:i|we|this assistant|the assistant|this model)"
_DO = (
    r"(?:assist|help|comply|answer|respond|produce|provide|offer|write|solve|do|take|work|continue|fulfil|fulfill|complete|support|give|generate|create|share|discuss|handle|attempt|"
    r"solution|solutions|code|request|one|that|this)"
)
_GAP = r"(?:[^\s.!?;]+ ){0,6}?"
# Of each language who refuses with what (ability or will, negated), and the act that is refused, which may come first or last.
_GRAMMAR = {
    "en": (r"(?:i|we) (?:have|see|know) no (?:way|means|right|ability)|(?:i|we) lack the (?:ability|means|right|permission)|(?:i am|i'm|we are|we're) (?:not in a position|unwilling|forbidden)", r"solve|answer|help|assist|respond|comply|provide|give|produce|write|do|fulfil\w*|offer|complete|share|generate"),
    "de": (r"(?:kann|können|werde|werden|darf|dürfen|möchte|möchten|will) (?:ich|wir)|(?:ich|wir) (?:kann|können|werde|werden|darf|dürfen|möchte|möchten|will|lehne|lehnen|weigere|bin|sind)", r"(?:nicht|kein\w*|ab|mich|außerstande|unfähig)[^.!?;]{0,60}\b(?:helfen|beantworten|lösen|antworten|unterstützen|geben|anbieten|liefern|erfüllen|nachkommen|schreiben|bearbeiten|übernehmen)"),
    "es": (r"no (?:puedo|podemos|podré|voy a|vamos a|debo|quiero|deseo|tengo permitido)|me niego a|no me es posible|no (?:soy|estoy) (?:capaz|autorizado|en condiciones)", r"ayudar\w*|responder\w*|resolver\w*|dar\w*|ofrecer\w*|proporcionar\w*|contestar\w*|cumplir|escribir\w*|hacerlo|hacer eso|atender"),
    "fr": (r"(?:je|nous) (?:ne )?(?:peux|pouvons|vais|allons|dois|veux|souhaite) (?:malheureusement )?pas|(?:je|nous) (?:me |nous )?(?:refuse|refusons) de|(?:je ne suis|nous ne sommes) pas (?:en mesure|capables?|autorisée?s?)|il m'est impossible", r"(?:vous )?(?:y )?(?:aider|répondre|résoudre|fournir|donner|proposer|écrire|traiter|accéder|le faire|faire cela)"),
    "it": (r"non (?:posso|possiamo|intendo|voglio|devo|sono in grado|mi è possibile)|mi rifiuto", r"aiutar\w*|risponder\w*|risolver\w*|fornir\w*|dar\w*|scriver\w*|farlo|offrir\w*"),
    "pt": (r"não (?:posso|podemos|poderei|vou|vamos|consigo|devo|quero)|recuso-me a|não (?:me é possível|sou capaz|estou autorizado)", r"ajudar|ajudá-\w+|responder|resolver|resolvê-\w+|fornecer|dar|oferecer|escrever|fazer isso|fazê-lo|atender|cumprir"),
    "ru": (r"(?:я )?не (?:могу|можем|смогу|буду|стану|вправе|имею права|готов\w*|в состоянии)|(?:я )?отказываюсь", r"помочь|помогать|ответить|отвечать|решить|решать|дать|давать|предоставить|выполнить|написать|сделать это"),
}
_DECLINES = re.compile("|".join(rf"(?<!\w)(?:{who}) {_GAP}(?:{act})(?!\w)" for who, act in _GRAMMAR.values()))
# Further sentences, each of which alone declines.
_REFUSE = re.compile(
    "|".join(
        (
            rf"\b{_WHO} (?:cannot|can not|can't|could not|couldn't|won't|will not|would not|shall not|do not|don't|does not|doesn't|may not|must not) (?:\w+ ){{0,3}}{_DO}\b",
            rf"\b(?:i am|i'm|we are|we're) (?:not able|unable|not allowed|not permitted|not in a position|not going|not comfortable) (?:to )?(?:\w+ ){{0,2}}{_DO}?",
            r"\b(?:i|we) (?:must|have to|need to|will|would|'ll)? ?(?:respectfully |politely )?(?:decline|refuse|pass)\b",
            r"\bi(?:'d| would) rather not\b",
            r"\bi (?:don't|do not) feel comfortable\b",
            r"\b(?:is|are) something (?:i|we) (?:do not|don't|cannot|can't|will not|won't) (?:do|discuss|answer|offer)\b",
            r"\bnot something (?:i|we) (?:will|would|can|do|shall)\b",
            r"\b(?:is|are|falls|lies) (?:outside|beyond) (?:of )?(?:what (?:i|we) (?:may|can|am able to)|my (?:remit|scope|abilities|guidelines))",
            r"\bno (?:answer|solution|response|code|help) (?:can|could|may|will) be (?:provided|given|offered|produced|written)\b",
            r"\bthere (?:will|can) be no (?:solution|answer|response|code|help) from (?:me|us)\b",
            r"\bit would not be (?:appropriate|right|proper|responsible) for (?:me|us) to\b",
            r"\b(?:request|task) (?:is )?(?:declined|denied|refused|rejected)\b",
            r"\bpolicy (?:does not|doesn't|cannot) (?:permit|allow)\b",
            r"\b(?:answering|solving|responding|helping|this)\b[^.]{0,40}\b(?:would )?break(?:s)? the rules\b",
            r"\bso i will stop here\b",
            r"\bagainst (?:my|our|the) (?:rules|policy|policies|guidelines)\b",
        )
    )
)
_ANSWERED = re.compile(r"\b(?:so|hence|therefore|thus)\b[^.]{0,40}\b(?:answer|result|value)\b|####|\\boxed|\b(?:answer|conclusion)\s*:|\bstep \d|[=≈]\s*[-+]?\$?\d", re.I)


def is_refusal(text: str | None) -> bool:
    """Declines, at whatever length, and holds neither code nor a worked answer; an apology before a real answer is none."""
    t = visible(text)
    if _CODE.search(t) or "```" in t or _ANSWERED.search(t):
        return False
    plain = re.sub(r"\s+", " ", re.sub(r"[*_#>`]+", "", t).lower().replace("’", "'"))
    return _REFUSE.search(plain) is not None or _DECLINES.search(plain) is not None


# -- copies -----------------------------------------------------------------------------------------------------


#: Words of a run that counts as copied.
LEAST = 5


def _places(pattern: list[str], least: int) -> dict[tuple[str, ...], list[int]]:
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(pattern) - least + 1):
        places.setdefault(tuple(pattern[i : i + least]), []).append(i)
    return places


def tiles(pattern: list[str], text: list[str], least: int = LEAST, places: dict[tuple[str, ...], list[int]] | None = None, used: bytearray | None = None, again: bool = False) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length) of runs that both have, none shorter than ``least``.

    In each round the longest runs of words that no tile has yet, on either side, become tiles; so each word lies in one tile at most.
    ``used`` marks words of the text that are taken already, and is added to. With ``again`` words of the pattern are never used up.
    """
    places = _places(pattern, least) if places is None else places
    used_p, used_t = bytearray(len(pattern)), bytearray(len(text)) if used is None else used
    starts = [(j, at) for j in range(len(text) - least + 1) if (at := places.get(tuple(text[j : j + least])))]
    out: list[tuple[int, int, int]] = []
    while True:
        longest, found = least, []
        seen: dict[int, int] = {}  # of each alignment the end of its last run: what starts before is part of that run
        for j, at in starts:
            if used_t[j]:
                continue
            for i in at:
                if used_p[i] or seen.get(i - j, -1) > j:
                    continue
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                seen[i - j] = j + n
                if n > longest:
                    longest, found = n, [(i, j)]
                elif n == longest:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(used_p[i : i + longest]) and not any(used_t[j : j + longest]):
                used_t[j : j + longest] = b"\1" * longest
                if not again:
                    used_p[i : i + longest] = b"\1" * longest
                out.append((i, j, longest))


def covered(pattern: list[str], text: list[str], places: dict[tuple[str, ...], list[int]] | None = None) -> tuple[bytearray, int]:
    """Which words of ``text`` lie in tiles, and how many of the pattern do. What the tiling leaves is tiled with the whole pattern again, so that a repeated copy is covered."""
    marks = bytearray(len(text))
    of_pattern = sum(n for _, _, n in tiles(pattern, text, LEAST, places, marks))
    if of_pattern:
        tiles(pattern, text, LEAST, places, marks, True)
    return marks, of_pattern


def is_copy(prompt: str, response: str | None) -> bool:
    """Nearly all words lie in tiles of the prompt, as do the prompt's in tiles of the response, and no part that stands by itself adds anything."""
    t = visible(response)
    text = words(t)
    pattern, own = _pattern(prompt)
    if text == pattern or len(text) < LEAST or len(pattern) < LEAST:
        return bool(text) and text == pattern
    # no tiling covers more than the pattern's words, or more than all runs of the pattern do
    if sum(map(own.__contains__, text)) < 0.7 * len(text):
        return False
    places = _places(pattern, LEAST)
    runs = 0
    end = 0
    for j in range(len(text) - LEAST + 1):
        if tuple(text[j : j + LEAST]) in places:
            runs += j + LEAST - max(end, j)
            end = j + LEAST
    if runs < 0.7 * len(text):
        return False
    marks, of_pattern = covered(pattern, text, places)
    if sum(marks) < 0.7 * len(text) or of_pattern < 0.65 * len(pattern):
        return False
    # an answer after the copy: the last paragraph, or line, has words of its own for the most part
    at = 0
    parts = [p for p in re.split(r"\n+", t) if words(p)]
    for n, part in enumerate(parts):
        size = len(words(part))
        own = size - sum(marks[at : at + size])
        at += size
        if n and own > 0.6 * size and not re.fullmatch(r"[\W_]*(?:problem|problem statement|question|task|prompt|you asked)[\W_]*", part, re.I):
            return False
    return True


# -- languages --------------------------------------------------------------------------------------------------

# Frequent function words of the languages told apart by words; Cyrillic text is told by its script.
FUNCTION_WORDS = {
    "en": "the of and to is that it with as for are was this be by a an or from which not if at in on has must can may you we how what two one into over under so when where then here there".split(),
    "de": "der die das und ist nicht mit den dem des ein eine einen auf für von wird im in zu sich weil bei nach vor wie oben werden man jede alle bis zur zum durch dann danach zuerst auch während solange außerdem trotzdem innerhalb".split(),
    "es": "el la los las de que y a en un una por con se para del al es como cada hasta según sin más todos todas si pero entre antes después desde mientras también donde".split(),
    "fr": "le la les des de du et est un une a que en dans pour par avec on sur au aux se ne pas plus chaque selon sans jusqu tant toutes tous après même si car comme avant entre ce cette qui".split(),
    "it": "il lo la i gli le di che e è un uno una per con del della dei delle nel nella al alla come ogni fino secondo senza più tutti tutte se ma tra prima dopo mentre anche dove non sono da".split(),
    "nl": "de het een en van is niet met voor op te dat in aan bij naar over elke alle tot als maar dan eerst daarna ook tijdens zonder volgens worden wordt zijn heeft uit om we er".split(),
    "pt": "o a os as de que e em um uma do da dos das no na por com para se não como cada até sem mais todos todas enquanto antes depois após além disso isso é à ao pelo pela são".split(),
}
_LANGUAGES = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v) for v in FUNCTION_WORDS.values() for w in v}
_DOZEN_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){12}")
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
_FENCED = re.compile(r"(`{3,}|~{3,}).*?(?:\1|\Z)", re.S)


def prose(text: str) -> str:
    """Without fenced blocks, inline code and lines of program code."""
    t = re.sub(r"`[^`\n]*`", " ", _FENCED.sub("\n", text))
    if _CODE.search(t):
        kept, inside = [], False
        for line in t.split("\n"):
            if _CODE.match(line):
                inside = True
                continue
            if inside and (not line.strip() or line[0] in " \t)]}"):
                continue
            inside = False
            kept.append(line)
        t = "\n".join(kept)
    return t


def _script(text: str) -> str | None:
    """The name of the script that most letters beyond Latin have, if they are a good part of all; "" for Latin, null for too few letters."""
    if not _DOZEN_LETTERS.search(text):
        return None
    if not _BEYOND_LATIN.search(text):
        return ""
    letters = [c for c in text if c.isalpha()]
    beyond = [c for c in letters if ord(c) > 0x24F]
    if len(beyond) <= 0.4 * len(letters):
        return ""
    scripts: dict[str, int] = {}
    for c in beyond:
        s = unicodedata.name(c, "?").split(" ")[0]
        scripts[s] = scripts.get(s, 0) + 1
    return max(sorted(scripts), key=scripts.get)


def _scores(text: str) -> dict[str, int]:
    scores = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words(text):
        for k in _LANGUAGES.get(w, ()):
            scores[k] += 1
    return scores


def language(text: str) -> str | None:
    """en, de, es, fr, it, nl, pt, ru, or the name of another script; null where the prose is too short to tell."""
    script = _script(text)
    if script:
        return "ru" if script == "CYRILLIC" else script.lower()
    if script is None:
        return None
    scores = _scores(text)
    best = max(scores, key=scores.get)
    rest = max(v for k, v in scores.items() if k != best)
    return best if scores[best] >= 2 and scores[best] > rest else None


@lru_cache(maxsize=4096)  # prompts come several times
def _asked(prompt: str) -> str | None:
    return language(prose(prompt))


@lru_cache(maxsize=4096)
def _pattern(prompt: str) -> tuple[list[str], frozenset[str]]:
    w = words(prompt)
    return w, frozenset(w)


def in_other_language(prompt: str, response: str) -> bool:
    """The prose of the response clearly belongs to another language than the prompt's."""
    asked, text = _asked(prompt), prose(visible(response))
    script = _script(text)
    if asked is None or script is None:
        return False
    if script or asked not in FUNCTION_WORDS:
        return language(text) not in (asked, None)
    scores = _scores(text)
    best = max(scores, key=scores.get)
    return best != asked and scores[best] >= 3 and scores[best] > 1.3 * scores[asked]


# -- truncation -------------------------------------------------------------------------------------------------

_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
_CUT_MARK = re.compile(r"(?:…|\.\.\.|\[[^\[\]\n]*(?:max|tokens?|truncated|cut off|continued|reached|limit)[^\[\]\n]*\])\s*$", re.I)
_END = re.compile(r"[.!?:;。！？]['\"”’»)\]*_`~]*$|```$|~~~$")
_FINAL = re.compile(r"(?:####|answer\s*:?|conclusion\s*:|result\s*:|value\s*:|=)\s*\S[^\n]*$", re.I)
_CODE_END = re.compile(r"^[ \t]+(?:return\b|raise\b|yield\b|pass\b|print\s*\()")


def parse_open(text: str, code: bool) -> list[str]:
    """The constructs still open at the end: a pushdown parser over brackets, quotes and, outside code, markup tags."""
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        top = stack[-1] if stack else ""
        if top in ("'", '"', "'''", '"""', "`", "$"):
            if c == "\\" and top != "`":
                i += 2
                continue
            if text.startswith(top, i):
                stack.pop()
                i += len(top)
                continue
            if c == "\n" and len(top) == 1 and top != "$":
                if code:
                    return stack
                stack.pop()
            i += 1
            continue
        if code and c == "#":
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        if code and c in "'\"":
            q = c * 3 if text.startswith(c * 3, i) else c
            stack.append(q)
            i += len(q)
            continue
        if not code and c == "`":
            stack.append("`")
        elif c in _OPEN:
            stack.append(c)
        elif c in _CLOSE and top == _CLOSE[c]:
            stack.pop()
        elif not code and c == "<" and (m := re.compile(r"<(/?)(think|answer|code|pre|b|i|em|strong|p|ul|ol|li|table)\b[^<>]*>", re.I).match(text, i)):
            tag = f"<{m[2].lower()}>"
            if not m[1] and not m[0].endswith("/>"):
                stack.append(tag)
            elif tag in stack:
                while stack.pop() != tag:
                    pass
            i = m.end()
            continue
        i += 1
    return stack


def _code_cut(code: str) -> bool:
    """Program text that stops early: open brackets or strings, a dangling operator or keyword, or a function without its end."""
    t = code.rstrip()
    if not t:
        return False
    if parse_open(t, True):
        return True
    last = t.split("\n")[-1]
    if not _CODE.search(t):
        return bool(re.search(r"[=+\-*/%<>,(\[{&|]\s*$|[:]\s*$", last))
    if not _CODE_END.match(last) or last.strip() in ("return", "raise", "yield"):
        return True  # a function stops before its end
    if re.search(r"(?:[=+\-*/%<>,&|.:]|\b(?:and|or|not|in|is|if|else|lambda|for))\s*$", last):
        return True
    # a name at the very end that the code never sets is a name, or a call, cut short
    name = re.search(r"(?<![\w.'\"])([A-Za-z_]\w*)$", last)
    return bool(name) and name[1] not in ("None", "True", "False", "pass") and len(re.findall(rf"\b{name[1]}\b", t)) == 1


def is_truncated(text: str | None) -> bool:
    """Stops before it is complete. A stray closing fence is no defect."""
    if text and re.search(r"<think\b", text, re.I) and not re.search(r"</think", text, re.I):
        return True
    t = visible(text)
    if _CUT_MARK.search(t):
        return True
    marks = list(_FENCE.finditer(t))
    outside, code, fence = [], [], None
    at = 0
    for m in marks:
        piece = t[at : m.start()]
        if fence is None:
            if m[2] or not _CODE.search(piece):
                outside.append(piece)
                fence = m[1][:3]
            else:  # a closing fence that was never opened
                code.append(piece)
        elif m[1][:3] == fence:
            code.append(piece)
            fence = None
        at = m.end()
    rest = t[at:]
    if fence is not None:
        return True  # the fence was opened and never closed
    if any(_code_cut(c) for c in code):
        return True
    rest = rest.strip("\n")
    if not rest.strip():
        return False
    if _CODE.search(rest) and (not code or _CODE.search(rest)):
        first = _CODE.search(rest)
        before, body = rest[: first.start()], rest[first.start() :]
        tail = prose(body).strip()
        if tail and tail in body:
            return _prose_cut(tail) or _code_cut(body[: body.rindex(tail)])
        return _code_cut(body)
    return _prose_cut(rest.strip())


def _prose_cut(t: str) -> bool:
    """Prose that ends inside a construct, a list item, or a sentence."""
    lines = [x.strip() for x in t.split("\n")]
    last = lines[-1]
    whole = len(t.split()) <= 3
    if (m := re.fullmatch(r"(\d+)[.)]", last)) and any(re.match(rf"{int(m[1]) - 1}[.)]\s", x) for x in lines):
        return True  # the next item of a list, without its text
    if last.startswith("|") and len(lines) > 1 and lines[-2].startswith("|"):
        return not last.endswith("|") or last.count("|") < lines[-2].count("|")  # a row of a table
    if re.search(r"(?:https?://|www\.)\S+\w/?$", last):
        return False  # a source at the end
    if re.fullmatch(r"[*_#>\s]*[-+]?[\d.,/%$\\{}\w^]+[*_]*" if whole else r"[-+]?\d[\d.,/%]*", last):
        return False  # a bare value, alone or in a line of its own
    if [x for x in parse_open(t, False) if x != "<p>"]:
        return True
    if re.fullmatch(r"(?:[-*+•]|\d+[.)])\s*", last):
        return True
    bare = last.rstrip("*_ ")
    if _END.search(bare):
        return re.search(r"(?:####|answer\s*:|conclusion\s*:|[,;])\s*$", bare, re.I) is not None
    if _FINAL.search(last):
        return False
    return True


def defect(prompt: str | None, response: str | None) -> str | None:
    """The kind of defect, or null for a sound pair and for pairs without a prompt."""
    if prompt is None:
        return None
    if is_empty(response):
        return "empty"
    if is_refusal(response):
        return "refusal"
    if is_copy(prompt, response):
        return "copy"
    if in_other_language(prompt, response):
        return "other_language"
    return "truncated" if is_truncated(response) else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [defect(p, r) for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        keep = pa.array([i for i, f in enumerate(found) if f], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([f for f in found if f], pa.string())], names=["record_id", "defect"])


def broken_pairs(rows: DataFrame, ident: str, prompt: str, response: str) -> DataFrame:
    """record_id, defect: each defective record once, though its row may be repeated.

    Pairs with a null prompt or a null id are no cases; a null response is empty. Whole texts are read. Of rows with one id and
    different defects the least name is given.
    """
    r = rows.select(F.col(ident).cast("string").alias("record_id"), F.col(prompt).alias("p"), F.col(response).alias("r")).filter("record_id is not null and p is not null")
    return r.mapInArrow(_rows, "record_id string, defect string").groupBy("record_id").agg(F.min("defect").alias("defect"))
