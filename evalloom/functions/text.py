"""Text normalisation, predicates and extractors as native column expressions.

All of them give null for a null text unless said otherwise, read whole texts, and stay inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on", "at", "by", "for", "with", "from", "as", "that", "this", "these", "those", "it", "its",
    "we", "our", "you", "your", "they", "their", "i", "he", "she", "him", "her", "step", "steps", "then", "so", "if", "thus", "hence", "therefore", "because", "since", "given", "have", "has", "had", "will",
    "can", "could", "should", "would", "may", "might", "must", "do", "does", "did", "done", "also", "only", "just", "more", "less", "than", "some", "any", "all", "no", "not", "yes",
]

# Words that hedge, and words that assert.
HEDGES = ("maybe", "perhaps", "possibly", "might", "could be", "i think", "i believe", "not sure", "unsure", "guess", "probably", "seems", "appears to", "i'm not certain", "approximately", "roughly", "it depends")
ASSERTIONS = ("definitely", "certainly", "clearly", "obviously", "must be", "therefore", "thus", "proves", "conclusively", "exactly")

# Phrases by which a text admits its own error.
ADMISSIONS = ("which is incorrect", "is incorrect but", "miscalculation", "wait this is wrong", "wait, this is wrong", "i made a mistake", "that was wrong", "this is wrong,", "scratch that")

# Openings that decline to answer, and marks of a worked solution.
REFUSAL = (
    r"(?i)(?:i\s+can'?t|i\s+cannot|i\s+(?:am|'m)\s+(?:not\s+able|unable)|i\s+(?:don'?t|do\s+not)\s+(?:have|know)|as\s+an?\s+(?:ai|language\s+model)|"
    r"i\s+(?:apologize|sorry)|not\s+(?:possible|able)\s+to\s+(?:solve|answer|help)|this\s+(?:is\s+)?(?:beyond|outside)\s+(?:my|the\s+scope))"
)
SOLUTION = r"(?im)(?:^\s*step\s*\d|^\s*conclusion\b|^\s*(?:therefore|thus|so)\b.*=|^\s*(?:final\s+)?answer\s*[:=])"

# Solution text inside a problem, and at its start.
LEAK = r"(?i)(?:\n|[.?!;] )(?:solution|answer|step\s*1[.:)]|first,\s*(?:we|let|I)|let's solve|to solve this|hint:|the answer|we can solve|let me solve)"
LEAK_AT_START = r"(?i)^\s*(?:solution|answer|hint|step\s*1|first,\s*(?:we|let|I)|let's solve|to solve this|let me solve|we can solve|the answer is)\b"

# The unit words that may end an answer.
UNITS = r"(?i)\s*(?:cm|mm|m|km|kg|g|mg|lb|oz|ft|in|s|sec|min|hr|hours?|days?|years?|dollars?|euros?|cents?|percent|%|degrees?|°|radians?|rad)\s*$"

# Patterns of answers, in queries and in their SQL alike.
VOTE_PREFIX = r"^(the\s+)?(final\s+)?(answer|result|output|value|conclusion)\s*[:=]\s*"
VOTE_NUMBER = r"(-?\d+(?:\.\d+)?(?:/\d+)?)"
BOX_OPENS, BOX_ENDS = r"^\\boxed\s*\{\s*", r"\s*\}\s*$"
BOXED = r"\\boxed\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
DOLLARS = r"^\$+|\$+$"
ANSWER_IS = r"(?i)^(?:the\s+)?(?:answer|result|solution|value)\s+is\s+"
FRACTION, ROOT = r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\\sqrt\s*\{([^{}]*)\}"
# LaTeX commands and their plain forms, the longer command before its prefix.
TEX = (("cdot", "*"), ("times", "*"), ("div", "/"), ("pi", "pi"), ("infty", "oo"), ("inf", "oo"), ("left", ""), ("right", ""), ("le", "<="), ("ge", ">="))
# Patterns of fences, of marks of markdown, and of equations.
THOUGHT = r"(?is)<think>.*?</think>"
FIRST_FENCE, ANY_FENCE = r"(?s)```(?:python|py)?\s*\n(.*?)```", r"(?s)```(?:python3?|py)?[ \t]*\n?(.*?)```"
BULLET, HEADER, WRAP, INLINE = r"^[-*•·]\s*", r"^(?:#{1,6}|>)+\s*", r"^\*{1,2}(.+?)\*{1,2}$", r"(?:\*{1,3}|`+|_{1,2})"
CLAUSES, EQUATION = r"[\n;]|\. |, ", r"^\s*([A-Za-z_][A-Za-z_0-9]*|\([^()=]+\)|[^=]{1,60})\s*=\s*([^=<>!]+)$"
NAME_LINE = r"^\s*(?:[-*\d+.)\s]*)\s*([A-Za-z][A-Za-z0-9 _/&-]{2,60})\s*$"

BLANK = " \t\n\r\f\x0b"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column | str) -> Column:
    """Without leading and trailing blanks of any kind."""
    return F.btrim(_c(x), F.lit(BLANK))


def key(x: Column | str) -> Column:
    """A key as it is compared everywhere: stripped and lower-cased, null where blank."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def truthy(x: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(_c(x), F.lit(""))


def alias(names: list[str], columns: list[str], default: Column | None = None) -> Column:
    """The first non-null of alternative field names, over those that exist."""
    found = [F.col(n) for n in names if n in columns]
    return F.coalesce(*found, default if default is not None else F.lit(None)) if found else (default if default is not None else F.lit(None))


def number_or_null(text: Column | str) -> Column:
    """A JSON scalar as a number; booleans count as 1 and 0, other texts are null."""
    x = F.lower(_c(text))
    return F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(_c(text).try_cast("double"))


def nan_to_null(x: Column | str) -> Column:
    return F.when(F.isnan(_c(x)), None).otherwise(_c(x))


def score_or_correct(score: Column, correct: Column) -> Column:
    """The score where it reads as a number, else 1 or 0 by correctness."""
    return F.coalesce(score.try_cast("double"), F.when(correct, 1.0).otherwise(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clip_relative(new: Column, old: Column, share: float = 0.3) -> Column:
    """new, moved to within ``share`` of old; any value where old is 0."""
    a, b = old * (1 - share), old * (1 + share)
    return F.when(old == 0, new).when(new.isNotNull() & old.isNotNull(), F.greatest(F.least(a, b), F.least(F.greatest(a, b), new)))


def domain_key(*names: Column) -> Column:
    """The first name that is neither null nor empty, else "_"."""
    return F.coalesce(*[truthy(n) for n in names], F.lit("_"))


def subdomain_key(domain: Column, sub: Column) -> Column:
    return F.when(truthy(sub).isNotNull(), F.concat_ws("/", domain, sub)).otherwise(F.coalesce(truthy(domain), F.lit("unknown")))


def question_id(prompt: Column, answer: Column) -> Column:
    """Sixteen hex digits that name a question by its prompt and canonical answer; a null answer counts as empty."""
    return F.substring(F.sha2(F.concat(prompt, F.lit("|"), F.coalesce(answer, F.lit(""))), 256), 1, 16)


def content_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]))


def record_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16)


def fingerprint(prompt: Column, reference: Column, names: Column) -> Column:
    """A name for a bundle that does not depend on the order of its properties."""
    return F.substring(F.sha2(F.concat_ws("\n", F.coalesce(prompt, F.lit("")), F.coalesce(reference, F.lit("")), F.array_join(F.array_sort(names), "|")), 256), 1, 16)


def task_name(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(x: Column | str) -> Column:
    """All runs of ASCII letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), F.lit(1))


def signature(x: Column | str) -> Column:
    """The distinct tokens of more than two characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(x), lambda t: F.length(t) > 2)))


def significant_words(x: Column | str) -> Column:
    """Distinct identifier-like words of more than three characters that are no stopwords, sorted."""
    w = F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_except(F.filter(w, lambda t: F.length(t) > 3), F.array(*[F.lit(s) for s in STOPWORDS])))


def vote_answer(x: Column, domain: Column) -> Column:
    """An answer in the form in which votes are counted."""
    t = F.lower(strip(x))
    t = F.regexp_replace(t, VOTE_PREFIX, "")
    t = F.regexp_replace(F.regexp_replace(t, BOX_OPENS, ""), BOX_ENDS, "")
    t = F.btrim(t, F.lit(" .`\"'"))
    number = F.regexp_extract(t, VOTE_NUMBER, 1)
    flat = F.substring(F.regexp_replace(t, r"\s+", " "), 1, 80)
    first = strip(F.regexp_replace(F.element_at(F.split(t, "\n"), 1), r"\s+", " "))
    return F.when((domain == "math") & (number != "") & (F.length(t) <= F.length(number) + 10), number).when(domain == "code", first).otherwise(flat)


def latex_answer(x: Column) -> Column:
    """An answer without LaTeX wrappers, prose prefix, unit and end punctuation."""
    s = strip(x)
    boxed = F.regexp_extract(s, BOXED, 1)
    s = F.when(s.rlike(BOXED), strip(boxed)).otherwise(s)
    s = strip(F.regexp_replace(s, DOLLARS, ""))
    s = strip(F.regexp_replace(s, ANSWER_IS, ""))
    s = F.regexp_replace(s, FRACTION, "(($1)/($2))")
    s = F.regexp_replace(s, ROOT, "sqrt($1)")
    for tex, plain in TEX:
        s = F.replace(s, F.lit("\\" + tex), F.lit(plain))
    return strip(F.rtrim(strip(F.regexp_replace(s, UNITS, "")), F.lit(".!?,;:")))


def numbers(x: Column, pattern: str = r"(-?\d+(?:\.\d+)?)") -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def last_number(x: Column) -> Column:
    """The last number as written, without thousands separators; the stripped text where there is none."""
    return F.coalesce(F.try_element_at(numbers(F.replace(x, F.lit(","), F.lit(""))), F.lit(-1)), strip(x))


def after_last(x: Column, marker: str) -> Column:
    """The text after the last occurrence of ``marker``, null where it has none."""
    parts = F.split(x, F.lit(r"\Q" + marker + r"\E"))
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


# Marks before a final answer.
ANSWER_MARKS = ("final answer:", "answer:", "answer is", "result:", "=")


def final_numeric(x: Column) -> Column:
    """The number that a text gives in the end: the last one after the rightmost answer mark, else the last one at all."""
    low = F.lower(x)
    pattern = r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"
    tails = F.array_compact(F.array(*[after_last(low, m) for m in ANSWER_MARKS]))
    tail = F.array_min(F.transform(tails, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    own, all_ = F.try_element_at(numbers(tail, pattern), F.lit(-1)), F.try_element_at(numbers(low, pattern), F.lit(-1))
    return F.replace(F.coalesce(own, all_), F.lit(","), F.lit("")).try_cast("double")


# Marks before a chosen letter.
CHOICE_MARKS = ("final answer:", "answer:", "answer is", "the answer is", "correct answer is", "choose")


def choice_letter(x: Column) -> Column:
    """The letter A to D that a text settles on: after the first mark that has one, else the last that stands alone."""
    upper = [F.regexp_extract(after_last_ci(x, m), r"\b([A-D])\b", 1) for m in CHOICE_MARKS]
    lone = F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z])([A-D])(?![A-Za-z])"), F.lit(1)), F.lit(-1))
    return F.coalesce(*[truthy(u) for u in upper], lone)


def after_last_ci(x: Column, marker: str) -> Column:
    """The text, in its own case, after the last occurrence of a lower-case marker in any case."""
    tail = after_last(F.lower(x), marker)
    return F.when(tail.isNotNull(), F.right(x, F.length(tail)))


def parse_number(x: Column) -> Column:
    """Integers, decimals, thousands separators and fractions; null for anything else and for division by zero."""
    t = F.replace(strip(x), F.lit(","), F.lit(""))
    parts = F.split(t, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).when(F.size(parts) == 1, t.try_cast("double"))


def hash_marked_answer(x: Column) -> Column:
    return F.coalesce(strip(after_last(x, "####")), strip(x))


def first_fence(x: Column) -> Column:
    """The first fenced block, without thoughts; the whole text where there is none."""
    t = F.regexp_replace(x, THOUGHT, "")
    return F.when(t.rlike(FIRST_FENCE), F.regexp_extract(t, FIRST_FENCE, 1)).otherwise(t)


def longest_fence(x: Column) -> Column:
    """The longest fenced block, stripped; else everything from the first definition on; else empty."""
    blocks = F.transform(F.regexp_extract_all(x, F.lit(ANY_FENCE), F.lit(1)), strip)
    best = F.array_max(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))["b"]
    return F.coalesce(best, F.when(F.instr(x, "def ") > 0, F.regexp_extract(x, r"(?s)(def .*)", 1)).otherwise(F.when(x.isNotNull(), "")))


def without_thoughts(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?is)<think\b[^>]*>.*?</think\s*>", ""), r"(?i)</?\s*think\b[^>]*>", "")


def plain_line(x: Column) -> Column:
    """A line without bullet, header marks and a wrap of asterisks."""
    s = strip(F.regexp_replace(strip(x), BULLET, ""))
    s = strip(F.regexp_replace(s, HEADER, ""))
    return F.when(s.rlike(WRAP), strip(F.regexp_extract(s, WRAP, 1))).otherwise(s)


def plain_inline(x: Column) -> Column:
    return strip(F.regexp_replace(x, INLINE, ""))


def plain_text(x: Column) -> Column:
    """A text with every line plain."""
    return F.array_join(F.transform(F.split(x, "\n"), lambda line: plain_inline(plain_line(line))), "\n")


def modal_share(x: Column) -> Column:
    """The share of the most frequent token; 0 for fewer than five tokens. Runs over the sorted tokens once."""
    zero = F.struct(F.lit("").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["at"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return let(F.array_sort(tokens(x)), lambda t: F.when(F.size(t) >= 5, F.aggregate(t, zero, step)["best"] / F.size(t)).otherwise(0.0))


def is_gibberish(x: Column) -> Column:
    """Shorter than ten characters, hardly any letters and digits, or one token over and over. Null counts."""
    def judge(s: Column) -> Column:
        signal = F.length(F.regexp_replace(s, r"[^\p{L}\p{Nd}]", ""))
        return (F.length(s) < 10) | ((F.length(s) > 20) & (signal / F.greatest(F.length(s), F.lit(1)) < 0.3)) | (modal_share(s) > 0.6)

    return F.coalesce(let(strip(x), judge), F.lit(True))


def is_refusal(x: Column) -> Column:
    """Declines within its first 300 characters and shows no worked solution anywhere."""
    return F.coalesce(F.substring(x, 1, 300).rlike(REFUSAL) & ~x.rlike(SOLUTION), F.lit(False))


def clean_problem(x: Column) -> Column:
    """A problem without solution text that leaked into it; empty where nothing usable comes before that, null for null."""
    p = strip(x)
    head = F.regexp_instr(p, F.lit(LEAK), F.lit(0))
    # the mark itself stays out, the punctuation before it stays in
    cut = F.when(F.regexp_extract(p, LEAK, 0).startswith("\n"), head - 1).otherwise(head + 1)
    bad = is_refusal(p) | is_gibberish(p) | p.rlike(LEAK_AT_START)
    return F.when(p.isNull(), None).when(bad, "").when(head == 0, p).when(cut > 20, strip(F.left(p, cut))).otherwise("")


def admission(*texts: Column) -> Column:
    """The first phrase by which any of the texts admits its error, or empty."""
    blob = F.lower(F.concat_ws("\n", *texts))
    return F.coalesce(F.try_element_at(F.filter(F.array(*[F.lit(a) for a in ADMISSIONS]), lambda a: F.contains(blob, a)), F.lit(1)), F.lit(""))


def sample_issues(prompt: Column, response: Column, steps: Column, least_steps: int) -> Column:
    """What is wrong with the form of a sample; empty for none. steps: array of texts."""
    n = F.coalesce(F.size(steps), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(strip(prompt), F.lit("")) == "", "missing prompt"),
            F.when(F.coalesce(strip(response), F.lit("")) == "", "missing conclusion"),
            F.when(n < least_steps, F.concat(F.lit("only "), n.cast("string"), F.lit(f" steps (need {least_steps})"))),
            F.when(F.exists(steps, lambda s: F.coalesce(strip(s), F.lit("")) == ""), "empty step"),
            F.when((F.length(response) > 0) & is_gibberish(response), "conclusion is gibberish"),
            F.when((F.length(prompt) > 0) & is_gibberish(prompt), "prompt is gibberish"),
        )
    )


def occurrences(x: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def hedge_confidence(x: Column) -> Column:
    """0.5, raised by assertions and lowered by hedges per hundred words, within 0 and 1; 0 for an empty text."""
    def score(r: Column) -> Column:
        total = lambda phrases: reduce(lambda a, b: a + b, [F.when(F.contains(r, F.lit(p)), occurrences(r, p)).otherwise(0) for p in phrases])
        words = F.greatest(F.size(F.filter(F.split(r, r"\s+"), lambda w: w != "")), F.lit(1))
        return 0.5 + 0.1 * (total(ASSERTIONS) / words * 100) - 0.15 * (total(HEDGES) / words * 100)

    return F.when(F.coalesce(x, F.lit("")) == "", 0.0).otherwise(clamp(let(F.lower(x), score)))


def confidence_mark(x: Column) -> Column:
    """The value of the last mark such as [C:0.85], null without one."""
    v = F.try_element_at(F.regexp_extract_all(x, F.lit(r"\[\s*[Cc]\s*:\s*([01](?:\.\d+)?|0?\.\d+)\s*\]"), F.lit(1)), F.lit(-1)).try_cast("double")
    return F.when(v.between(0, 1), v)


# Categories of parse issues, each with the phrases of which all are asked for; the first that holds counts.
ISSUES = (
    ("empty_response", ("empty response",)),
    ("missing_block", ("missing problem",)),
    ("missing_block", ("missing properties",)),
    ("no_properties", ("no properties parsed",)),
    ("bad_difficulty", ("difficulty", "< 0.3")),
    ("bad_difficulty", ("difficulty", "not a float")),
    ("bad_axis", ("axis", "not in")),
    ("class_coverage_short", ("independence_classes",)),
    ("no_reachable_class", ("reachability",)),
    ("too_few_properties", ("only", "properties")),
)


def issue_category(x: Column) -> Column:
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, phrases)).alias("phrases")) for name, phrases in ISSUES])
    held = F.filter(rules, lambda r: F.forall(r["phrases"], lambda p: F.contains(F.lower(x), p)))
    return F.coalesce(F.try_element_at(held, F.lit(1))["name"], F.lit("other"))


def equations(x: Column) -> Column:
    """Texts "left = right" of the equations in prose: one line or clause each, sides trimmed, at least one of them short."""
    clauses = F.filter(F.split(x, CLAUSES), lambda c: c.rlike(EQUATION))
    return F.transform(clauses, lambda c: F.concat(strip(F.regexp_extract(c, EQUATION, 1)), F.lit(" = "), strip(F.regexp_extract(c, EQUATION, 2))))


def name_lines(x: Column, limit: int = 20) -> Column:
    """Names listed one a line, distinct after normalising, in order, at most ``limit``."""
    names = F.transform(F.filter(F.split(x, "\n"), lambda s: s.rlike(NAME_LINE)), lambda s: task_name(F.regexp_extract(s, NAME_LINE, 1)))
    return F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, limit)


def peer_vote(x: Column) -> Column:
    """VALID or INVALID; a text that does not commit is INVALID. Null counts as such a text."""
    first = F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)\b(VALID|INVALID)\b", 1))
    reasoned = F.coalesce(x, F.lit("")).rlike(r"(?is)INVALID\s*[:\-–—]\s*.{1,240}")
    return F.when(~reasoned & (first == "VALID"), "VALID").otherwise("INVALID")


def difficulty_bucket(x: Column) -> Column:
    return F.when(x <= 2, "easy").when(x <= 5, "medium").when(x <= 8, "hard").when(x.isNotNull(), "expert")


def answer_type(check: Column) -> Column:
    return F.when(check.isin("numeric", "numeric_set"), "numeric").when(check == "math_equiv", "symbolic").when(check == "code_executes", "code").when(check.isin("contains", "semantic", "regex", "exact"), "enum").otherwise("freeform")


def invariant_tags(domain: Column, check: Column) -> Column:
    one = check.isin("numeric", "numeric_set", "math_equiv", "code_executes", "exact")
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(one, "deterministic"),
                F.when(one, "has_unique_answer"),
                F.when(check.isin("numeric", "numeric_set", "math_equiv"), "requires_calculation"),
                F.when(check == "code_executes", "requires_execution"),
                F.when(domain.isin("logic", "reasoning"), "requires_logical_deduction"),
                F.when(domain == "math", "requires_calculation"),
            )
        )
    )


def verdict(passed: Column, text: Column) -> Column:
    """PASS, FAIL or ERROR from a boolean, else from a verdict text, else ERROR."""
    return F.when(passed, "PASS").when(~passed, "FAIL").when(F.upper(text).isin("PASS", "FAIL", "ERROR"), F.upper(text)).otherwise("ERROR")


# Classes of independent evidence that count, and those that reach the answer itself.
CLASSES = (
    "exec.behavioral", "algebra.symbolic", "smt.logical", "structural.static", "transform.semantic", "roundtrip", "perturbation.local",
    "conservation.global", "search.bounded", "dimensional.physical", "simulation.numerical", "proof.formal", "peer.consensus",
)
REACHING = ("exec.behavioral", "algebra.symbolic")


def reaches(classes: Column) -> Column:
    return F.coalesce(F.arrays_overlap(classes, F.array(*[F.lit(c) for c in REACHING])), F.lit(False))


def covers(classes: Column, least: int = 3) -> Column:
    return F.coalesce(F.size(F.array_intersect(classes, F.array(*[F.lit(c) for c in CLASSES]))) >= least, F.lit(False))


def has_warning(warnings: Column, name: str = "any_fail") -> Column:
    return F.coalesce(F.exists(warnings, lambda w: F.contains(w, F.lit(name))), F.lit(False))
