"""Graders and corruptions as native columns; a grader gives null where there is nothing to compare."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.functions.parsing import ORDINALS


def numeric_exact(response: Column, want: Column, tol: float = 1e-4) -> Column:
    """The final number of the response against a canonical one: within one half for whole numbers, else within a relative tolerance."""
    got, w = T.final_numeric(response), F.replace(want, F.lit(","), F.lit("")).try_cast("double")
    close = F.abs(got - w) <= F.greatest(tol * F.greatest(F.abs(got), F.abs(w)), tol * F.greatest(F.lit(1.0), F.abs(w)))
    return F.when(w.isNull(), F.contains(response, T.strip(want))).when(F.contains(want, F.lit(".")), close).otherwise(F.abs(got - w) < 0.5)


def _flat(x: Column) -> Column:
    return F.regexp_replace(F.lower(T.strip(x)), r"\s+", " ")


def whole_phrase(text: Column, phrase: Column) -> Column:
    """The phrase occurs in the text and is no part of longer words. Both are taken as they are."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)")))


def string_in_tail(response: Column, want: Column, tail: int = 300) -> Column:
    return whole_phrase(_flat(F.right(T.strip(response), F.lit(tail))), _flat(want))


# Marks of a conclusion.
CONCLUDES = ("conclusion:", "answer:", "therefore,", "therefore ", "so,", "so the answer")


def contains_answer(response: Column, want: Column) -> Column:
    """The answer occurs as whole words; one of up to three characters only in a conclusion, the first or one of the last three sentences."""
    r, w = F.replace(F.lower(T.strip(response)), F.lit("**"), F.lit("^")), F.lower(T.strip(want))
    sentences = F.filter(F.transform(F.split(r, r"[.!?\n]"), T.strip), lambda s: s != "")
    places = F.concat(F.slice(sentences, 1, 1), F.slice(sentences, F.greatest(F.size(sentences) - 2, F.lit(1)), F.lit(3)), F.array_compact(F.array(*[T.after_last(r, m) for m in CONCLUDES])))
    return F.when(F.length(w) <= 3, F.exists(places, lambda p: whole_phrase(p, w))).otherwise(whole_phrase(r, w))


def numeric_match(response: Column, want: Column, tol: float = 1e-3) -> Column:
    """Any number of the response is the wanted one, up to a relative tolerance."""
    w = T.parse_number(want)
    seen = T.numbers(F.regexp_replace(response, r"(?<=\d),(?=\d{3})", ""))
    return F.exists(seen, lambda x: F.abs(x.try_cast("double") - w) / F.greatest(F.abs(w), F.lit(1.0)) <= tol)


def numeric_set_match(response: Column, want: Column, tol: float = 1e-3) -> Column:
    """Every wanted number is among those of the response; false without wanted numbers."""
    wanted, seen = F.transform(T.numbers(want), lambda x: x.try_cast("double")), F.transform(T.numbers(response), lambda x: x.try_cast("double"))
    return (F.size(wanted) > 0) & F.forall(wanted, lambda w: F.exists(seen, lambda s: F.abs(s - w) / F.greatest(F.abs(w), F.lit(1.0)) <= tol))


def canonical_grade(domain: Column, response: Column, canonical: Column) -> Column:
    """The final answer of a sample against the canonical one, by the rule of its domain; null where there is no answer to compare, and for code, which is not run.

    math: equal without wrappers, or as numbers, of two sides "name = value" the values. Others: equal up to case and blanks, or one holds the other.
    """
    bare = lambda x: T.latex_answer(x)
    value = lambda x: T.strip(F.regexp_replace(x, r"^\s*[A-Za-z_][A-Za-z_0-9]*\s*=(?!=)\s*", ""))
    name = lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_][A-Za-z_0-9]*)\s*=(?!=)", 1)
    g, c = bare(response), bare(canonical)
    same_name = name(g) == name(c)
    a, b = F.when(same_name, value(g)).otherwise(g), F.when(same_name, value(c)).otherwise(c)
    x, y = T.parse_number(a), T.parse_number(b)
    math = F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(y)), F.lower(a) == F.lower(b))
    r, w = _flat(response), _flat(canonical)
    other = (r == w) | F.contains(r, w) | F.contains(w, r)
    return F.when((r != "") & (w != ""), F.when(domain == "math", math).when(domain != "code", other))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blended_score(correct: Column, logprob: Column) -> Column:
    """A right answer scores above one half, by its probability, a wrong one below; without a probability 1 or 0."""
    p = F.exp(logprob)
    ok = logprob.isNotNull() & ~F.isnan(logprob)
    return F.when(ok & correct, 0.5 + 0.5 * p).when(ok, 0.5 * p).otherwise(F.when(correct, 1.0).otherwise(0.0))


def numeric_corruptions(x: Column) -> Column:
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), v.cast("double").alias("mutated"))
    return F.array(one("off_by_one", x + 1), one("off_by_one_neg", x - 1), one("sign_flip", -x), one("factor_of_two", x * 2), one("zero", F.lit(0.0)))


def text_corruptions(x: Column, ident: Column) -> Column:
    """Negated, reversed, emptied and shuffled (in an order of hashes) variants of a text."""
    w = F.split(x, r"\s+")
    head = F.lower(F.element_at(w, 1))
    negated = F.when(head.isin("yes", "true", "correct"), F.concat(F.lit("no "), x)).when(head.isin("no", "false", "incorrect"), F.concat(F.lit("yes "), x)).otherwise(F.concat(F.lit("not "), x))
    shuffled = F.array_join(F.transform(F.array_sort(F.transform(w, lambda t, i: F.struct(F.xxhash64(t, i, ident).alias("h"), t.alias("t")))), lambda s: s["t"]), " ")
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("mutated"))
    every = F.array(one("negated", negated), one("reversed", F.array_join(F.reverse(w), " ")), one("empty", F.lit("")), one("shuffled", shuffled))
    return F.filter(every, lambda s: (s["kind"] != "shuffled") | (F.size(w) > 3))


class _Edit(ast.NodeTransformer):
    """One kind of edit at one place: the ``at``-th node that it fits."""

    # Comparisons and operators that are swapped for each other.
    SWAPS = {ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.And: ast.Or, ast.Or: ast.And}

    def __init__(self, kind: str, at: int):
        self.kind, self.left = kind, at

    def _due(self) -> bool:
        self.left -= 1
        return self.left == -1

    def visit_Compare(self, node: ast.Compare):
        self.generic_visit(node)
        if self.kind == "comparison" and type(node.ops[0]) in self.SWAPS and self._due():
            node.ops[0] = self.SWAPS[type(node.ops[0])]()
        return node

    def _operator(self, node):
        self.generic_visit(node)
        if self.kind == "operator" and type(node.op) in self.SWAPS and self._due():
            node.op = self.SWAPS[type(node.op)]()
        return node

    visit_BinOp = visit_BoolOp = visit_AugAssign = _operator

    def visit_Constant(self, node: ast.Constant):
        if self.kind == "constant" and type(node.value) is int and self._due():
            return ast.Constant(node.value + 1)
        return node

    def visit_Return(self, node: ast.Return):
        self.generic_visit(node)
        if self.kind == "return" and node.value is not None and self._due():
            return ast.Return(ast.Constant(None))
        return node


EDITS = ("comparison", "operator", "constant", "return")


def edited_programs(source: str | None, seed: int) -> list[tuple[str, str]]:
    """(kind, program) with one edit of each kind that fits, at a place that depends only on the seed; none for text that is no program. Nothing is run."""
    out = []
    try:
        plain = ast.unparse(ast.parse(source or ""))
        for kind in EDITS:
            fits = 1
            while ast.unparse(_Edit(kind, fits).visit(ast.parse(plain))) != plain:
                fits += 1
            new = ast.unparse(ast.fix_missing_locations(_Edit(kind, (seed + len(out)) % fits).visit(ast.parse(plain))))
            if new != plain:
                out.append((kind, new))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return out


def _edited(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in edited_programs(t, seed)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["ident", "kind", "mutated"])


def program_corruptions(rows: DataFrame, ident: str, code: Column, seed: int = 0) -> DataFrame:
    """ident, kind, mutated: programs with one changed comparison, operator, whole number or return."""
    r = rows.select(F.col(ident).cast("long").alias("ident"), code.alias("c")).filter(F.coalesce(F.col("c"), F.lit("")) != "")
    return r.mapInArrow(partial(_edited, seed=seed), "ident long, kind string, mutated string").withColumnRenamed("ident", ident)


def hash_embeddings(rows: DataFrame, ident: str, text: str, dim_bits: int = 6) -> DataFrame:
    """ident, embedding: counts of tokens by the low bits of their SHA-1, as a unit vector of doubles.

    A text without tokens gives the first unit vector, a null text no row. Counting is by partial aggregates over (ident, bucket).
    """
    dim = 1 << dim_bits
    r = rows.filter(F.col(text).isNotNull()).select(ident, F.explode_outer(T.tokens(text)).alias("_t"))
    bucket = F.coalesce(F.conv(F.substring(F.sha1("_t"), 33, 8), 16, 10).cast("long") % dim, F.lit(0)).cast("int")
    n = r.groupBy(ident, bucket.alias("_b")).agg(F.count("*").cast("double").alias("_n"))
    g = n.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    return g.select(ident, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_norm")).alias("embedding"))


# Words that contradict each other when one stands in each of two sentences.
OPPOSITES = (
    ("is", "is not"), ("are", "are not"), ("can", "cannot"), ("equals", "does not equal"), ("increases", "decreases"), ("increasing", "decreasing"), ("positive", "negative"), ("always", "never"),
    ("possible", "impossible"), ("true", "false"), ("greater", "less"), ("convergent", "divergent"), ("converges", "diverges"), ("exists", "does not exist"), ("even", "odd"), ("finite", "infinite"),
)


STOPWORDS = frozenset(T.STOPWORDS)
_SENTENCE_END = re.compile(r"[!?;\n]+|\.(?!\d)|(?<!\d)\.")
_WORD = re.compile(r"[a-z_][a-z0-9_]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:/\d+)?")
_FOR_ALL = re.compile(r"\b(?:for\s+all|every|each|any)\b")
_SOME_NOT = re.compile(r"\b(?:there\s+exists?|some)\b.*?\bnot\b")
_REFERS = re.compile(r"\bstep\s*\d+\b|\b(?:above|previous|earlier|prior)\b")
_ASSIGNED = re.compile(r"(?<![\w.])([a-z_]\w*)\s*=(?!=)\s*([-+(]*\.?\d[-+*/^().\d ]*)(?!\w)")
_MAY_BEGIN = re.compile(rf"^[^\w\n]*(?:step\s*\d|\d{{1,3}}|{'|'.join(ORDINALS)}|justification|because|reason|rationale|this\s|the\s+reason)", re.I | re.M)
_SIDES = [(frozenset(a.split()), frozenset(b.split())) for a, b in OPPOSITES]


def _significant(text: str) -> set[str]:
    return {w for w in _WORD.findall(text) if len(w) > 3 and w not in STOPWORDS}


def _sentence_conflicts(text: str) -> int:
    """Pairs of sentences, near or far, that contradict each other. Equal sentences are compared once and count as often as they stand."""
    times = {t: k for t, k in Counter(_SENTENCE_END.split(text.lower())).items() if not t.isspace()}
    texts, n, said = list(times), list(times.values()), [frozenset(_WORD.findall(t)) for t in times]
    every_word = frozenset().union(*said)
    pairs: set[tuple[int, int]] = set()
    for a, b in _SIDES:
        if not (a <= every_word and b <= every_word):
            continue
        no = [(i, w - a - b) for i, w in enumerate(said) if b <= w]
        yes = [(i, w - a - b) for i, w in enumerate(said) if a <= w and not b <= w] if no else []
        pairs |= {(min(i, j), max(i, j)) for i, x in yes for j, y in no if len(x & y) >= 0.5 * max(1, min(len(x), len(y)))}
    some_not = [(j, said[j] - STOPWORDS) for j, t in enumerate(texts) if "not" in said[j] and _SOME_NOT.search(t)]
    if some_not:
        pairs |= {(min(i, j), max(i, j)) for i, t in enumerate(texts) if _FOR_ALL.search(t) for j, y in some_not if len(said[i] & y) >= 2}
    return sum(n[i] * n[j] if i < j else n[i] * (n[i] - 1) // 2 for i, j in pairs)


def _reassigned(text: str) -> int:
    """Names that are given two different numbers."""
    from evalloom.operators.properties import equivalent

    first: dict[str, str] = {}
    other: set[str] = set()
    for name, value in _ASSIGNED.findall(text.lower()):
        value = value.rstrip(" .")
        if name not in other and value != first.setdefault(name, value) and equivalent(first[name], value) is False:
            other.add(name)
    return len(other)


def _circular(content: str, reason: str) -> bool:
    """The reason only says the step again."""
    c, r = (re.sub(r"\W+", " ", x).strip() for x in (content, reason))
    if not c or not r:
        return False
    if r in c or c in r:
        return True
    sc, sr = _significant(content), _significant(reason)
    return bool(sr) and len(sr & sc) > 0.8 * len(sr | sc) and len(sr - sc) <= 1


def _step_faults(text: str) -> tuple[int, int]:
    """Steps with a circular reason, and steps after the first that take up nothing of any step before."""
    from evalloom.functions.parsing import parse_chain

    # without a line that may begin a step or a reason there is one step at most, which has no reason
    if not _MAY_BEGIN.search(text):
        return 0, 0
    circular = ungrounded = 0
    before: list[tuple[set[str], set[str], set[str]]] = []
    for step in parse_chain(text)["chain"]:
        content, reason = step["content"].lower(), "" if step["justification"] == "implicit" else step["justification"].lower()
        circular += _circular(content, reason)
        whole = f"{content} {reason}"
        own = _significant(whole), set(_NUMBER.findall(whole)), {w for w in _WORD.findall(whole) if re.search(r"\d", w)}
        if before and not _REFERS.search(whole):
            ungrounded += not any(0.2 * len(own[0] & w) + 0.3 * len(own[1] & n) + 0.25 * len(own[2] & m) >= 0.3 for w, n, m in reversed(before))
        before.append(own)
    return circular, ungrounded


def _conflict_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, steps = b.column(1).to_pylist(), b.column(2).to_pylist()
        faults = [(None, None) if t is None else _step_faults(t) for t in steps]
        found = [[None if t is None else _sentence_conflicts(t) for t in texts], [None if t is None else _reassigned(t) for t in texts], [c for c, _ in faults], [u for _, u in faults]]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in found]], names=["ident", "conflicts", "reassigned", "circular", "ungrounded"])


def contradictions(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, conflicts, reassigned, circular, ungrounded; null for null texts.

    conflicts: pairs of sentences, of all of the text, of which one says and the other denies the same, or one holds for all and the other
    not for some. reassigned: names given two different numbers. circular, ungrounded: steps of the parsed chain whose reason
    repeats them, and later steps without a link to any step before.
    """
    r = rows.select(F.col(ident).cast("long").alias("ident"), F.col(text).alias("t"), T.without_thoughts(text).alias("s"))
    return r.mapInArrow(_conflict_rows, "ident long, conflicts long, reassigned long, circular long, ungrounded long").withColumnRenamed("ident", ident)
