"""Checks of candidates by named properties: a registry of pure functions, applied in Arrow batches.

A check takes a prompt and a candidate and returns a boolean, (boolean, reason), or PASS, FAIL or ERROR. Checks never run the candidate.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Check = Callable[[str, str], object]
_CHECKS: dict[str, tuple[str, Check]] = {}


def register(name: str, independence_class: str) -> Callable[[Check], Check]:
    """Decorator: make a check known under a name; a name can be taken once."""

    def keep(check: Check) -> Check:
        if name in _CHECKS:
            raise ValueError(f"{name} is taken")
        _CHECKS[name] = (independence_class, check)
        return check

    return keep


def coerce(result: object) -> tuple[str, str]:
    reason = ""
    if isinstance(result, tuple) and len(result) == 2:
        result, reason = result[0], str(result[1])
    if isinstance(result, bool):
        return ("PASS" if result else "FAIL"), reason
    if isinstance(result, str) and result.upper() in ("PASS", "FAIL", "ERROR"):
        return result.upper(), reason
    return "ERROR", f"unrecognised result of type {type(result).__name__}"


@register("parses", "structural.static")
def _parses(prompt: str, candidate: str) -> object:
    code = candidate.replace("```python", "").replace("```", "")
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return False, type(e).__name__
    return True


@register("brackets_balance", "structural.static")
def _balanced(prompt: str, candidate: str) -> object:
    stack = []
    for c in candidate:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() + c not in ("()", "[]", "{}")):
            return False, f"unmatched {c}"
    return not stack, "" if not stack else f"open {stack[-1]}"


@register("not_the_prompt", "transform.semantic")
def _own(prompt: str, candidate: str) -> object:
    return " ".join(prompt.lower().split()) != " ".join(candidate.lower().split())


@register("not_empty", "structural.static")
def _full(prompt: str, candidate: str) -> object:
    return bool(candidate.strip())


def _run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, props, classes, verdicts, reasons = [], [], [], [], []
        for ident, prompt, candidate in zip(*(b.column(i).to_pylist() for i in range(3))):
            for name in names:
                kind, check = _CHECKS[name]
                try:
                    v, why = coerce(check(prompt or "", candidate or ""))
                except Exception as e:  # a check that fails says nothing about the candidate
                    v, why = "ERROR", type(e).__name__
                ids.append(ident)
                props.append(name)
                classes.append(kind)
                verdicts.append(v)
                reasons.append(why)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(props, pa.string()), pa.array(classes, pa.string()), pa.array(verdicts, pa.string()), pa.array(reasons, pa.string())], names=["ident", "property", "class", "verdict", "reason"])


def apply_checks(rows: DataFrame, ident: str, prompt: str, candidate: str, names: list[str] | None = None) -> DataFrame:
    """ident, property, class, verdict, reason: every named check on every row. Null texts count as empty."""
    wanted = list(_CHECKS) if names is None else names
    unknown = [n for n in wanted if n not in _CHECKS]
    if unknown:
        raise KeyError(f"unknown checks {unknown}")
    r = rows.select(F.col(ident).cast("long"), prompt, candidate)
    return r.mapInArrow(lambda batches: _run(batches, wanted), "ident long, property string, class string, verdict string, reason string")


# -- arithmetic ---------------------------------------------------------------------------------------------------

_POINTS = (0.37, 1.0, 2.5, -1.3, 4.0, 7.2)


def _value(node: ast.AST, x: float) -> complex | float:
    import cmath

    calls = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "log": cmath.log, "ln": cmath.log, "abs": abs}
    match node:
        case ast.Expression():
            return _value(node.body, x)
        case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return v
        case ast.Name(id="pi"):
            return cmath.pi
        case ast.Name(id="e"):
            return cmath.e
        case ast.Name(id=name):
            return x + (sum(map(ord, name)) % 97) / 31  # each name its own value
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -_value(a, x)
        case ast.UnaryOp(op=ast.UAdd(), operand=a):
            return _value(a, x)
        case ast.BinOp(left=a, op=op, right=b):
            p, q = _value(a, x), _value(b, x)
            match op:
                case ast.Add():
                    return p + q
                case ast.Sub():
                    return p - q
                case ast.Mult():
                    return p * q
                case ast.Div():
                    return p / q
                case ast.Pow() if abs(q) <= 64:
                    return complex(p) ** q
        case ast.Call(func=ast.Name(id=name), args=[a], keywords=[]) if name in calls:
            return calls[name](_value(a, x))
    raise ValueError("no arithmetic expression")


def equivalent(a: str | None, b: str | None) -> bool | None:
    """Whether two arithmetic expressions agree at probe points; null if either cannot be read. Parsed, never evaluated as code."""
    try:
        one, two = (ast.parse((t or "").strip().replace("^", "**"), mode="eval") for t in (a, b))
        seen = 0
        for x in _POINTS:
            try:
                p, q = _value(one, x), _value(two, x)
            except (ZeroDivisionError, OverflowError):
                continue
            if abs(p - q) > 1e-9 * max(1.0, abs(p), abs(q)):
                return False
            seen += 1
        return True if seen else None
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
        return None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [equivalent(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.bool_())], names=["ident", "equivalent"])


def equivalences(rows: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """ident, equivalent for pairs of expressions."""
    return rows.select(F.col(ident).cast("long").alias("ident"), a, b).mapInArrow(_compare, "ident long, equivalent boolean")
