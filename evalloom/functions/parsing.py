"""Parsers that keep state from line to line: labelled blocks natively, step chains in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = pa.struct([("step_number", pa.int32()), ("content", pa.string()), ("justification", pa.string()), ("assumptions", pa.list_(pa.string())), ("confidence", pa.float64())])
CHAIN = "ident long, n_steps int, conclusion string, issues string, confidence double, chain array<struct<step_number:int,content:string,justification:string,assumptions:array<string>,confidence:double>>"

# What opens each kind of line, in the order in which they are tried, and ordinals.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
LINES = (
    ("conclusion", re.compile(r"^(?:#{1,4}\s*|>\s*|\*{1,2})?\s*(?:conclusion|final\s+answer|in\s+conclusion|final\s+result|the\s+answer\s+is)\s*\*{0,2}\s*[:\-–—]?\s*(?P<text>.*)$", re.I)),
    ("step", re.compile(r"^(?:\*{1,2}|#{1,4}\s*)?step\s*(?P<no>\d{1,2})(?!\d)\s*\*{0,2}\s*[.):\-–—]?\s*(?P<text>.*)$", re.I)),
    ("step", re.compile(r"^\(?(?P<no>\d{1,2})\)?\s*[.):\-–—]\s+(?P<text>.*)$")),
    ("step", re.compile(r"^\*{1,2}(?P<no>\d{1,2})[.):\-–—]?\*{1,2}\s*(?P<text>.*)$")),
    ("step", re.compile(rf"^(?P<no>{'|'.join(ORDINALS)})(?:ly)?\s*[,.:;)\-]\s*(?P<text>.*)$", re.I)),
    ("reason", re.compile(r"^(?:\*{1,2})?\s*(?:justification|because|reason|rationale|this\s+(?:is\s+because|follows\s+because|works\s+because)|the\s+reason\s+is)\s*\*{0,2}\s*[:\-–—]\s*(?P<text>.*)$", re.I)),
    ("assumption", re.compile(r"^(?:\*{1,2})?\s*(?:assumptions?|assuming|given\s+that|premise)\s*\*{0,2}\s*[:\-–—]\s*(?P<text>.*)$", re.I)),
)
_BULLET, _HEADER, _WRAP, _INLINE = re.compile(r"^[-*•·]\s*"), re.compile(r"^(?:#{1,6}|>)+\s*"), re.compile(r"^\*{1,2}(.+?)\*{1,2}$"), re.compile(r"(?:\*{1,3}|`+|_{1,2})")
_MARK = re.compile(r"\[\s*[Cc]\s*:\s*([01](?:\.\d+)?|0?\.\d+)\s*\]")
_OWN_NAME = re.compile(r"^step\s*\d+\s*[.):\-–—]\s*", re.I)


class Line(NamedTuple):
    kind: str  # blank, text, or one of LINES
    text: str
    no: int = 0


def classified(text: str) -> list[Line]:
    """The lines of a response, each with its kind, without marks of markdown."""
    out = []
    for raw in text.splitlines():
        line = _HEADER.sub("", _BULLET.sub("", raw.strip()).strip()).strip()
        line = m[1].strip() if (m := _WRAP.match(line)) else line
        kind, m = next(((k, m) for k, p in LINES if (m := p.match(line))), ("text" if line else "blank", None))
        no = m["no"].lower() if m and kind == "step" else "0"
        out.append(Line(kind, _INLINE.sub("", m["text"] if m else line).strip(), ORDINALS.index(no) + 1 if no in ORDINALS else int(no)))
    return out


def _placed(at: tuple[int, str, int], line: Line) -> tuple[int, str, int]:
    """(step, field, number) of a line, given those of the line before: a step goes on until the next, a field until a blank line or another field."""
    step, _, number = at
    if line.kind == "step":
        return step + 1, "text", line.no
    if line.kind == "blank":
        return step, "blank", number
    field = line.kind if line.kind != "text" else at[1] if at[1] in ("reason", "assumption") else "text"
    return (step, field, number) if step else (1, field, 1)


def _step(lines: list[tuple[tuple[int, str, int], Line]]) -> dict | None:
    of = {k: [x.text for (_, field, _), x in lines if field == k and x.text] for k in ("text", "reason", "assumption")}
    content, reason = _OWN_NAME.sub("", "\n".join(of["text"]).strip()), " ".join(of["reason"])
    assumed = [a.strip() for t in of["assumption"] if t.lower() not in ("none", "n/a", "-", "implicit") for a in re.split(r"[;,]|\s+and\s+", t) if a.strip()]
    if not (content or assumed or any(field == "reason" for (_, field, _), _ in lines)):
        return None
    marks = [v for v in (_MARK.findall(content)[-1:] + _MARK.findall(reason)[-1:]) if float(v) <= 1]
    content, reason = _MARK.sub("", content).strip(), _MARK.sub("", reason).strip()
    return {"step_number": lines[0][0][2], "content": content, "justification": reason or "implicit", "assumptions": assumed, "confidence": float(marks[-1]) if marks else -1.0}


def _closing(lines: list[Line]) -> str:
    """What a conclusion says: its own text and the text after it, up to a blank line that follows some, or a new step."""
    said = []
    for x in [Line("text", lines[0].text), *lines[1:]]:
        if x.kind == "step" or x.kind == "blank" and said:
            break
        if x.kind == "text" and x.text:
            said.append(x.text)
    return " ".join(said).strip()


# What costs confidence, and how much.
PENALTIES = {"no justifications parsed": 0.2, "all step contents very short": 0.3, "no conclusion found": 0.3}


def parse_chain(text: str | None, unfit: str | None = None) -> dict:
    """Steps, conclusion, issues and confidence of a worked response. A text that is unfit, or empty, has no steps and just that issue."""
    unfit = unfit or ("" if text and text.strip() else "empty response")
    if unfit:
        return {"chain": [], "conclusion": "", "issues": [unfit], "confidence": 0.0}
    lines = classified(text)
    end = next((i for i, x in enumerate(lines) if x.kind == "conclusion"), len(lines))
    places = list(accumulate(lines[:end], _placed, initial=(0, "text", 0)))[1:]
    steps = groupby(((at, x) for at, x in zip(places, lines) if at[0]), key=lambda pair: pair[0][0])
    chain = [s for _, own in steps if (s := _step(list(own)))]
    conclusion = _closing(lines[end:]) if end < len(lines) else ""
    last = "" if conclusion else next((x.text for x in reversed(lines) if x.kind in ("step", "text") and x.text), "")
    tests = {
        "conclusion extracted via fallback": not conclusion and bool(last),
        "no conclusion found": not conclusion and not last,
        "no steps parsed": not chain,
        "no justifications parsed": bool(chain) and all(s["justification"] == "implicit" for s in chain),
        "all step contents very short": bool(chain) and all(len(s["content"]) < 10 for s in chain),
    }
    issues = [k for k, v in tests.items() if v]
    return {"chain": chain, "conclusion": conclusion or last, "issues": issues, "confidence": max(0.0, 1.0 - sum(PENALTIES.get(i, 0.0) for i in issues)) if chain else 0.0}


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = [parse_chain(t, unfit) for t, unfit in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), pa.array([len(x["chain"]) for x in p], pa.int32()), pa.array([x["conclusion"] for x in p], pa.string()), pa.array(["; ".join(x["issues"]) for x in p], pa.string()),
                pa.array([x["confidence"] for x in p], pa.float64()), pa.array([x["chain"] for x in p], pa.list_(STEP)),
            ],
            names=["ident", "n_steps", "conclusion", "issues", "confidence", "chain"],
        )


def chains(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """ident and the parsed chain of each row; refusals, gibberish and null or empty texts have no steps. These are told natively, before any parsing."""
    from evalloom.functions import text as T

    r = rows.select(F.col(ident).cast("long").alias("ident"), T.without_thoughts(text).alias("t"))
    unfit = F.when(F.coalesce(T.strip("t"), F.lit("")) == "", "empty response").when(T.is_refusal(F.col("t")), "model refusal").when(T.is_gibberish(F.col("t")), "gibberish response")
    return r.select("ident", "t", unfit.alias("unfit")).mapInArrow(_chains, CHAIN)


def block(x: Column, label: str, labels: tuple[str, ...]) -> Column:
    """The text under a label at the start of a line, up to the next label; null where the label is missing."""
    stop = "|".join(re.escape(m) for m in labels)
    m = F.regexp_extract(x, rf"(?ims)^\s*{re.escape(label)}\s*(.*?)(?=^\s*(?:{stop})|\Z)", 1)
    return F.when(x.rlike(rf"(?im)^\s*{re.escape(label)}"), F.btrim(m, F.lit(" \t\r\n")))


def blocks(x: Column, labels: tuple[str, ...]) -> Column:
    """A struct of the blocks and the missing labels."""
    names = [n.rstrip(":").lower() for n in labels]
    own = [block(x, n, labels) for n in labels]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit("")) == "", F.lit(f"missing {n.upper()}")) for n, b in zip(names, own)]))
    return F.struct(*[b.alias(n) for n, b in zip(names, own)], F.array_join(missing, ";").alias("issues"))


def flat_fields(value: dict, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(dotted name, text) of the scalars of nested objects: booleans as 1 and 0, lists of scalars as their length under NAME.len; other lists and nulls are left out."""
    for k, v in value.items():
        name = prefix + k
        if isinstance(v, dict):
            yield from flat_fields(v, name + ".")
        elif isinstance(v, list):
            if all(isinstance(x, (str, int, float)) for x in v):
                yield name + ".len", str(len(v))
        elif isinstance(v, bool):
            yield name, str(int(v))
        elif v is not None:
            yield name, v if isinstance(v, str) else json.dumps(v)


def _configs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if isinstance(v := _json(t), dict) for f in flat_fields(v)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], names=["ident", "field", "value"])


def _json(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def flat_configs(rows: DataFrame, ident: str, body: str) -> DataFrame:
    """ident, field, value: the fields of ``flat_fields`` of each JSON object; lines that are none give no row."""
    return rows.select(F.col(ident).cast("long").alias("ident"), F.col(body).alias("b")).mapInArrow(_configs, "ident long, field string, value string")
