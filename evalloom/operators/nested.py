"""Problem 2: nested records into flat tables that keep the links from child to parent, in one pass.

A depth-first visitor emits for every object in a child array its tag, the key of its record, the place of its parent,
its own place and its flat fields. The stream of all tags is written once, partitioned by tag; each table then gets its schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMITTED = "tag string, parent_seq long, parent_pos string, pos string, payload string"


def undotted(value):
    """Nested form of an object: key ``a.b`` is field b of a. Objects under one name are merged, the later value of a field wins."""
    if not isinstance(value, dict):
        return value
    out: dict = {}
    for k, v in value.items():
        *path, last = k.split(".")
        at = out
        for name in path:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        v = undotted(v)
        if isinstance(v, dict) and isinstance(at.get(last), dict):
            at[last] = undotted(at[last] | v)
        else:
            at[last] = v
    return out


def parsed(body: str | None, snapshots: tuple[str, ...] = ()) -> dict | None:
    """The object that a line holds, null if it is no JSON object; fields in ``snapshots`` may hold JSON text or dotted keys."""

    def invalid(name: str):
        raise ValueError(name)

    try:
        record = json.loads(body, parse_constant=invalid)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    for name in snapshots:
        v = record.get(name)
        if isinstance(v, str):
            try:
                inner = json.loads(v, parse_constant=invalid)
            except (ValueError, RecursionError):
                continue
            v = inner if isinstance(inner, dict) else v
        if isinstance(v, dict):
            record[name] = undotted(v)
    return record


def visit(record: dict, arrays: dict[str, str]) -> Iterator[tuple[str, str, str, dict]]:
    """(tag, parent's place, own place, flat fields), depth first, the record itself first under the tag "".

    arrays: path of names -> tag, for the fields that hold child objects. A place is the 0-based position in the array, after the
    place of its parent if that is a child itself. Null elements keep their position and give nothing; an object in the place of
    an array counts as an array of one. Other objects are flattened into dotted fields of their owner; other arrays stay fields.
    """

    def own(value: dict, path: str, prefix: str, fields: dict, children: list) -> None:
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if at in arrays:
                children.append((at, v))
            elif isinstance(v, dict):
                own(v, at, f"{prefix}{k}.", fields, children)
            else:
                fields[prefix + k] = v

    def emit(value: dict, tag: str, path: str, parent: str, place: str) -> Iterator[tuple[str, str, str, dict]]:
        fields: dict = {}
        children: list = []
        own(value, path, "", fields, children)
        yield tag, parent, place, fields
        for at, v in children:
            for i, element in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []):
                if isinstance(element, dict):
                    yield from emit(element, arrays[at], at, place, f"{place}.{i}" if place else str(i))

    yield from emit(record, "", "", "", "")


def _shred(batches: Iterator[pa.RecordBatch], arrays: dict[str, str], snapshots: tuple[str, ...], root: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tags, keys, parents, places, payloads = [], [], [], [], []
        for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            record = parsed(body, snapshots)
            if record is None:
                continue
            for tag, parent, place, fields in visit(record, arrays):
                tags.append(tag or root)
                keys.append(key)
                parents.append(parent)
                places.append(place)
                payloads.append(json.dumps(fields, ensure_ascii=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tags, pa.string()), pa.array(keys, pa.int64()), pa.array(parents, pa.string()), pa.array(places, pa.string()), pa.array(payloads, pa.string())],
            names=["tag", "parent_seq", "parent_pos", "pos", "payload"],
        )


def shred_json(rows: DataFrame, key: str, body: str, arrays: dict[str, str], snapshots: tuple[str, ...] = (), root: str = "record") -> DataFrame:
    """Tagged rows of JSON lines. Null, empty and invalid lines give nothing; repeated rows give their children again."""
    r = rows.select(F.col(key).cast("long").alias("k"), F.col(body).cast("string").alias("b")).filter("b is not null")
    return r.mapInArrow(partial(_shred, arrays=arrays, snapshots=snapshots, root=root), EMITTED)


def exploded(rows: DataFrame, key: str, column: str) -> DataFrame:
    """parent_seq, pos, e: the elements of a typed array of structs, whose fields need no parsing. Null arrays and null elements give nothing; positions count all elements."""
    e = rows.select(F.col(key).cast("long").alias("parent_seq"), F.posexplode(column).alias("_p", "e")).filter("e is not null")
    return e.select("parent_seq", F.col("_p").cast("string").alias("pos"), "e")


def write_tagged(tagged: DataFrame, path: str) -> None:
    """One write for all tables, partitioned by tag; rows stay where they were made, so nothing is shuffled."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_tagged(spark: SparkSession, path: str, tag: str, schema: str | T.StructType, strict: tuple[str, ...] = ()) -> DataFrame:
    """The table of one tag with its schema applied; only that partition is read. A tag that no record has gives an empty table."""
    t = spark.read.schema(EMITTED).parquet(path).filter(F.col("tag") == tag)
    return apply_schema(t, schema, strict).drop("tag")


def apply_schema(tagged: DataFrame, schema: str | T.StructType, strict: tuple[str, ...] = ()) -> DataFrame:
    """The fields of the payload by ``schema``; values that cannot be read as their type come out null, a number or boolean read as string as its text.
    Fields in ``strict`` are strings only: values of another type come out null."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    r = tagged.withColumn("_r", F.from_json("payload", s))
    # quotes inside values are escaped, so the pattern can only meet the field itself
    own = lambda n: F.when(F.col("payload").rlike(re.escape(f'"{n}": "')), F.col(f"_r.`{n}`")) if n in strict else F.col(f"_r.`{n}`")
    return r.select("tag", "parent_seq", "parent_pos", "pos", *[own(f.name).alias(f.name) for f in s.fields])
