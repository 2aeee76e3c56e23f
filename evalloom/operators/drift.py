"""Problem 5: files of one kind whose fields come, go, are renamed and change type.

Files are read in parallel for their headers: the leaves of all lines with their types, folded where they are read. Headers of
successive files are compared, and the union schema is the fold over all files through the lattice below. Only fields that left or came
are read again, with their values, to tell which were renamed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.nested import parsed
from evalloom.session import materialize

#: Bits of the types; a set of types is their sum, and more than one type promotes to string in the union schema.
STRING, NUMBER, BOOLEAN, ARRAY = 1, 2, 4, 8
NAMES = {STRING: "string", NUMBER: "number", BOOLEAN: "boolean", ARRAY: "array"}
HEADERS = "file_id long, path string, kind int, cycle double"
LEAVES = "file_id long, cycle double, path string, kind int, value long"


def _type(v) -> int:
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, (int, float)):
        return NUMBER
    return STRING if isinstance(v, str) else ARRAY


def _canonical(v) -> str:
    """One text for equal values: 1 and 1.0 are equal numbers."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        v = int(v)
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def leaves(record: dict, left_out: frozenset[str], prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every non-null leaf; arrays and scalars are leaves, objects are descended into."""
    for k, v in record.items():
        path = prefix + k
        if path in left_out or v is None:
            continue
        if isinstance(v, dict):
            yield from leaves(v, left_out, path + ".")
        else:
            yield path, v


def _cycle(record: dict) -> float | None:
    cycle = record.get("cycle")
    return float(cycle) if isinstance(cycle, (int, float)) and not isinstance(cycle, bool) else None


def _header_rows(batches: Iterator[pa.RecordBatch], snapshots: tuple[str, ...], left_out: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds: dict[tuple[int, str], int] = {}
        cycles: set[tuple[int, float]] = set()
        for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            record = parsed(body, snapshots)
            if record is None:
                continue
            if (cycle := _cycle(record)) is not None:
                cycles.add((file, cycle))
            for path, v in leaves(record, left_out):
                kinds[file, path] = kinds.get((file, path), 0) | _type(v)
        n, m = len(kinds), len(cycles)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, _ in kinds] + [f for f, _ in cycles], pa.int64()), pa.array([p for _, p in kinds] + [None] * m, pa.string()),
                pa.array([*kinds.values(), *[None] * m], pa.int32()), pa.array([None] * n + [c for _, c in cycles], pa.float64()),
            ],
            names=["file_id", "path", "kind", "cycle"],
        )


def _leaf_rows(batches: Iterator[pa.RecordBatch], snapshots: tuple[str, ...], left_out: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files, cycles, paths, kinds, values = [], [], [], [], []
        for file, body, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
            record = parsed(body, snapshots)
            cycle = None if record is None else _cycle(record)
            if cycle is None:
                continue
            wanted = frozenset(wanted)
            for path, v in leaves(record, left_out):
                if path in wanted:
                    files.append(file)
                    cycles.append(cycle)
                    paths.append(path)
                    kinds.append(_type(v))
                    values.append(xxhash.xxh3_64_intdigest(_canonical(v)) - (1 << 63))
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.int64()), pa.array(cycles, pa.float64()), pa.array(paths, pa.string()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64())],
            names=["file_id", "cycle", "path", "kind", "value"],
        )


def file_id() -> F.Column:
    return F.xxhash64("table_name", "run_id", "file_name")


def headers(rows: DataFrame, snapshots: tuple[str, ...] = (), left_out: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(file_id, path, kinds) of the leaves of each file, and (file_id, cycle) of the cycles that it reports. Folded within each batch before anything is shuffled."""
    r = rows.select(file_id().alias("f"), F.col("body").alias("b")).filter("b is not null")
    h = materialize(r.mapInArrow(partial(_header_rows, snapshots=snapshots, left_out=frozenset(left_out)), HEADERS), "headers")
    return h.filter("path is not null").groupBy("file_id", "path").agg(F.bit_or("kind").alias("kinds")), h.filter("cycle is not null").select("file_id", "cycle").distinct()


def changes(rows: DataFrame, snapshots: tuple[str, ...] = (), left_out: tuple[str, ...] = (), known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """table_name, run_id, file_name, change_kind, field_path, new_path: what differs from the file before of the same run and table.

    rows: table_name, run_id, file_name, written_at, body. Files follow each other by written_at, then name; when they
    arrive plays no part, and repeated lines change nothing. Lines that are no JSON objects hold nothing. A leaf of several types in a
    file has the type "mixed" of just these. A rename is found without comparing every pair of fields: over the cycles that both files
    report, each field that left or came is reduced to one fingerprint of its cycles and values, and equal ones are joined; of files in which
    nothing left or nothing came, no value is read. A run of one file has no changes; an empty table gives no rows.
    known: what ``headers`` gave for the same rows, if it was asked before.
    """
    header, said = known or headers(rows, snapshots, left_out)
    files = rows.groupBy("table_name", "run_id", "file_name").agg(F.min("written_at").alias("written_at")).withColumn("file_id", file_id())
    w = Window.partitionBy("table_name", "run_id").orderBy("written_at", "file_name")
    steps = files.withColumn("before", F.lag("file_id").over(w)).filter("before is not null")
    steps = materialize(steps.select("table_name", "run_id", "file_name", "file_id", "before"), "steps")

    step = steps.select("file_id", "before")
    later = header.join(step.select("file_id"), "file_id").select("file_id", "path", F.col("kinds").alias("new"))
    earlier = header.withColumnRenamed("file_id", "before").join(step, "before").select("file_id", "path", F.col("kinds").alias("old"))
    both = materialize(earlier.join(later, ["file_id", "path"], "full_outer").filter("old is null or new is null or old <> new"), "differ")

    # per step with fields that left and fields that came: the file that holds each of them
    moved = both.groupBy("file_id").agg(F.collect_list(F.when(F.col("new").isNull(), F.col("path"))).alias("gone"), F.collect_list(F.when(F.col("old").isNull(), F.col("path"))).alias("came"))
    moved = materialize(moved.filter("size(gone) > 0 and size(came) > 0").join(step, "file_id").select("file_id", "before", F.inline(F.array(F.struct(F.col("before").alias("holder"), F.col("gone").alias("paths")), F.struct(F.col("file_id").alias("holder"), F.col("came").alias("paths"))))), "moved")
    wanted = moved.groupBy("holder").agg(F.array_distinct(F.flatten(F.collect_list("paths"))).alias("wanted"))
    bodies = rows.filter("body is not null").select(file_id().alias("holder"), "body").join(wanted, "holder")
    leaf = bodies.select("holder", "body", "wanted").mapInArrow(partial(_leaf_rows, snapshots=snapshots, left_out=frozenset(left_out)), LEAVES).distinct()

    pairs = moved.select("file_id", "before").distinct()
    shared = pairs.join(said, "file_id").join(said.select(F.col("file_id").alias("before"), "cycle"), ["before", "cycle"], "left_semi")
    own = moved.select("file_id", "holder", (F.col("holder") == F.col("before")).alias("left"), F.explode("paths").alias("path"))
    v = own.join(leaf.withColumnRenamed("file_id", "holder"), ["holder", "path"]).join(shared.select("file_id", "cycle"), ["file_id", "cycle"], "left_semi")
    fp = F.struct(F.bit_xor(F.xxhash64("cycle", "kind", "value")).alias("x"), F.bit_xor(F.xxhash64("value", "cycle", "kind", F.lit(1))).alias("y"), F.count("*").alias("n"))
    prints = materialize(v.groupBy("file_id", "left", "path").agg(fp.alias("print")), "prints")
    came = prints.filter(~F.col("left")).select("file_id", F.col("path").alias("new_path"), "print")
    renamed = materialize(prints.filter("left").join(came, ["file_id", "print"]).select("file_id", "path", "new_path"), "renamed")
    rest = both.join(renamed.select("file_id", "path"), ["file_id", "path"], "left_anti").join(renamed.select("file_id", F.col("new_path").alias("path")), ["file_id", "path"], "left_anti")
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("retyped")
    out = rest.select("file_id", kind.alias("change_kind"), F.col("path").alias("field_path"), F.lit("").alias("new_path"))
    out = out.unionByName(renamed.select("file_id", F.lit("renamed").alias("change_kind"), F.col("path").alias("field_path"), "new_path"))
    return out.join(steps, "file_id").select("table_name", "run_id", "file_name", "change_kind", "field_path", "new_path")


def promoted(kinds: F.Column) -> F.Column:
    """The lattice: one type stays itself, several promote to string, which holds all."""
    name = F.lit("string")
    for code, label in NAMES.items():
        name = F.when(kinds == code, label).otherwise(name)
    return name


def union_schema(rows: DataFrame, snapshots: tuple[str, ...] = (), left_out: tuple[str, ...] = ()) -> DataFrame:
    """table_name, field_path, field_type, n_files: the fold of all headers; several types promote to string."""
    header, _ = headers(rows, snapshots, left_out)
    files = rows.select("table_name", file_id().alias("file_id")).distinct()
    f = header.join(files, "file_id").groupBy("table_name", F.col("path").alias("field_path")).agg(F.bit_or("kinds").alias("kinds"), F.count("*").alias("n_files"))
    return f.select("table_name", "field_path", promoted(F.col("kinds")).alias("field_type"), "n_files")


def consistent_schema(rows: DataFrame, snapshots: tuple[str, ...] = (), left_out: tuple[str, ...] = ()) -> dict[str, tuple[str, str]]:
    """field path -> (name in the table, type): the union schema with renamed fields under one name, that of the most files, then the least.

    Names are only joined where no file has both. The driver holds field names and renames, of which there are few whatever the rows.
    """
    known = headers(rows, snapshots, left_out)
    header = known[0]
    fields = {r["path"]: (r["kinds"], r["n"]) for r in header.groupBy("path").agg(F.bit_or("kinds").alias("kinds"), F.count("*").alias("n")).collect()}
    edges = changes(rows, snapshots, left_out, known).filter("change_kind = 'renamed'").groupBy("field_path", "new_path").agg(F.count("*").alias("n")).collect()
    name = {p: p for p in fields}
    for _, a, b in sorted((-r["n"], r["field_path"], r["new_path"]) for r in edges):
        if a in name and b in name and name[a] != name[b]:
            new = min((name[a], name[b]), key=lambda x: (-fields[x][1], x))
            old = {name[a], name[b]}
            name = {p: new if x in old else x for p, x in name.items()}
    moved = {p: x for p, x in name.items() if p != x}
    if moved:
        pairs = rows.sparkSession.createDataFrame(sorted(moved.items()) + sorted((x, x) for x in set(moved.values())), "path string, own string")
        clash = {r["own"] for r in header.join(F.broadcast(pairs), "path").groupBy("file_id", "own").agg(F.count("*").alias("n")).filter("n > 1").select("own").distinct().collect()}
        name = {p: p if x in clash else x for p, x in name.items()}
    kinds: dict[str, int] = {}
    for p, x in name.items():
        kinds[x] = kinds.get(x, 0) | fields[p][0]
    return {p: (x, NAMES.get(kinds[x], "string")) for p, x in name.items()}


def _number(v) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


#: Of each promoted type the Arrow type, Spark's, and how a value is cast to it.
CASTS = {
    "number": (pa.float64(), T.DoubleType(), _number),
    "boolean": (pa.bool_(), T.BooleanType(), bool),
    "string": (pa.string(), T.StringType(), _text),
    "array": (pa.list_(pa.string()), T.ArrayType(T.StringType()), lambda v: [None if e is None else _text(e) for e in v]),
}
#: What tells a line: its columns come first, under these names.
KEYS = {"seq": T.LongType(), "table_name": T.StringType(), "run_id": T.StringType(), "file_name": T.StringType(), "line_no": T.IntegerType()}


def column_names(fields: list[str]) -> dict[str, str]:
    """field -> column: its own name, with a number after it where an earlier column has the name in another case."""
    taken, out = set(KEYS), {}
    for f in sorted(fields):
        name, n = f, 1
        while name.lower() in taken:
            n += 1
            name = f"{f}#{n}"
        taken.add(name.lower())
        out[f] = name
    return out


def _typed(batches: Iterator[pa.RecordBatch], schema: dict[str, tuple[str, str]], fields: list[tuple[str, str, str]], snapshots: tuple[str, ...], left_out: frozenset[str]) -> Iterator[pa.RecordBatch]:
    place = {name: i for i, (name, _, _) in enumerate(fields)}
    target = {path: (place[name], CASTS[kind][2]) for path, (name, kind) in schema.items()}
    for b in batches:
        for cut in range(0, b.num_rows, 2000):
            part = b.slice(cut, 2000)
            at, rows = [], []
            for n, body in enumerate(part.column(part.num_columns - 1).to_pylist()):
                record = parsed(body, snapshots)
                if record is None:
                    continue
                row: dict[int, object] = {}
                for path, v in leaves(record, left_out):
                    i, cast = target[path]
                    row.setdefault(i, cast(v))
                at.append(n)
                rows.append(row)
            kept = [c.take(pa.array(at, pa.int64())) for c in part.columns[:-1]]
            made = [pa.array([r.get(i) for r in rows], CASTS[kind][0]) for i, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*KEYS, *(c for _, c, _ in fields)])


def typed(rows: DataFrame, schema: dict[str, tuple[str, str]], snapshots: tuple[str, ...] = (), left_out: tuple[str, ...] = ()) -> DataFrame:
    """seq, table_name, run_id, file_name, line_no and a column per field: every valid line in one table, each value cast to its field's promoted type.

    schema: of every field that some line has its name in the table and its type, see ``consistent_schema``. A field is a column whatever share of the
    files has it, null where a line does not; names that differ only in case stay apart, see ``column_names``. Elements of arrays are texts, those that are no strings as JSON.
    """
    kinds = {name: kind for name, kind in schema.values()}
    fields = [(f, c, kinds[f]) for f, c in column_names(list(kinds)).items()]
    out = T.StructType([*(T.StructField(k, t) for k, t in KEYS.items()), *(T.StructField(c, CASTS[kind][1]) for _, c, kind in fields)])
    return rows.select(*KEYS, "body").mapInArrow(partial(_typed, schema=schema, fields=fields, snapshots=snapshots, left_out=frozenset(left_out)), out)
