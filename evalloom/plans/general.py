"""Queries of the general problems 2, 5 and 6."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import key
from evalloom.operators import drift, nested, orphans
from evalloom.session import run_dir, table

ARRAYS = {
    "config_snapshot.model.adapters": "adapters",
    "config_snapshot.model.adapters.merges": "merges",
    "config_snapshot.verifier.backends": "backends",
    "config_snapshot.verifier.backends.checks": "checks",
}
SNAPSHOTS = ("config_snapshot",)
LEFT_OUT = ("config_snapshot.model.adapters", "config_snapshot.verifier.backends")


#: Schemas of the tables that one record falls into.
SCHEMAS = {
    "model": "`config_snapshot.model.model_path` string",
    "adapters": "adapter_id string",
    "merges": "merge_id string",
    "backends": "backend string",
    "checks": "`check` string, verdict string",
}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records are shredded in one pass into one written stream of tags, which is read by tag; the typed array needs no parsing."""
    path = f"{run_dir(spark)}/tagged-{uuid.uuid4().hex}"
    nested.write_tagged(nested.shred_json(table(spark, d, "decision_records"), "seq", "body", ARRAYS, SNAPSHOTS, root="model"), path)
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    labels = {"model": F.col("`config_snapshot.model.model_path`"), "adapters": F.col("adapter_id"), "merges": F.col("merge_id"), "backends": F.col("backend"), "checks": F.concat(text("check"), F.lit("/"), text("verdict"))}
    out = nested.exploded(table(spark, d, "verify_decisions"), "seq", "per_backend").select(F.lit("per_backend").alias("child_table"), "parent_seq", "pos", F.concat("e.backend", F.lit("/"), "e.verdict").alias("label"))
    for tag, label in labels.items():
        t = nested.read_tagged(spark, path, tag, SCHEMAS[tag], strict=("config_snapshot.model.model_path",) if tag == "model" else ())
        out = out.unionByName(t.select(F.lit(tag).alias("child_table"), "parent_seq", "pos", label.alias("label")))
    return out.filter("label is not null")


def p2_backends(spark: SparkSession, d: str) -> DataFrame:
    e = nested.exploded(table(spark, d, "verify_decisions"), "seq", "per_backend")
    return e.select("parent_seq", F.col("pos").cast("int").alias("place"), "e.backend", "e.verdict", "e.time_ms", "e.property_id")


P2_BACKENDS = """
SELECT seq AS parent_seq, CAST(i - 1 AS INTEGER) AS place, e.backend AS backend, e.verdict AS verdict, e.time_ms AS time_ms, e.property_id AS property_id
FROM (SELECT seq, i, per_backend[i] AS e FROM (SELECT seq, per_backend, unnest(range(1, len(per_backend) + 1)) AS i FROM verify_decisions))
WHERE e IS NOT NULL
"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["seq", "run_id", "file_name", "line_no", "written_at", "body"]
    one = lambda name: table(spark, d, name).select(F.lit(name).alias("table_name"), *cols)
    return one("progress").unionByName(one("decision_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_logs(spark, d), SNAPSHOTS, LEFT_OUT).select("file_name", "change_kind", "field_path", "new_path")


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(_logs(spark, d), SNAPSHOTS)


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """One table of all lines: every field of the union schema, a column under one name for all of its names, cast to its promoted type."""
    logs = _logs(spark, d)
    return drift.typed(logs, drift.consistent_schema(logs, SNAPSHOTS), SNAPSHOTS)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    problems = table(spark, d, "problems")
    patch = F.coalesce("_patch", F.lit(False))
    first = F.min(F.when(~patch, orphans.seconds("ingested_at", problems))).alias("first")
    own = F.max(F.when(~patch, 1)).alias("own")
    p = problems.groupBy(key("problem_id").alias("key")).agg(first, F.min(F.when(patch, F.col("removed_at"))).alias("gone"), own)
    p = p.filter("own = 1 and key is not null").select(F.lit("problems").alias("target"), "key", "first", "gone")
    checks = table(spark, d, "verifications")
    v = checks.groupBy(key("record_id").alias("key")).agg(F.min(orphans.seconds("ingested_at", checks)).alias("first"), F.min("deleted_at").alias("gone"))
    v = v.filter("key is not null").select(F.lit("verifications").alias("target"), "key", "first", "gone")

    pool = table(spark, d, "training_pool")
    of = lambda field, target: F.struct(F.lit(field).alias("ref_field"), F.lit(target).alias("target"), key(field).alias("key"))
    r = pool.select(F.lit("training_pool").alias("src_table"), F.col("seq").alias("src_seq"), orphans.seconds("admitted_at", pool).alias("t"), F.inline(F.array(of("problem_id", "problems"), of("verification_record_id", "verifications"))))
    made = table(spark, d, "verify_decisions")
    q = made.select(F.lit("verify_decisions").alias("src_table"), F.col("seq").alias("src_seq"), orphans.seconds("emitted_at", made).alias("t"), F.inline(F.array(of("problem_id", "problems"))))
    return r.unionByName(q), p.unionByName(v)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs, parents = _references(spark, d)
    found = orphans.orphans(refs, parents)
    return found.select("src_table", "ref_field", "src_seq", "orphan_kind", orphans.month(F.col("t")).alias("ref_month"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(p6_found(spark, d))


P6_FOUND = """
WITH p AS (
  SELECT nullif(lower(trim(problem_id)), '') AS key, min(CASE WHEN coalesce(_patch, false) THEN NULL ELSE ingested_at END) AS first,
         min(CASE WHEN coalesce(_patch, false) THEN removed_at END) AS gone, max(CASE WHEN coalesce(_patch, false) THEN 0 ELSE 1 END) AS own
  FROM problems GROUP BY 1),
v AS (SELECT nullif(lower(trim(record_id)), '') AS key, min(ingested_at) AS first, min(deleted_at) AS gone FROM verifications GROUP BY 1),
t AS (
  SELECT 'problems' AS target, key, epoch_us(first) / 1e6 AS first, gone FROM p WHERE own = 1 AND key IS NOT NULL
  UNION ALL SELECT 'verifications', key, epoch_us(first) / 1e6, gone FROM v WHERE key IS NOT NULL),
r AS (
  SELECT 'training_pool' AS src_table, 'problem_id' AS ref_field, seq AS src_seq, 'problems' AS target, nullif(lower(trim(problem_id)), '') AS key, admitted_at AS secs FROM training_pool
  UNION ALL SELECT 'training_pool', 'verification_record_id', seq, 'verifications', nullif(lower(trim(verification_record_id)), ''), admitted_at FROM training_pool
  UNION ALL SELECT 'verify_decisions', 'problem_id', seq, 'problems', nullif(lower(trim(problem_id)), ''), epoch_us(emitted_at) / 1e6 FROM verify_decisions),
k AS (
  SELECT r.*, CASE WHEN t.key IS NULL THEN 'missing' WHEN t.gone <= r.secs THEN 'deleted' WHEN t.first > r.secs THEN 'late' END AS orphan_kind
  FROM r LEFT JOIN t ON r.target = t.target AND r.key = t.key WHERE r.key IS NOT NULL)
"""
P6_REPORT = P6_FOUND + "SELECT src_table, ref_field, orphan_kind, strftime(make_timestamp(CAST(floor(secs) AS BIGINT) * 1000000), '%Y-%m') AS ref_month, count(*) AS n FROM k WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3, 4"
P6_FOUND += "SELECT src_table, ref_field, src_seq, orphan_kind, strftime(make_timestamp(CAST(floor(secs) AS BIGINT) * 1000000), '%Y-%m') AS ref_month FROM k WHERE orphan_kind IS NOT NULL"

_ELEMENTS = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"


def _children(source: str, array: str) -> str:
    """(the source's columns), i, e: the objects of a JSON array, or of an object in its place."""
    return f"SELECT * FROM (SELECT *, l[i + 1] AS e FROM (SELECT *, unnest(range(0, len(l))) AS i FROM (SELECT *, {_ELEMENTS.format(array)} AS l FROM {source}))) WHERE json_type(e) = 'OBJECT'"


P2_FOUND = f"""
WITH c AS (SELECT seq, CASE json_type(body, '$.config_snapshot') WHEN 'VARCHAR' THEN CAST(json_extract_string(body, '$.config_snapshot') AS JSON) ELSE json_extract(body, '$.config_snapshot') END AS c FROM decision_records WHERE json_valid(body)),
f AS (SELECT seq, coalesce(json_extract(c, '$.model.model_path'), json_extract(c, '$."model.model_path"')) AS path, coalesce(json_extract(c, '$.model.adapters'), json_extract(c, '$."model.adapters"')) AS adapters,
  coalesce(json_extract(c, '$.verifier.backends'), json_extract(c, '$."verifier.backends"')) AS backends FROM c),
a AS (SELECT seq, CAST(i AS VARCHAR) AS pos, e AS a FROM ({_children("f", "adapters")})),
m AS (SELECT seq, pos || '.' || i AS pos, e AS m FROM ({_children("(SELECT seq, pos, json_extract(a, '$.merges') AS x FROM a)", "x")})),
b AS (SELECT seq, CAST(i AS VARCHAR) AS pos, e AS b FROM ({_children("f", "backends")})),
k AS (SELECT seq, pos || '.' || i AS pos, e AS k FROM ({_children("(SELECT seq, pos, json_extract(b, '$.checks') AS x FROM b)", "x")})),
r AS (
  SELECT 'per_backend' AS child_table, parent_seq, CAST(place AS VARCHAR) AS pos, backend || '/' || verdict AS label FROM ({P2_BACKENDS})
  UNION ALL SELECT 'model', seq, '', json_extract_string(path, '$') FROM f WHERE json_type(path) = 'VARCHAR'
  UNION ALL SELECT 'adapters', seq, pos, json_extract_string(a, '$.adapter_id') FROM a
  UNION ALL SELECT 'merges', seq, pos, json_extract_string(m, '$.merge_id') FROM m
  UNION ALL SELECT 'backends', seq, pos, json_extract_string(b, '$.backend') FROM b
  UNION ALL SELECT 'checks', seq, pos, coalesce(json_extract_string(k, '$.check'), '') || '/' || coalesce(json_extract_string(k, '$.verdict'), '') FROM k)
SELECT child_table, parent_seq, pos, label FROM r WHERE label IS NOT NULL
"""


def _leaves_sql(left_out: tuple[str, ...] = ()) -> str:
    """l: table_name, run_id, file_name, written_at, cycle, path, kind, value of all leaves of valid lines."""
    out = " AND ".join(f"path <> '{p}' AND NOT starts_with(path, '{p}.')" for p in left_out) or "true"
    return f"""
WITH s AS (SELECT 'progress' AS table_name, seq, run_id, file_name, written_at, body FROM progress UNION ALL SELECT 'decision_records', seq, run_id, file_name, written_at, body FROM decision_records),
v AS (SELECT table_name, run_id, file_name, written_at, CASE WHEN json_type(body, '$.config_snapshot') = 'VARCHAR' AND json_valid(json_extract_string(body, '$.config_snapshot'))
  THEN json_merge_patch(body, json_object('config_snapshot', CAST(json_extract_string(body, '$.config_snapshot') AS JSON))) ELSE CAST(body AS JSON) END AS body FROM s WHERE json_valid(body)),
t AS (SELECT table_name, run_id, file_name, written_at, TRY_CAST(CASE WHEN json_type(v.body, '$.cycle') NOT IN ('VARCHAR', 'BOOLEAN') THEN json_extract_string(v.body, '$.cycle') END AS DOUBLE) AS cycle,
  replace(substr(j.fullkey, 3), '"', '') AS path, j.type AS type, j.value AS value FROM v, json_tree(v.body) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[')),
l AS (SELECT table_name, run_id, file_name, written_at, cycle, path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN type IN ('VARCHAR', 'BOOLEAN', 'ARRAY') THEN CAST(value AS VARCHAR) ELSE CAST(CAST(value AS DOUBLE) AS VARCHAR) END AS value FROM t WHERE {out})"""


P5_SCHEMA = _leaves_sql() + """
SELECT table_name, path AS field_path, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'string' END AS field_type, count(DISTINCT run_id || '/' || file_name) AS n_files FROM l GROUP BY 1, 2
"""
P5_FOUND = _leaves_sql(LEFT_OUT) + """,
f AS (SELECT table_name, run_id, file_name, lag(file_name) OVER (PARTITION BY table_name, run_id ORDER BY written_at, file_name) AS prev FROM (SELECT table_name, run_id, file_name, min(written_at) AS written_at FROM s GROUP BY ALL)),
h AS (SELECT table_name, run_id, file_name, path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM l GROUP BY ALL),
n AS (SELECT f.*, h.path AS path, h.kinds AS kinds FROM f JOIN h USING (table_name, run_id, file_name) WHERE prev IS NOT NULL),
o AS (SELECT f.*, h.path AS path, h.kinds AS kinds FROM f JOIN h ON h.table_name = f.table_name AND h.run_id = f.run_id AND h.file_name = f.prev),
d AS (SELECT coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.file_name, o.file_name) AS file_name, coalesce(n.prev, o.prev) AS prev, coalesce(n.path, o.path) AS path,
  CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' ELSE 'retyped' END AS kind
  FROM n FULL JOIN o ON n.table_name = o.table_name AND n.run_id = o.run_id AND n.file_name = o.file_name AND n.path = o.path WHERE n.kinds IS DISTINCT FROM o.kinds),
c AS (SELECT DISTINCT table_name, run_id, file_name, cycle FROM l WHERE cycle IS NOT NULL),
k AS (SELECT f.table_name AS table_name, f.run_id AS run_id, f.file_name AS file_name, a.cycle AS cycle FROM f JOIN c a ON a.table_name = f.table_name AND a.run_id = f.run_id AND a.file_name = f.file_name
  JOIN c b ON b.table_name = f.table_name AND b.run_id = f.run_id AND b.file_name = f.prev AND b.cycle = a.cycle),
p AS (SELECT d.table_name, d.run_id, d.file_name, d.kind, d.path, list_sort(list_distinct(list(printf('%.6f', l.cycle) || l.kind || l.value))) AS said FROM d
  JOIN l ON l.table_name = d.table_name AND l.run_id = d.run_id AND l.file_name = CASE d.kind WHEN 'removed' THEN d.prev ELSE d.file_name END AND l.path = d.path
  JOIN k ON k.table_name = d.table_name AND k.run_id = d.run_id AND k.file_name = d.file_name AND k.cycle = l.cycle WHERE d.kind <> 'retyped' GROUP BY ALL),
r AS (SELECT a.table_name, a.run_id, a.file_name, a.path AS path, b.path AS new_path FROM p a JOIN p b ON a.table_name = b.table_name AND a.run_id = b.run_id AND a.file_name = b.file_name AND a.kind = 'removed' AND b.kind = 'added' AND a.said = b.said)
SELECT file_name, 'renamed' AS change_kind, path AS field_path, new_path FROM r
UNION ALL SELECT file_name, kind, path, '' FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.table_name = d.table_name AND r.run_id = d.run_id AND r.file_name = d.file_name AND (r.path = d.path AND d.kind = 'removed' OR r.new_path = d.path AND d.kind = 'added'))
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_backends, p5_found, p5_schema, p5_table, p6_found, p6_report)}
SQL = {"p2_found": P2_FOUND, "p2_backends": P2_BACKENDS, "p5_found": P5_FOUND, "p5_schema": P5_SCHEMA, "p6_found": P6_FOUND, "p6_report": P6_REPORT}
