"""Queries of sources, sinks and parsers: logs are written to the shared folder and read back under each policy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import parsing as P
from evalloom.functions import text as T
from evalloom.operators import keyed as K
from evalloom.plans.effects import _KEY
from evalloom.session import run_dir, table
from evalloom.sources import logs as L
from evalloom.sources import sinks as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


PROGRESS = "cycle int, had_errors string, eval_subdomain map<string,string>"
_OK = "json_valid(body)"
_CYC = "CAST(json_extract_string(body, '$.cycle') AS INTEGER)"


@_query(f"SELECT {_CYC} AS cycle, count(*) AS n FROM progress WHERE {_OK} GROUP BY 1")
def src1_registry_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "registry")
    table(spark, d, "progress").select("body").write.text(path)
    return L.read_lines(spark, path, PROGRESS).groupBy("cycle").agg(F.count("*").alias("n"))


@_query("SELECT 0::BIGINT AS n")
def src2_missing_file(spark: SparkSession, d: str) -> DataFrame:
    return L.read_lines(spark, f"{run_dir(spark)}/no-such-log.jsonl", PROGRESS).agg(F.count("*").alias("n"))


@_query("SELECT max(cycle)::BIGINT AS cycle, count(*) FILTER (cycle = (SELECT max(cycle) FROM verify_decisions)) AS n FROM verify_decisions")
def src3_latest_folder(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark, "tree")
    r = table(spark, d, "verify_decisions").filter("cycle is not null").select("seq", "accepted", F.concat(F.lit(""), F.col("cycle")).alias("c"))
    r.write.partitionBy("c").json(f"{root}/cycles")
    top, folder = L.latest_folder(spark, root)
    return L.read_lines(spark, f"{folder}/*.json", "seq long, accepted boolean").agg(F.lit(top).cast("long").alias("cycle"), F.count("*").alias("n"))


@_query("SELECT seq, session_id FROM training_pool WHERE session_id <> 'rsi' AND prompt <> '' AND response <> ''")
def src4_pool_roots(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark, "runs")
    pool = table(spark, d, "training_pool").select("seq", "session_id", "prompt", "response")
    W.append_registry(pool.filter("seq % 2 = 0"), f"{root}/outputs/training_pool/a.jsonl")
    W.append_registry(pool.filter("seq % 2 = 1"), f"{root}/outputs.old/training_pool/b.jsonl")
    r = L.read_lines(spark, L.pool_paths(f"{root}/outputs")[1:], "seq long, session_id string, prompt string, response string")
    return r.filter("session_id <> 'rsi' and prompt <> '' and response <> ''").select("seq", "session_id")


@_query(f"WITH r AS (SELECT file_name, line_no, {_OK} AS ok FROM decision_records), s AS (SELECT file_name, min(line_no) FILTER (NOT ok) AS stop FROM r GROUP BY 1) SELECT r.file_name AS file_name, r.line_no AS line_no FROM r JOIN s ON r.file_name = s.file_name WHERE stop IS NULL OR line_no < stop")
def src5_replay_prefix(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "decision_records").select("file_name", "line_no", "body")
    return L.read_prefix(r, "body", "cycle int", "line_no", "file_name").select("file_name", "line_no")


@_query(f"SELECT seq, cycle, post_score FROM (SELECT seq, CASE WHEN {_OK} THEN try_cast(json_extract_string(body, '$.cycle') AS INTEGER) END AS cycle, CASE WHEN {_OK} THEN try_cast(json_extract_string(body, '$.post_score') AS DOUBLE) END AS post_score FROM decision_records) WHERE cycle IS NOT NULL AND post_score IS NOT NULL")
def src6_history_scan(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "decision_records").filter(F.try_parse_json("body").isNotNull()).select("seq", "body")
    return L.typed(valid, "body", {"cycle": "int", "post_score": "double"}, ["cycle", "post_score"])


@_query("SELECT backend AS phase, sum(time_ms)::BIGINT AS ms, count(*) AS n FROM (SELECT unnest(per_backend) AS v FROM verify_decisions) AS t, LATERAL (SELECT t.v.backend AS backend, t.v.time_ms AS time_ms) WHERE backend IS NOT NULL AND time_ms IS NOT NULL GROUP BY 1")
def src7_time_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "times")
    W.append_registry(table(spark, d, "verify_decisions").select(F.explode("per_backend").alias("v")).select("v.backend", "v.time_ms"), path)
    r = L.typed(spark.read.text(path), "value", {"backend": "string", "time_ms": "long"}, ["backend", "time_ms"])
    return r.groupBy(F.col("backend").alias("phase")).agg(F.sum("time_ms").alias("ms"), F.count("*").alias("n"))


@_query(f"SELECT problem, candidate_idx, accepted FROM (SELECT {_KEY} AS problem, candidate_idx, accepted, row_number() OVER (PARTITION BY {_KEY}, candidate_idx ORDER BY seq DESC) AS rn FROM verify_decisions WHERE candidate_idx IS NOT NULL) WHERE rn = 1 AND problem IS NOT NULL")
def src11_vote_cache(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verify_decisions").filter("candidate_idx is not null").select(F.struct(F.expr(_KEY).alias("problem"), "candidate_idx").alias("k"), "seq", "accepted")
    return K.latest(r.filter("k.problem is not null"), "k", "seq").select("k.problem", "k.candidate_idx", "accepted")


@_query("SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part WHERE p_size <= 25) WHERE rn = 1")
def src10_base_cache(spark: SparkSession, d: str) -> DataFrame:
    fp = F.substring(F.sha2(F.lit("m7"), 256), 1, 16)
    r = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") <= 25, 2).otherwise(1).alias("version"), fp.alias("model_fp"))
    return L.cached(r, 2, "m7", "p_brand", "p_partkey").select("p_partkey", "p_name", "p_brand")


@_query("SELECT benchmark, item_id, prompt, answer, domain FROM eval_items UNION ALL SELECT 'pool', pool_record_id, prompt, response, domain FROM training_pool")
def src13_benchmark_union(spark: SparkSession, d: str) -> DataFrame:
    """One benchmark is read from its cache, the other, which has none, from its source; the fixture of both stays unused."""
    cols = "benchmark string, item_id string, prompt string, answer string, domain string, meta string"
    items = table(spark, d, "eval_items").select("benchmark", "item_id", "prompt", "answer", "domain", "meta")
    pool = table(spark, d, "training_pool").select(F.lit("pool").alias("benchmark"), F.col("pool_record_id").alias("item_id"), "prompt", F.col("response").alias("answer"), "domain")
    root = _folder(spark, "benchmarks")
    W.append_registry(items, f"{root}/items.jsonl")
    fixture = items.limit(0)
    cached = L.first_available(spark, f"{root}/items.jsonl", cols, lambda: pool, fixture)
    loaded = L.first_available(spark, f"{root}/none.jsonl", cols, lambda: pool, fixture)
    return cached.unionByName(loaded, allowMissingColumns=True).drop("meta")


@_query("SELECT 'fresh' AS tier, seq FROM problems WHERE proposed_at > (SELECT max(proposed_at) FROM problems) - 7 * 86400 UNION ALL SELECT 'stale', seq FROM problems UNION ALL SELECT 'fixture', seq FROM verifications WHERE created_at IS NOT NULL")
def src14_fresh(spark: SparkSession, d: str) -> DataFrame:
    """The source at three times: with fresh rows, with stale ones only, and before it had any."""
    p = table(spark, d, "problems").select("seq", "proposed_at")
    fixture = table(spark, d, "verifications").filter("created_at is not null").select("seq", F.col("created_at").alias("proposed_at"))
    now = p.agg(F.max("proposed_at")).first()[0] or 0.0
    tiers = {"fresh": L.fresh_or_fallback(p, "proposed_at", now, 7, fixture), "stale": L.fresh_or_fallback(p, "proposed_at", now + 30 * 86400, 7, fixture), "fixture": L.fresh_or_fallback(p.filter("proposed_at < 0"), "proposed_at", now, 7, fixture)}
    one, *rest = [df.select(F.lit(name).alias("tier"), "seq") for name, df in tiers.items()]
    return one.unionByName(rest[0]).unionByName(rest[1])


@_query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def src15_after_cutoff(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, d, "events").filter(L.after_cutoff(iso, "2024-01-20 00:00:00")).select("event_id")


@_query()
def src16_bundle(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bundle")
    one = table(spark, d, "eval_items").select("domain", F.struct(F.col("answer").alias("correct"), F.concat(F.lit("not "), "answer").alias("wrong_similar"), F.lit("").alias("wrong_obvious")).alias("t"))
    bundle = one.groupBy("domain").agg(F.to_json(F.collect_list("t")).alias("value"))
    bundle.write.partitionBy("domain").text(path)  # one array in one file per domain
    r = spark.read.schema("correct string, wrong_similar string, wrong_obvious string, domain string").option("multiLine", True).json(path)
    return r.select("domain", "correct", "wrong_similar", "wrong_obvious")


def _generated_sql(n: int, seed: int, tier: int) -> str:
    draw = lambda k: f"('0x' || substr(md5(id || '|{seed}|{tier}|{k}'), 1, 8))::BIGINT % {10 * tier + 9} + 2"
    r = f"SELECT id, ['+', '-', '*', 'max', 'min', 'mod'][CAST(id % 6 + 1 AS INTEGER)] AS category, {draw(1)} AS a, {draw(2)} AS b FROM (SELECT unnest(range({n})) AS id)"
    return f"SELECT id, category, 'Compute ' || a || ' ' || category || ' ' || b AS prompt, CAST(CASE category WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN 'max' THEN greatest(a, b) WHEN 'min' THEN least(a, b) ELSE a % b END AS VARCHAR) AS answer, {tier} AS tier FROM ({r})"


_MADE = " UNION ALL ".join(f"SELECT prompt, id AS o, '{k}' AS difficulty FROM ({_generated_sql(600, 1, t)})" for k, t in (("easy", 1), ("medium", 2), ("hard", 4), ("expert", 8)))


@_query(f"""WITH c AS (SELECT prompt, min(o) AS o, ('0x' || substr(sha256('17:' || prompt), 1, 14))::BIGINT / 72057594037927936.0 < 0.2 AS heldout FROM (SELECT prompt, ('0x' || substr(md5(item_id), 1, 12))::BIGINT AS o FROM eval_items) GROUP BY prompt),
    p AS (SELECT * FROM c WHERE NOT heldout ORDER BY o, prompt LIMIT 500), g AS (SELECT 500 - count(*) AS gap FROM p),
    f AS (SELECT prompt, min({{'o': o, 'd': difficulty}}) AS k FROM ({_MADE}) WHERE prompt NOT IN (SELECT prompt FROM c) GROUP BY prompt),
    r AS (SELECT prompt, k.o AS o, k.d AS difficulty, row_number() OVER (PARTITION BY k.d ORDER BY k.o, prompt) AS rn, ceil(CASE k.d WHEN 'easy' THEN 0.25::DOUBLE WHEN 'medium' THEN 0.4::DOUBLE WHEN 'hard' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END * gap) AS quota, gap FROM f, g),
    m AS (SELECT *, row_number() OVER (ORDER BY rn / quota, difficulty) AS place FROM r WHERE rn <= quota)
    SELECT prompt, 0 AS tier, o, NULL::VARCHAR AS difficulty, false AS heldout FROM p UNION ALL SELECT prompt, 0, o, NULL, true FROM c WHERE heldout UNION ALL SELECT prompt, 1, o, difficulty, false FROM m WHERE place <= gap""")
def src17_bank(spark: SparkSession, d: str) -> DataFrame:
    curated = table(spark, d, "eval_items").select("prompt", F.conv(F.substring(F.md5("item_id"), 1, 12), 16, 10).cast("long").alias("o"))
    tiers = {"easy": 1, "medium": 2, "hard": 4, "expert": 8}
    made = None
    for difficulty, tier in tiers.items():
        g = L.generated(spark, 600, 1, tier).select("prompt", F.col("id").alias("o"), F.lit(difficulty).alias("difficulty"))
        made = g if made is None else made.unionByName(g)
    return L.difficulty_bank(curated, made, "prompt", "o", 500, 0.2, 17)


@_query(_generated_sql(1000, 7, 2))
def src18_generated(spark: SparkSession, d: str) -> DataFrame:
    return L.generated(spark, 1000, 7, 2)


@_query()
def src19_variants(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.concat(F.lit("How far is {a} from {b} in "), "n_name", F.lit("?")).alias("template"))
    return L.variants(t, [{"a": "one", "b": "two"}, {"a": "two", "b": "one"}, {"a": "one", "b": "two"}], "template", 4)


@_query("SELECT cycle, count(*) AS n FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY cycle")
def snk1_append_log(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark, "logs")
    r = table(spark, d, "verify_decisions").filter("cycle is not null").select("seq", "cycle", "accepted")
    W.append_log(r.filter("seq % 2 = 0"), root, "verify_decisions")
    W.append_log(r.filter("seq % 2 = 1"), root, "verify_decisions")
    W.append_log(r, root, "verify_decisions", sink_enabled=False)
    return spark.read.parquet(f"{root}/verify_decisions").groupBy("cycle").agg(F.count("*").alias("n"))


@_query("SELECT record_id, len(property_ids)::BIGINT AS n FROM verifications WHERE seq IS NOT NULL")
def snk2_registry(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "verifications")
    W.append_registry(table(spark, d, "verifications").select("record_id", "property_ids"), path)
    return L.read_lines(spark, path, "record_id string, property_ids array<string>").select("record_id", F.when(F.col("property_ids").isNotNull(), F.size("property_ids")).cast("long").alias("n"))


@_query("SELECT record_id FROM verifications WHERE quorum_accepted")
def snk3_guarded(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "guarded")
    W.append_guarded(table(spark, d, "verifications").filter("quorum_accepted").select("record_id", "quorum_accepted"), path, "quorum_accepted")
    return L.read_lines(spark, path, "record_id string, quorum_accepted boolean").select("record_id")


@_query(f"SELECT {_KEY} AS key, max(proposed_at) AS retired_at FROM problems WHERE proposed_at IS NOT NULL AND problem_id IS NOT NULL AND trim(problem_id) <> '' GROUP BY 1")
def snk4_retirement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").filter("proposed_at is not null").groupBy(F.expr(_KEY).alias("key")).agg(F.max("session_id").alias("session_id"), F.max("proposed_at").alias("at")).filter("key is not null")
    return W.retirement_patches(p, "key", "session_id", F.col("at")).select("key", "retired_at")


@_query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def snk5_snapshot(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark, "snapshot")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    W.snapshot(s, root)
    W.snapshot(s.withColumn("s_acctbal", F.col("s_acctbal") + 1), root)
    return W.read_snapshot(spark, root)


@_query("WITH a AS (SELECT cycle, count(*) AS n FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY cycle), b AS (SELECT cycle, count(*) AS accepted FROM verify_decisions WHERE accepted AND cycle IS NOT NULL GROUP BY cycle), c AS (SELECT cycle, max(n_backends_tried) AS most FROM verify_decisions WHERE fail_count > 0 GROUP BY cycle) SELECT a.cycle AS cycle, n, accepted, most FROM a LEFT JOIN b ON a.cycle = b.cycle LEFT JOIN c ON a.cycle = c.cycle")
def snk6_cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_decisions").filter("cycle is not null")
    a = v.groupBy("cycle").agg(F.count("*").alias("n"))
    b = v.filter("accepted").groupBy("cycle").agg(F.count("*").alias("accepted"))
    c = v.filter("fail_count > 0").groupBy("cycle").agg(F.max("n_backends_tried").alias("most"))
    return W.wide([a, b, c], "cycle")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - p_retailprice, 2) AS score_delta FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def snk7_score_delta(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    r = table(spark, d, "lineitem").join(base, "l_partkey", "left")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") - F.col("p_retailprice"), 2).alias("score_delta"))


@_query("SELECT seq, count(*) AS n, count(*) FILTER (v.verdict = 'PASS') AS pass_count FROM (SELECT seq, unnest(per_backend) AS v FROM verify_decisions) WHERE v IS NOT NULL GROUP BY seq")
def snk8_nested_decision(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "verify_decisions").select("seq", F.posexplode("per_backend").alias("pos", "v")).filter("v is not null")
    nested = flat.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("per_backend"))
    return nested.select("seq", F.size("per_backend").cast("long").alias("n"), F.size(F.filter("per_backend", lambda x: x["v"]["verdict"] == "PASS")).cast("long").alias("pass_count"))


@_query("SELECT seq, cycle, coalesce(accepted, false) AS parsed, nullif(reject_reason, '') AS failure_reason FROM verify_decisions")
def snk9_attempt_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verify_decisions").select("seq", "cycle", F.coalesce("accepted", F.lit(False)).alias("parsed"), T.truthy("reject_reason").alias("failure_reason"))


@_query("SELECT l_orderkey AS step, l_linenumber AS pos, l_extendedprice AS loss_unweighted, l_extendedprice * l_discount AS loss_weighted FROM lineitem")
def snk10_step_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("loss_unweighted"), (F.col("l_extendedprice") * F.col("l_discount")).alias("loss_weighted"))


@_query("SELECT cycle, count(*) AS n FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY cycle")
def snk12_autopsy(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "autopsy")
    v = table(spark, d, "verify_decisions").filter("cycle is not null").groupBy("cycle", "accept_policy").agg(F.count("*").alias("n"))
    W.documents(v, "cycle", "accept_policy", "policies").select(F.col("document").alias("value")).write.text(path)
    r = L.read_lines(spark, path, "cycle int, policies array<struct<accept_policy:string,n:long>>")
    return r.select("cycle", F.aggregate("policies.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@_query("SELECT seq, CAST(len(string_split(response, chr(10))) AS BIGINT) AS steps FROM training_pool WHERE response IS NOT NULL")
def snk13_sample_dump(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "samples")
    r = table(spark, d, "training_pool").filter("response is not null").select("seq", F.transform(F.split("response", "\n"), lambda s, i: F.struct(i.alias("step_number"), s.alias("content"))).alias("chain"))
    r.write.json(path)
    return spark.read.schema("seq long, chain array<struct<step_number:int,content:string>>").json(path).select("seq", F.size("chain").cast("long").alias("steps"))


@_query("SELECT run_id, count(*) AS n FROM progress GROUP BY run_id")
def snk14_dashboard(spark: SparkSession, d: str) -> DataFrame:
    doc = W.documents(table(spark, d, "progress").select("run_id", "seq", "line_no"), "run_id", "seq", "history")
    return doc.select("run_id", F.json_array_length(F.get_json_object("document", "$.history")).cast("long").alias("n"))


@_query("SELECT 'table_rows=' || count(*) || ' accepted=' || count(*) FILTER (accepted) AS value FROM verify_decisions")
def snk16_audit(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verify_decisions").agg(F.count("*").alias("table_rows"), F.count_if("accepted").alias("accepted"))
    return W.audit_lines(g, "table_rows", "accepted")


@_query()
def prj32_step_chains(spark: SparkSession, d: str) -> DataFrame:
    r = P.chains(table(spark, d, "training_pool"), "seq", "response")
    return r.select(F.col("ident").alias("seq"), "n_steps", "conclusion", "issues", F.round("confidence", 6).alias("confidence"))


def _trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


_LABELS = ("PROBLEM:", "ANSWER:", "PROPERTIES:", "WRONG_ANSWER:")


@_query(f"SELECT seq, {_trim('problem_text')} AS problem, array_to_string(list_filter([CASE WHEN coalesce({_trim('problem_text')}, '') = '' THEN 'missing PROBLEM' END, CASE WHEN declared_difficulty IS NULL THEN 'missing ANSWER' END], lambda x: x IS NOT NULL), ';') AS issues FROM problems")
def prj33_labelled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every problem as a labelled text; a null problem has no block of its own."""
    p = table(spark, d, "problems")
    raw = F.concat(F.when(F.col("problem_text").isNotNull(), F.concat(F.lit("PROBLEM: "), "problem_text")).otherwise(""), F.lit("\nANSWER: "), F.coalesce(F.col("declared_difficulty").cast("string"), F.lit("")), F.lit("\nPROPERTIES:\n- a\nWRONG_ANSWER: 0"))
    b = p.select("seq", P.blocks(raw, _LABELS).alias("b"))
    return b.select("seq", F.col("b.problem").alias("problem"), F.col("b.issues").alias("issues"))


@_query("""WITH r AS (WITH t AS (SELECT d.seq AS seq, replace(substr(j.fullkey, 3), '"', '') AS field, j.type AS type, j.value AS value FROM (SELECT seq, body FROM decision_records WHERE json_valid(body)) d, json_tree(d.body) j WHERE NOT contains(j.fullkey, '['))
    SELECT seq, CASE type WHEN 'ARRAY' THEN field || '.len' ELSE field END AS field, CASE type WHEN 'ARRAY' THEN CAST(json_array_length(value) AS VARCHAR) WHEN 'BOOLEAN' THEN CASE CAST(value AS VARCHAR) WHEN 'true' THEN '1' ELSE '0' END ELSE json_extract_string(value, '$') END AS value
    FROM t WHERE type NOT IN ('OBJECT', 'NULL') AND (type <> 'ARRAY' OR len(list_filter(json_extract(value, '$[*]'), lambda e: json_type(e) IN ('OBJECT', 'ARRAY', 'NULL'))) = 0))
    SELECT seq, field, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text, TRY_CAST(value AS DOUBLE) AS number FROM r""")
def prj39_flat_config(spark: SparkSession, d: str) -> DataFrame:
    r = P.flat_configs(table(spark, d, "decision_records"), "seq", "body").withColumnRenamed("ident", "seq")
    number = F.col("value").try_cast("double")
    return r.select("seq", "field", F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))
